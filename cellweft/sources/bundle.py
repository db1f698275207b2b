"""Annotated matrices as folders of Parquet tables.

A bundle has obs/ (cells), var/ (features), entries/layer=NAME (row, feature,
value), obsm/ (cell, key, emb) and uns.json; many modalities lie side by side
under ``modality_key=NAME`` so a filter on it prunes folders.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(path: str, obs: DataFrame, var: DataFrame, layers: dict[str, DataFrame], obsm: DataFrame | None = None, uns: dict | None = None, mode: str = "errorifexists") -> None:
    obs.write.mode(mode).parquet(f"{path}/obs")
    var.write.mode(mode).parquet(f"{path}/var")
    for name, entries in layers.items():
        entries.write.mode(mode).parquet(f"{path}/entries/layer={name}")
    if obsm is not None:
        obsm.write.mode(mode).partitionBy("key").parquet(f"{path}/obsm")
    spark = obs.sparkSession
    spark.createDataFrame([(json.dumps(uns or {}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/uns")


def read_obs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/obs")


def read_var(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/var")


def read_layer(spark: SparkSession, path: str, layer: str = "counts") -> DataFrame:
    return spark.read.parquet(f"{path}/entries/layer={layer}")


def read_embedding(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{path}/obsm").where(F.col("key") == key)


def read_uns(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/uns").first().value)


def embeddings_wide(emb: DataFrame, prefix: str, size: int) -> DataFrame:
    """Embedding array to columns PREFIX_1.. ."""
    return emb.select(*(c for c in emb.columns if c != "emb"), *(F.get("emb", F.lit(k)).alias(f"{prefix}_{k + 1}") for k in range(size)))


def embeddings_long(wide: DataFrame, prefix: str) -> DataFrame:
    """Columns PREFIX_1.. to one embedding array."""
    names = sorted((c for c in wide.columns if c.startswith(f"{prefix}_") and c[len(prefix) + 1 :].isdigit()), key=lambda c: int(c[len(prefix) + 1 :]))
    return wide.select(*(c for c in wide.columns if c not in names), F.array(*(F.col(f"`{c}`").cast("double") for c in names)).alias("emb"))


def concat_modalities(parts: dict[str, DataFrame]) -> DataFrame:
    """Per-modality frames one under the other, with modality_key."""
    out = None
    for key, df in parts.items():
        df = df.withColumn("modality_key", F.lit(key))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
