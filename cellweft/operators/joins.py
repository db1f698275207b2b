"""Equi-joins that attach one table to another, and what they report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..schema import SchemaError
from .places import numbered


def attach_metadata(obs: DataFrame, cells: DataFrame, key: str = "barcode") -> DataFrame:
    """Cells' columns beside each observation with the same core barcode; ``matched`` says if there was one."""
    core = cells.withColumn("_core", ids.strip_10x_suffix(F.col(key))).drop(key).withColumn("_hit", F.lit(True))
    got = obs.withColumn("_own", ids.strip_10x_suffix(F.col(key))).join(core, F.col("_own") == F.col("_core"), "left")
    return got.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_own", "_core", "_hit")


def matched_fraction(attached: DataFrame) -> DataFrame:
    """Observations, matches and their share."""
    hit = F.count_if("matched")
    return attached.agg(F.count("*").alias("n"), hit.alias("n_matched"), (hit / F.count("*")).alias("fraction"))


def join_labels(left: DataFrame, labels: DataFrame, key: str = "obs_id", suffix: str = "_label") -> DataFrame:
    """Left join whose right columns get a suffix where both sides have the name."""
    renamed = labels.withColumnsRenamed({c: c + suffix for c in labels.columns if c != key and c in left.columns})
    return left.join(renamed, key, "left")


def flag_lookup(names: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    """A flag of each name, false where it isn't listed."""
    return names.join(flags.select(key, flag), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def positions(names: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Places of names; a name that the index lacks is an error."""
    missing = [str(r[0]) for r in names.join(index, key, "left_anti").select(key).limit(5).collect()]
    if missing:
        raise SchemaError(f"no {key} {', '.join(missing)}")
    return names.join(index, key)


def row_ids(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``row_id``: the first of metacell_id, sample_id, row_id that exists, else row_00001 and so on in order."""
    for c in ("metacell_id", "sample_id", "row_id"):
        if c in df.columns:
            return df.withColumn("row_id", F.col(c).cast("string"))
    return numbered(df, order, "_place", 1).withColumn("row_id", F.format_string("row_%05d", "_place")).drop("_place")


def unmapped_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have no value, or ``unknown``, in each column."""
    cols = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c) == "unknown").alias("n_unknown"), F.count("*").alias("n")) for c in columns]
    return df.agg(F.array(*cols).alias("_c")).select(F.inline("_c"))


def label_agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Share of shared keys whose labels agree."""
    both = a.select(key, F.col(label).alias("_a")).join(b.select(key, F.col(label).alias("_b")), key)
    return both.agg(F.count("*").alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))
