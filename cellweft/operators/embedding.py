"""Highly variable features, PCA and LSI."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..recovery import keep
from . import components, matrix
from .places import numbered


def feature_moments(entries: DataFrame, n_cells: int) -> DataFrame:
    """Mean and sample variance over all cells, zeros included."""
    mean = F.sum("value") / n_cells
    return entries.groupBy("feature").agg(mean.alias("mean"), ((F.sum(F.col("value") * F.col("value")) - n_cells * mean * mean) / max(1, n_cells - 1)).alias("variance"))


def variable_by_variance(moments: DataFrame, k: int) -> DataFrame:
    return moments.orderBy(F.desc("variance"), "feature").limit(k).select("feature")


def variable_by_dispersion(moments: DataFrame, k: int, bins: int = 20) -> DataFrame:
    """Features of largest dispersion against features of like mean.

    Dispersion is variance / mean; features are binned by quantile of the mean and
    scored by distance from the bin's median in median absolute deviations.
    """
    base = moments.where("mean > 0").withColumn("dispersion", F.col("variance") / F.col("mean"))
    cuts = base.agg(F.percentile("mean", F.array(*(F.lit(i / bins) for i in range(1, bins))))).first()[0] or []
    binned = base.withColumn("bin", sum((F.when(F.col("mean") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    mid = binned.groupBy("bin").agg(F.median("dispersion").alias("_mid"))
    off = binned.join(F.broadcast(mid), "bin").withColumn("_off", F.abs(F.col("dispersion") - F.col("_mid")))
    mad = off.groupBy("bin").agg((F.median("_off") * 1.4826).alias("_mad"))
    scored = off.join(F.broadcast(mad), "bin").withColumn("score", F.when(F.col("_mad") > 0, (F.col("dispersion") - F.col("_mid")) / F.col("_mad")).otherwise(0.0))
    return scored.orderBy(F.desc("score"), "feature").limit(k).select("feature", "score")


def pca(entries: DataFrame, features: DataFrame, k: int = 50, scale: bool = True) -> DataFrame:
    """(cell, emb): principal components of standardised columns; signs are arbitrary, constant columns count for nothing."""
    entries = keep(entries.join(features.select("feature"), "feature", "left_semi"), "pca")
    if scale:
        moments = feature_moments(entries, max(1, entries.select("cell").distinct().count()))
        # what sums leave of a constant column is rounding
        times = F.when(F.col("variance") > 1e-12 * F.col("mean") * F.col("mean"), 1 / F.sqrt("variance")).otherwise(0.0)
        entries = entries.join(moments.select("feature", times.alias("_times")), "feature").select("cell", "feature", (F.col("value") * F.col("_times")).alias("value"))
    return components.project(entries, features, k, centred=True)


def lsi(entries: DataFrame, n_cells: int, features: DataFrame, k: int = 50) -> DataFrame:
    """(cell, emb): left singular vectors times singular values of the TF-IDF matrix."""
    return components.project(matrix.tf_idf(entries, n_cells), features, k)


def scale_and_clip(long: DataFrame, most: float = 10.0) -> DataFrame:
    from ..functions import scores

    z = matrix.zscore(long, "feature", "value", "value")
    return z.withColumn("value", scores.clip(F.coalesce("value", F.lit(0.0)), most))


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Indicator arrays of covariates over all modalities; missing is a category, constant columns are left out."""
    from ..functions import ids

    parts = []
    for c in columns:
        levels = sorted(r[0] for r in df.select(ids.covariate(F.col(c)).alias("v")).distinct().collect())
        if len(levels) > 1:
            parts += [(ids.covariate(F.col(c)) == v).cast("double") for v in levels]
    return df.withColumn("covariates", F.array(*parts) if parts else F.array().cast("array<double>"))


def cell_order(df: DataFrame, key: str = "cell") -> DataFrame:
    return numbered(df, [key])
