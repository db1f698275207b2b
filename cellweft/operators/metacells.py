"""Metacells: KMeans on embeddings, relabelled by size, with their summaries."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import euclidean


def choose_n(n_rna: int, target_size: int, least: int = 2, most: int | None = None, n_cells: int | None = None) -> int:
    """Metacells for ``target_size`` cells each, within the limits; at least 2 and fewer than the cells."""
    n = max(least, round(n_rna / target_size))
    n = min(n, most) if most else n
    n = min(n, n_cells) if n_cells else n
    if n < 2 or n_cells and n >= n_cells:
        raise ValueError(f"{n} metacells of {n_cells} cells make no sense")
    return n


def export_n(wanted: int, n_cells: int) -> int:
    return min(wanted, max(2, n_cells // 20), n_cells)


def cluster(points: DataFrame, k: int, seed: int = 0, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(id, metacell, distance) and centroids (metacell, emb); best of ``rounds`` seeds."""
    data = points.select("id", F.col("emb").cast("array<double>").alias("emb"), array_to_vector(F.col("emb").cast("array<double>")).alias("features"))
    fits = [KMeans(k=k, seed=seed + i, maxIter=50).fit(data) for i in range(rounds)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    spark = points.sparkSession
    centers = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, center array<double>")
    got = model.transform(data).join(F.broadcast(centers), "prediction")
    assigned = got.select("id", F.col("prediction").alias("label"), euclidean(F.col("emb"), F.col("center")).alias("distance"))
    names = relabel(assigned.select("id", "label"))
    out = assigned.join(names, "label").select("id", "metacell", "distance")
    return out, centers.join(names, centers.prediction == names.label).select("metacell", F.col("center").alias("emb"))


def relabel(assigned: DataFrame) -> DataFrame:
    """MC_001.. for cluster labels, the largest first."""
    order = Window.orderBy(F.desc("n"), "label")
    return assigned.groupBy("label").agg(F.count("*").alias("n")).select("label", F.format_string("MC_%03d", F.row_number().over(order)).alias("metacell"))


def summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("metacell").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_distance"), F.median("distance").alias("median_distance"))


def size_stats(assigned: DataFrame, key: str = "metacell") -> DataFrame:
    n = assigned.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("min"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("max"))


def mean_by_metacell(values: DataFrame, assigned: DataFrame) -> DataFrame:
    """Mean of ``value`` of each metacell and variable, NaNs left out; keyed by (modality_key, id)."""
    keys = [c for c in ("modality_key", "id") if c in values.columns and c in assigned.columns]
    return values.where(~F.isnan("value")).join(assigned.select(*keys, "metacell"), keys).groupBy("metacell", "variable").agg(F.avg("value").alias("value"))


def purity(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Most frequent label of each metacell and its share; none gives ``unknown`` and null."""
    named = assigned.join(labels, "id", "left").where(F.col("label").isNotNull() & (F.col("label") != ""))
    counts = named.groupBy("metacell", "label").agg(F.count("*").alias("n"))
    order = Window.partitionBy("metacell").orderBy(F.desc("n"), "label")
    best = counts.select("*", F.row_number().over(order).alias("place"), F.sum("n").over(Window.partitionBy("metacell")).alias("total")).where("place = 1")
    every = assigned.select("metacell").distinct()
    return every.join(best, "metacell", "left").select("metacell", F.coalesce("label", F.lit("unknown")).alias("majority_label"), (F.col("n") / F.col("total")).alias("purity"))
