"""Pseudo-pairs of cells over modalities from a joint embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import assignment, neighbours
from ..operators.dataset import labelled
from ..schema import SchemaError, require_unique


def match(embeddings: DataFrame, labels: DataFrame, label: str, value: str, marks: list[str], n_pairs: int | None = None, min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples (wide), pairs (long) and their summary.

    ``embeddings`` is (cell, modality_key, mark, emb), ``labels`` (obs_id, ...).
    Anchors are the RNA cells with the best support in every mark.
    """
    obs = ids.obs_id(F.col("modality_key"), F.col("cell"))
    points = require_unique(embeddings.withColumn("obs_id", obs), ["obs_id"], "embeddings").join(labels, "obs_id")
    points = labelled(points, label, value, min_confidence)
    rna = points.where("modality_key = 'rna'").select(F.col("cell").alias("id"), "emb")
    cells = points.where(F.col("mark").isin(*marks) & (F.col("modality_key") != "rna")).select("mark", F.col("cell").alias("id"), "emb")
    sizes = {r["mark"]: r["count"] for r in cells.groupBy("mark").count().collect()}
    most = min([rna.count(), *(sizes.get(m, 0) for m in marks)])
    n = most if n_pairs is None else n_pairs
    if n <= 0 or n > most:
        raise SchemaError(f"{n} pairs are wanted, {most} can be made")
    anchors = neighbours.select_anchors(neighbours.nearest_support(rna, cells), n)
    pairs = assignment.match(anchors.select("sample_id", "id").join(rna, "id"), cells)
    wide = assignment.wide_matches(pairs, marks)
    samples = anchors.select("sample_id", F.col("id").alias("cell_rna"), "anchor_rank", F.col("support_mean").alias("support_mean_nn_distance"), F.col("support_max").alias("support_max_nn_distance")).join(wide, "sample_id")
    return samples.orderBy("anchor_rank"), pairs, assignment.match_summary(pairs)
