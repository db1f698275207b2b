"""Interval joins without cross joins.

Both sides are cut into tiles of ``tile`` positions and joined on chromosome and
tile; a pair that shares several tiles is kept in the first it shares, so no
distinct is needed.  The join is an equi-join, which AQE can split where a tile
is crowded.  ``tile`` should be about the length of the longer intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals
from .qc import first_n


def _tiled(df: DataFrame, prefix: str, start: Column, end: Column, tile: int) -> DataFrame:
    first, last = F.floor(start / tile), F.floor((F.greatest(end, start + 1) - 1) / tile)
    renamed = df.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns), first.alias(f"{prefix}_t0"), last.alias(f"{prefix}_t1"))
    return renamed.withColumn("_tile", F.explode(F.sequence(f"{prefix}_t0", f"{prefix}_t1")))


def overlap_join(a: DataFrame, b: DataFrame, min_overlap: int = 1, tile: int = 5000) -> DataFrame:
    """Pairs of intervals on one chromosome that share ``min_overlap`` positions; columns a_* and b_*.

    With 0, intervals that touch an interval of no length inside them count as the half-open rule says.
    """
    left = _tiled(a, "a_", F.col("start"), F.col("end"), tile)
    right = _tiled(b, "b_", F.col("start"), F.col("end"), tile)
    pairs = left.join(right.withColumnRenamed("_tile", "_tile_b"), (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_tile") == F.col("_tile_b")))
    length = intervals.overlap_length(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    ok = intervals.overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")) if min_overlap <= 1 else length >= min_overlap
    pairs = pairs.where(ok & (F.col("_tile") == F.greatest("a__t0", "b__t0")))
    return pairs.drop("_tile", "_tile_b", "a__t0", "a__t1", "b__t0", "b__t1")


def window_join(a: DataFrame, b: DataFrame, window: int, tile: int | None = None) -> DataFrame:
    """Pairs at most ``window`` apart, with ``distance`` (signed, 0 if they overlap)."""
    tile = tile or max(2 * window, 1000)
    left = _tiled(a, "a_", F.col("start") - window - 1, F.col("end") + window + 1, tile)
    right = _tiled(b, "b_", F.col("start"), F.col("end"), tile)
    pairs = left.join(right.withColumnRenamed("_tile", "_tile_b"), (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_tile") == F.col("_tile_b")))
    pairs = pairs.withColumn("distance", intervals.distance(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    pairs = pairs.where((F.abs("distance") <= window) & (F.col("_tile") == F.greatest("a__t0", "b__t0")))
    return pairs.drop("_tile", "_tile_b", "a__t0", "a__t1", "b__t0", "b__t1")


def center_tss_join(bins: DataFrame, genes: DataFrame, window: int) -> DataFrame:
    """Bins whose centre is at most ``window`` from a gene's tss, both ends inclusive; columns a_* (bin), b_* (gene), distance."""
    points = bins.withColumn("center", intervals.midpoint(F.col("start"), F.col("end")))
    tile = max(2 * window, 1000)
    left = points.select(*(F.col(f"`{c}`").alias(f"a_{c}") for c in points.columns)).withColumn("_tile", F.explode(F.sequence(F.floor((F.col("a_center") - window) / tile), F.floor((F.col("a_center") + window) / tile))))
    right = genes.select(*(F.col(f"`{c}`").alias(f"b_{c}") for c in genes.columns)).withColumn("_tile_b", F.floor(F.col("b_tss") / tile))
    pairs = left.join(right, (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_tile") == F.col("_tile_b")))
    pairs = pairs.withColumn("distance", F.abs(F.col("b_tss") - F.col("a_center")).cast("bigint"))
    return pairs.where(F.col("distance") <= window).drop("_tile", "_tile_b")


def nearest_k(pairs: DataFrame, key: list[str], k: int, order: list[str | Column]) -> DataFrame:
    """The k nearest of each key; ties are settled by ``order``."""
    return pairs if k <= 0 else first_n(pairs, key, order, k)


def covered_bins(fragments: DataFrame, size: int) -> DataFrame:
    """Each fragment in every fixed bin that one of its ends lies in."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)
    return fragments.withColumn("bin", F.explode(F.array_distinct(F.array(first, last))))
