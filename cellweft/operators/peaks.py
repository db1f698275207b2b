"""Peak calling from tag positions: pileup as a running sum, local Poisson, BH.

Everything but the Poisson tail is relational: tags are deduplicated, moved and
extended, turned into +1 and -1 events and summed in order of position, first
within tiles of a chromosome and then over them, so no task sorts a whole
chromosome.
"""

from __future__ import annotations

from math import log10

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..recovery import keep
from .families import lgamma

TILE = 1_000_000


def tags(fragments: DataFrame) -> DataFrame:
    """One tag a position and strand end of the fragments."""
    ends = fragments.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit("+").alias("strand")), F.struct((F.col("end") - 1).alias("pos"), F.lit("-").alias("strand")))).alias("t"))
    return ends.select("chrom", "t.pos", "t.strand").distinct()


def coverage(found: DataFrame, shift: int = -100, extend: int = 200) -> DataFrame:
    """chrom, start, end, depth of constant stretches of the shifted and extended tags."""
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("pos") + shift).otherwise(F.col("pos") - shift - extend + 1)
    spans = found.select("chrom", F.greatest(start, F.lit(0)).alias("s"), (start + extend).alias("e")).where("e > s")
    return pileup(spans)


def pileup(spans: DataFrame) -> DataFrame:
    """Depth of intervals (chrom, s, e): running sums of events, carried over tiles."""
    events = spans.select("chrom", F.inline(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("e").alias("pos"), F.lit(-1).alias("d")))))
    at = events.groupBy("chrom", "pos").agg(F.sum("d").alias("d")).withColumn("tile", F.floor(F.col("pos") / TILE))
    carried = at.groupBy("chrom", "tile").agg(F.sum("d").alias("t"), F.min("pos").alias("first"))
    order = Window.partitionBy("chrom").orderBy("tile")
    carried = carried.select("chrom", "tile", F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("first").over(order).alias("next"))
    inner = Window.partitionBy("chrom", "tile").orderBy("pos")
    got = at.withColumns({"run": F.sum("d").over(inner), "following": F.lead("pos").over(inner)}).join(carried, ["chrom", "tile"])
    return got.select("chrom", F.col("pos").alias("start"), F.coalesce("following", "next").alias("end"), (F.col("run") + F.col("base")).alias("depth")).where("end is not null and depth > 0")


def log10_poisson_tail(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """-log10 P(X >= k) for Poisson means lam, by the series on the far side of the mean from k."""
    k, lam = np.broadcast_arrays(np.asarray(k, float), np.asarray(lam, float))
    above = k > lam
    # terms from k upwards above the mean, from k - 1 downwards else; both shrink
    i = np.where(above, k, np.maximum(k - 1, 0))
    lead = i * np.log(lam) - lam - lgamma(i + 1.0)
    total, term = np.ones(k.shape), np.ones(k.shape)
    while (term > 1e-12 * total).any():
        term = np.where(above, term * lam / (i + 1), term * i / lam)
        i = np.where(above, i + 1, np.maximum(i - 1, 0))
        total = total + term
    tail = lead + np.log(total)
    below = np.log(np.maximum(-np.expm1(np.minimum(tail, 0.0)), 1e-300))
    return np.where(k <= 0, 0.0, np.maximum(-np.where(above, tail, below) / np.log(10), 0.0))


@pandas_udf(DoubleType())
def _tail(k: pd.Series, lam: pd.Series) -> pd.Series:
    return pd.Series(log10_poisson_tail(k.to_numpy(float), lam.to_numpy(float)))


def q_values(per: DataFrame) -> DataFrame:
    """p and q (both -log10) from the length covered by each distinct p.

    Ranks and the running maximum are carried over steps of 0.01: p has five
    decimals, so a step has a thousand rows at most and the steps are few.
    """
    per = keep(per.withColumn("step", F.floor(F.col("p") * 100)), "per_p")
    down, up = Window.orderBy(F.desc("step")), Window.orderBy("step")
    before = Window.unboundedPreceding, -1
    above = per.groupBy("step").agg(F.sum("length").alias("length")).select("step", F.coalesce(F.sum("length").over(down.rowsBetween(*before)), F.lit(0)).alias("above"))
    total = float(per.agg(F.sum("length")).first()[0] or 1)
    rank = F.col("above") + F.sum("length").over(Window.partitionBy("step").orderBy(F.desc("p")))
    raw = keep(per.join(above, "step").select("p", "step", (F.col("p") - (F.lit(log10(total)) - F.log10(rank))).alias("raw")), "raw_q")
    below = raw.groupBy("step").agg(F.max("raw").alias("most")).select("step", F.max("most").over(up.rowsBetween(*before)).alias("below"))
    inner = F.max("raw").over(Window.partitionBy("step").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    return raw.join(below, "step").select("p", F.greatest(inner, "below", F.lit(0.0)).alias("q"))


def _merged(stretches: DataFrame, gap: int) -> DataFrame:
    """Disjoint stretches with ``_g``, the number of their group in the chromosome; larger gaps part groups.

    Ends and numbers are carried over tiles, as depths are, so no task sorts a chromosome.
    """
    placed = stretches.withColumn("tile", F.floor(F.col("start") / TILE))
    inner, tiles = Window.partitionBy("chrom", "tile").orderBy("start"), Window.partitionBy("chrom").orderBy("tile")
    before = tiles.rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("chrom", "tile").agg(F.max("end").alias("last")).select("chrom", "tile", F.max("last").over(before).alias("_before"))
    previous = F.coalesce(F.lag("end").over(inner), "_before")
    marked = placed.join(ends, ["chrom", "tile"]).withColumn("_new", F.coalesce(F.col("start") - previous > gap, F.lit(True)).cast("int"))
    base = marked.groupBy("chrom", "tile").agg(F.sum("_new").alias("n")).select("chrom", "tile", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return marked.withColumn("_g", F.sum("_new").over(inner)).join(base, ["chrom", "tile"]).withColumn("_g", F.col("_g") + F.col("_base")).drop("_before", "_new", "_base", "tile")


def call(fragments: DataFrame, genome_size: float, q: float = 0.01, shift: int = -100, extend: int = 200, local: int = 10000, min_length: int | None = None, max_gap: int | None = None) -> DataFrame:
    """chrom, start, end, summit, depth, neg_log10_p, neg_log10_q of enriched stretches.

    Background is the larger of the genome's and that of ``local`` positions round
    a stretch; q-values are Benjamini and Hochberg's over positions.
    """
    found = tags(fragments)
    n = found.count()
    genome = max(n * extend / genome_size, 1e-9)
    depth = coverage(found, shift, extend)
    windows = found.groupBy("chrom", F.floor(F.col("pos") / local).alias("w")).agg(F.count("*").alias("n"))
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    near = depth.withColumn("w", F.explode(F.array(*(F.floor(middle / local) + k for k in (-1, 0, 1)))))
    # tags within half a window on both sides, by the share of each neighbouring window
    share = F.when(F.col("w") == F.floor(middle / local), F.lit(1.0)).otherwise(F.abs(middle / local - F.floor(middle / local) - 0.5) * (F.sign(F.col("w") - F.floor(middle / local)) == F.sign(middle / local - F.floor(middle / local) - 0.5)).cast("double"))
    lam = near.join(windows, ["chrom", "w"], "left").withColumn("x", F.coalesce("n", F.lit(0)) * share).groupBy("chrom", "start", "end", "depth").agg((F.sum("x") * extend / local).alias("lam_local"))
    scored = lam.withColumn("lam", F.round(F.greatest("lam_local", F.lit(genome)), 6)).withColumn("p", F.round(_tail("depth", "lam"), 5))
    scored = keep(scored, "scored")  # both ranked and filtered by the ranks
    over = scored.join(q_values(scored.groupBy("p").agg(F.sum(F.col("end") - F.col("start")).alias("length"))).where(F.col("q") >= -np.log10(q)), "p")
    group = _merged(keep(over, "over"), extend if max_gap is None else max_gap)
    best = F.max(F.struct("depth", "p", "q", (-F.col("start")).alias("s"), "end"))
    peaks = group.groupBy("chrom", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("b"))
    least = extend if min_length is None else min_length
    got = peaks.where(F.col("end") - F.col("start") >= least)
    return got.select("chrom", "start", "end", F.floor((-F.col("b.s") + F.col("b.end")) / 2).cast("bigint").alias("summit"), F.col("b.depth").cast("double").alias("depth"), F.col("b.p").alias("neg_log10_p"), F.col("b.q").alias("neg_log10_q"))
