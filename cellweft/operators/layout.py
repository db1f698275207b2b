"""Positions of nodes for drawings, as tables; drawing itself is left to the reader's tools."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals, scores


def is_local(nodes: DataFrame) -> bool:
    """Whether a graph has one expression node and otherwise positioned peaks only."""
    at = intervals.parse(F.element_at(F.split("node", "__"), 1))
    kind = F.when(F.col("node").startswith("expr__"), "expr").when(at.isNotNull() & F.col("node").contains("__H3"), "peak").otherwise("other")
    n = {r.kind: r["count"] for r in nodes.select(kind.alias("kind")).groupBy("kind").count().collect()}
    return n.get("expr", 0) >= 1 and n.get("peak", 0) >= 1 and not n.get("other", 0)


def local(nodes: DataFrame) -> DataFrame:
    """x by place along the chromosome, y by mark; expression nodes above the middle."""
    at = intervals.parse(F.element_at(F.split("node", "__"), 1))
    peaks = nodes.where(~F.col("node").startswith("expr__")).select("node", scores.peak_mark(F.col("node")).alias("mark"), at["chrom"].alias("chrom"), at["start"].alias("start"))
    placed = peaks.withColumns({"x": (F.row_number().over(Window.orderBy("chrom", "start", "mark", "node")) - 1).cast("double"), "y": -F.dense_rank().over(Window.orderBy("mark")).cast("double")})
    middle = placed.agg(F.coalesce(F.max("x") / 2, F.lit(0.0)).alias("m"))
    genes = nodes.where(F.col("node").startswith("expr__")).withColumn("k", F.row_number().over(Window.orderBy("node")) - 1)
    genes = genes.join(F.broadcast(middle)).select("node", F.lit(None).cast("string").alias("mark"), (F.col("m") + F.col("k")).alias("x"), F.lit(1.0).alias("y"))
    return placed.select("node", "mark", "x", "y").unionByName(genes)


def spring(nodes: DataFrame, edges: DataFrame, steps: int = 200, seed: int = 0) -> DataFrame:
    """x and y by springs along edges and repulsion between nodes; for graphs of some hundred nodes."""
    names = [r.node for r in nodes.select("node").distinct().orderBy("node").collect()]
    place = {n: k for k, n in enumerate(names)}
    pairs = [(place[r.source], place[r.target]) for r in edges.select("source", "target").collect() if r.source in place and r.target in place]
    n = len(names)
    pos = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    k = 1 / np.sqrt(max(n, 1))
    for t in np.linspace(0.1, 0.001, steps):
        delta = pos[:, None] - pos[None]
        dist = np.maximum(np.sqrt((delta**2).sum(2)), 0.01)
        move = (delta * (k * k / dist**2 - a * dist / k)[:, :, None]).sum(1)
        length = np.maximum(np.sqrt((move**2).sum(1)), 1e-9)[:, None]
        pos += move / length * np.minimum(length, t)
    frame = pd.DataFrame({"node": names, "x": pos[:, 0], "y": pos[:, 1]})
    return nodes.sparkSession.createDataFrame(frame, "node string, x double, y double") if n else nodes.sparkSession.createDataFrame([], "node string, x double, y double")
