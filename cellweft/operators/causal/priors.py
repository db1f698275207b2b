"""Background knowledge as forbidden edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import scores

MODES = ("none", "minimal_expr_sink", "tiered_distal_promoter_expr")


def rules(nodes: DataFrame, mode: str = "tiered_distal_promoter_expr") -> DataFrame:
    """rule_type, from, to, reason: expression is no parent of a histone mark, a promoter none of a distal region.

    Nodes are a graph's variables, at most some hundreds.
    """
    if mode not in MODES:
        raise ValueError(f"unknown background {mode!r}")
    role = F.col("role") if "role" in nodes.columns else scores.node_role(F.col("node"))
    known = nodes.select("node", role.alias("role"))
    a, b = known.select(F.col("node").alias("from"), F.col("role").alias("r1")), known.select(F.col("node").alias("to"), F.col("role").alias("r2"))
    histone = F.col("r2").isin("promoter", "distal") | (F.col("r2") == "other") & F.col("to").contains("__H3")
    sink = a.where("r1 = 'expr'").join(F.broadcast(b), histone).withColumn("reason", F.lit("expression_not_parent_of_histone"))
    tier = a.where("r1 = 'promoter'").join(F.broadcast(b), F.col("r2") == "distal").withColumn("reason", F.lit("promoter_not_parent_of_distal"))
    out = sink if mode == "minimal_expr_sink" else sink.unionByName(tier) if mode == MODES[2] else sink.limit(0)
    return out.select(F.lit("forbidden").alias("rule_type"), "from", "to", "reason")


def forbidden(rule_table: DataFrame, names: list[str]) -> set[tuple[int, int]]:
    """Index pairs (from, to) that may not be edges."""
    place = {n: k for k, n in enumerate(names)}
    return {(place[r["from"]], place[r["to"]]) for r in rule_table.collect() if r["from"] in place and r["to"] in place}
