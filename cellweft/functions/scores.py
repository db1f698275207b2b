"""Normalisations, offsets and the names of graph nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p_norm(x: Column, library: Column, target: float = 1e4) -> Column:
    """log1p(x * target / library); an empty library gives 0."""
    return F.when(library > 0, F.log1p(x * F.lit(target) / library)).otherwise(F.lit(0.0))


def region_score(total: Column, n_bins: Column, library: Column, target: float = 1e4, mode: str = "log1p_norm") -> Column:
    """Score of a region: null without bins; an empty library counts as 1."""
    if mode == "raw_counts":
        score = total.cast("double")
    elif mode == "log1p_norm":
        score = F.log1p(total / n_bins * F.lit(target) / F.when(library > 0, library).otherwise(F.lit(1.0)))
    else:
        raise ValueError(f"unknown quantification {mode!r}")
    return F.when(n_bins > 0, score)


def tf_idf(x: Column, row_sum: Column, n_cells: Column, cells_with: Column) -> Column:
    return F.when(row_sum > 0, x / row_sum).otherwise(F.lit(0.0)) * F.log1p(n_cells / cells_with)


def standardise(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def clip(x: Column, most: float) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most))


def binarise(x: Column, threshold: float = 0.0) -> Column:
    return (x > threshold).cast("double")


def count_offset(library: Column) -> Column:
    return F.log(F.greatest(library.cast("double"), F.lit(1.0)))


def node_role(name: Column) -> Column:
    """Role of a graph node by its name: expr, promoter, distal or other."""
    region = F.lower(F.element_at(F.split(name, "__"), 1))
    return (
        F.when(name.startswith("expr__"), "expr")
        .when(~name.contains("__H3"), "other")
        .when(region.contains("promoter"), "promoter")
        .when(region.rlike("enhancer|fire|^ure"), "distal")
        .otherwise("other")
    )


def peak_mark(column: Column) -> Column:
    return F.element_at(F.split(column, "__"), -1)


def gene_base_name(column: Column) -> Column:
    """Gene of an expression column ``expr__GENE_log1p`` or ``expr__GENE_raw_counts``."""
    return F.regexp_replace(F.regexp_replace(column, "^expr__", ""), "_(log1p|raw_counts)$", "")


def endpoint_symbol(endpoint: Column, left: bool = False) -> Column:
    return F.when(endpoint == "TAIL", "-").when(endpoint == "ARROW", "<" if left else ">").when(endpoint == "CIRCLE", "o").otherwise("?")


def edge_text(node1: Column, end1: Column, node2: Column, end2: Column) -> Column:
    return F.concat(node1, F.lit(" "), endpoint_symbol(end1, True), F.lit("-"), endpoint_symbol(end2), F.lit(" "), node2)


def edge_kind(end1: Column, end2: Column) -> Column:
    """undirected, directed or partial."""
    return F.when((end1 == "TAIL") & (end2 == "TAIL"), "undirected").when((end1 == "TAIL") & (end2 == "ARROW") | (end1 == "ARROW") & (end2 == "TAIL"), "directed").otherwise("partial")


def edge_source(node1: Column, end1: Column, node2: Column, end2: Column) -> Column:
    """Node a directed edge leaves, null for other edges."""
    return F.when((end1 == "TAIL") & (end2 == "ARROW"), node1).when((end1 == "ARROW") & (end2 == "TAIL"), node2)


def edge_width(abs_weight: Column, base: float = 2.0, scale: float = 3.0) -> Column:
    return F.lit(base) + F.lit(scale) * F.greatest(F.coalesce(abs_weight.cast("double"), F.lit(0.0)), F.lit(0.0))
