"""Labels and colours of graph nodes, as columns beside the positions of ``operators/layout.py``."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import intervals, scores

# Short labels of curated regions and colours of marks, as drawings show them.
REGION_LABELS = {
    "promoter_primary_tss": "promoter",
    "promoter_e1_alt": "promoter E1",
    "fire_curated": "FIRE",
    "fire_5prime": "FIRE 5p",
    "fire_core": "FIRE core",
    "fire_3prime": "FIRE 3p",
    "enhancer_e1_hmgxb3_3prime": "e1",
    "enhancer_e2_intragenic": "e2",
    "enhancer_e3_intragenic": "e3",
    "enhancer_e4_fire_proximal": "e4",
    "enhancer_e5_fire": "e5/FIRE",
    "ltr_csf1r_promoter": "LTR",
    "ure_minus14kb": "URE -14kb",
    "enhancer_plus42kb": "enhancer +42kb",
    "enhancer_minus50kb_monocyte": "enhancer -50kb",
    "enhancer_downstream20kb_site1": "enhancer +20kb A",
    "enhancer_downstream20kb_site2": "enhancer +20kb B",
    "enhancer_downstream20kb_site3": "enhancer +20kb C",
    "enhancer_region6_downstream20kb": "region 6",
    "enhancer_region7_downstream20kb": "region 7",
    "enhancer_region8_downstream20kb": "region 8",
}
MARK_COLORS = {
    "H3K27ac": "#e76f51",
    "H3K27me3": "#6d597a",
    "H3K4me1": "#2a9d8f",
    "H3K4me2": "#457b9d",
    "H3K4me3": "#1d3557",
    "H3K9me3": "#8d99ae",
}
OTHER_MARK, OTHER_NODE, GENE_NODE = "#8ecae6", "#d3d3d3", "#f4a261"
GENE_OUTLINE, CURATED_OUTLINE, PLAIN_OUTLINE = "#9c4221", "#d7263d", "#264653"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def _after(node: Column) -> Column:
    """What follows the first ``__``."""
    return F.regexp_extract(node, r"(?s)^.*?__(.*)$", 1)


def _at(node: Column) -> Column:
    """Place of a node ``chr:start-end__MARK``, null for other nodes."""
    return F.when(_after(node) != "", intervals.parse(F.regexp_extract(node, "^(.*?)__", 1)))


def region_label(region: Column) -> Column:
    """Short label of a curated region; other names with spaces for underscores."""
    return F.coalesce(_lookup(REGION_LABELS, region), F.replace(region, F.lit("_"), F.lit(" ")))


def node_label(node: Column) -> Column:
    """Two lines: ``expr`` and gene, or region and mark; names of one part as they are."""
    region = F.regexp_extract(node, r"(?s)^(.*?)__", 1)
    return F.when(node.startswith("expr__"), F.concat(F.lit("expr\n"), _after(node))).when(node.contains("__"), F.concat(region_label(region), F.lit("\n"), _after(node))).otherwise(node)


def local_label(node: Column, curated: Column, distance: Column) -> Column:
    """Gene, or mark with the first of the ``;``-joined curated regions, else the distance to the tss in kb, else the
    centre in Mb.  Figures round half to even."""
    at = _at(node)
    first = F.get(F.filter(F.transform(F.split(F.coalesce(curated, F.lit("")), ";"), F.trim), lambda x: x != ""), F.lit(0))
    kb = F.format_string("%+.1f kb", F.bround(distance.cast("double") / 1000, 1))
    mb = F.format_string("%.3f Mb", F.bround((at["start"] + at["end"]) / 2e6, 3))
    where = F.when(first.isNotNull(), region_label(first)).when(distance.isNotNull() & ~F.isnan(distance.cast("double")), kb).otherwise(mb)
    return F.when(node.startswith("expr__"), _after(node)).when(at.isNull(), F.replace(node, F.lit("__"), F.lit("\n"))).otherwise(F.concat(scores.peak_mark(node), F.lit("\n"), where))


def node_color(node: Column) -> Column:
    mark = F.coalesce(_lookup(MARK_COLORS, scores.peak_mark(node)), F.lit(OTHER_MARK))
    return F.when(node.startswith("expr__"), GENE_NODE).when(_at(node).isNull(), OTHER_NODE).otherwise(mark)


def outline_color(node: Column, curated: Column) -> Column:
    """``curated`` says whether the node overlaps a curated region; null is no."""
    return F.when(node.startswith("expr__"), GENE_OUTLINE).when(F.coalesce(curated, F.lit(False)), CURATED_OUTLINE).otherwise(PLAIN_OUTLINE)
