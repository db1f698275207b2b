"""External evidence for the nodes and edges of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals, scores
from .places import numbered_within
from .range_joins import overlap_join


def nodes(names: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """node, gene, chrom, start, end of graph nodes: coordinates from the name, else from a curated region."""
    head = F.regexp_extract("node", r"^(.*?)(?:__.*)?$", 1)
    got = names.select("node", scores.node_role(F.col("node")).alias("role"), head.alias("_head"), intervals.parse(head).alias("_at"))
    got = got.withColumn("gene", F.when(F.col("role") == "expr", scores.gene_base_name(F.col("node"))))
    if loci is not None:
        known = loci.groupBy(F.col("region_name").alias("_head")).agg(F.first(F.struct("chrom", "start", "end")).alias("_known"))
        got = got.join(known, "_head", "left").withColumn("_at", F.coalesce("_at", "_known"))
    return got.select("node", "role", "gene", F.col("_at.chrom").alias("chrom"), F.col("_at.start").alias("start"), F.col("_at.end").alias("end"))


def matches(graph_nodes: DataFrame, evidence: DataFrame, min_overlap: int = 1) -> DataFrame:
    """Node and evidence pairs: expression by gene, regions by overlap."""
    cols = ["source", "support_label", "external_id", "biosample", "notes"]
    expr = graph_nodes.where("role = 'expr' and gene is not null and gene <> ''")
    by_gene = expr.join(evidence.where("gene <> ''").withColumn("_g", F.upper("gene")).select("_g", *cols), F.upper("gene") == F.col("_g")).select("node", F.lit("gene").alias("match_type"), *cols)
    regions = graph_nodes.where("role <> 'expr' and chrom is not null").select("node", "chrom", "start", "end")
    hits = overlap_join(regions, evidence.select("chrom", "start", "end", *cols), min_overlap, tile=10000)
    return by_gene.unionByName(hits.select(F.col("a_node").alias("node"), F.lit("overlap").alias("match_type"), *(F.col(f"b_{c}").alias(c) for c in cols)))


def joined_set(column: str, sep: str = "|") -> Column:
    """Distinct non-empty values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.col(column) != "", F.col(column)))), sep)


def summary(graph_nodes: DataFrame, found: DataFrame, one: str, other: str) -> DataFrame:
    """One row a node with what supports it; nodes without evidence have 0 matches."""
    got = found.groupBy("node").agg(
        F.count("*").alias("n_matches"), joined_set("source").alias("sources"), joined_set("support_label").alias("labels"), joined_set("external_id").alias("external_ids"), joined_set("biosample").alias("biosamples"), joined_set("notes", " | ").alias("notes"), F.collect_set("source").alias("_s")
    )
    has_a, has_b = F.array_contains("_s", one), F.array_contains("_s", other)
    kind = F.when(F.col("_s").isNull() | (F.size("_s") == 0), "none").when(has_a & has_b, "both").when(has_a, one).when(has_b, other).otherwise("other")
    text = {c: F.coalesce(c, F.lit("")) for c in ("sources", "labels", "external_ids", "biosamples", "notes")}
    return graph_nodes.join(got, "node", "left").withColumn("highlight", kind).withColumns({"n_matches": F.coalesce("n_matches", F.lit(0).cast("bigint")), **text}).drop("_s")


def plot_edges(edges: DataFrame, gene_node: str, curated: DataFrame, most: int = 30) -> DataFrame:
    """The edges to draw: those at the gene first, then at curated nodes, then by kind, then by text."""
    flags = curated.select(F.col("node").alias("_n"))
    one = edges.join(flags.withColumnRenamed("_n", "node1").withColumn("_c1", F.lit(1)), "node1", "left").join(flags.withColumnRenamed("_n", "node2").withColumn("_c2", F.lit(1)), "node2", "left")
    touches = ((F.col("node1") == gene_node) | (F.col("node2") == gene_node)).cast("int")
    over = F.greatest(F.coalesce("_c1", F.lit(0)), F.coalesce("_c2", F.lit(0)))
    kind = scores.edge_kind(F.col("endpoint1"), F.col("endpoint2"))
    rank = F.when(kind == "directed", 2).when(kind == "partial", 1).otherwise(0)
    got = one.withColumns({"touches_gene": touches, "touches_curated": over, "kind_score": rank}).drop("_c1", "_c2")
    return got.orderBy(F.desc("touches_gene"), F.desc("touches_curated"), F.desc("kind_score"), F.desc("edge_text")).limit(most)


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared undirected edges over all."""

    def pairs(df):
        return df.select(F.least("node1", "node2").alias("x"), F.greatest("node1", "node2").alias("y")).distinct()

    both = pairs(a).withColumn("_a", F.lit(1)).join(pairs(b).withColumn("_b", F.lit(1)), ["x", "y"], "full")
    shared = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(shared.alias("shared"), F.count("*").alias("total"), (shared / F.count("*")).alias("jaccard"))


def orientation_stability(runs: DataFrame) -> DataFrame:
    """Of each edge over runs (run, source, target): how often found, and the share of its commoner direction."""
    forward = F.col("source") < F.col("target")
    got = runs.select("run", F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"), forward.alias("f")).groupBy("x", "y").agg(F.count_distinct("run").alias("n_runs"), F.count("*").alias("n"), F.count_if("f").alias("n_forward"))
    return got.withColumn("stability", F.greatest("n_forward", F.col("n") - F.col("n_forward")) / F.col("n"))


def permuted_pairs(samples: DataFrame, column: str, within: str, seed: int = 0) -> DataFrame:
    """A null pairing: ``column`` is dealt anew among the rows of one ``within`` group."""
    a = numbered_within(samples, within, ["sample_id"], "_k")
    dealt = samples.select(F.col(within).alias("_w"), F.col(column).alias("_v"), F.col("sample_id").alias("_s"))
    b = numbered_within(dealt, "_w", [F.xxhash64("_s", F.lit(seed)), "_s"], "_j")
    return a.join(b, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_k") == F.col("_j"))).withColumn(column, F.col("_v")).select(*samples.columns)


def shifted_regions(regions: DataFrame, sizes: DataFrame, shift: int) -> DataFrame:
    """A null of regions: each moved by ``shift`` round its chromosome."""
    length = F.col("end") - F.col("start")
    got = regions.join(sizes, "chrom")
    start = F.pmod(F.col("start") + shift, F.greatest(F.col("size") - length, F.lit(1)))
    return got.withColumn("_len", length).withColumn("start", start).withColumn("end", F.col("start") + F.col("_len")).drop("_len", "size")
