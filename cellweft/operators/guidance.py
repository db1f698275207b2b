"""Genes, regions and the guidance graph between genes and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, intervals
from ..sources.delimited import first_per
from .places import numbered
from .range_joins import center_tss_join, nearest_k, window_join

#: Sign, window, decay and alpha of each mark on the graph track.
MARK_DEFAULTS = {
    "H3K27ac": (1, 150_000, 75_000.0, 1.0),
    "H3K4me1": (1, 150_000, 75_000.0, 1.0),
    "H3K4me2": (1, 150_000, 75_000.0, 1.0),
    "H3K4me3": (1, 150_000, 75_000.0, 1.0),
    "H3K27me3": (-1, 500_000, 200_000.0, 0.7),
    "H3K9me3": (-1, 500_000, 200_000.0, 0.7),
}
#: Window and decay where the shared gene track differs.
SHARED_GENE_DEFAULTS = {"H3K4me3": (25_000, 10_000.0)}


def mark_defaults(mark: str, track: str = "graph") -> tuple[int, int, float, float]:
    """Sign, window, decay and alpha; unknown marks act like open chromatin."""
    sign, window, decay, alpha = MARK_DEFAULTS.get(mark, (1, 150_000, 75_000.0, 1.0))
    if track == "shared_gene":
        window, decay = SHARED_GENE_DEFAULTS.get(mark, (window, decay))
        alpha = 1.0
    return sign, window, decay, alpha


def tss_table(gtf: DataFrame, gene_types: list[str] | None = None, chrom_mode: str = "keep") -> DataFrame:
    """chrom, tss, gene_name, gene_id, strand of the first gene record of each id."""
    genes = gtf.where("feature = 'gene' and gene_id is not null")
    if gene_types:
        genes = genes.where(F.col("gene_type").isin(*gene_types))
    genes = genes.withColumn("gene_id", ids.trim_version(F.col("gene_id"))).withColumn("_line", F.monotonically_increasing_id())
    genes = first_per(genes, ["gene_id"], ["_line"])
    got = genes.select(intervals.normalize_chrom(F.col("chrom"), chrom_mode).alias("chrom"), intervals.tss_of(F.col("start"), F.col("end"), F.col("strand")).alias("tss"), F.coalesce("gene_name", "gene_id").alias("gene_name"), "gene_id", "strand")
    return got.orderBy("chrom", "tss", "gene_name")


def coordinates(gtf: DataFrame) -> DataFrame:
    """0-based half-open body of each gene id: its first gene record, else its first transcript."""
    rows = gtf.where("feature in ('gene', 'transcript') and gene_id is not null and strand in ('+', '-')")
    rows = rows.withColumn("gene_id", ids.trim_version(F.col("gene_id"))).withColumn("_line", F.monotonically_increasing_id())
    rows = first_per(rows, ["gene_id"], [F.when(F.col("feature") == "gene", 0).otherwise(1), "_line"])
    return rows.select("chrom", (F.col("start") - 1).alias("start"), "end", "strand", F.coalesce("gene_name", "gene_id").alias("gene_name"), "gene_id").where("end > start")


def map_genes(features: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes of RNA features by name or by trimmed id, whichever maps more; names win ties; first record of a gene."""
    by_name = features.join(genes, features.feature == genes.gene_name).drop("feature").withColumn("rna_gene", F.col("gene_name"))
    by_id = features.join(genes, ids.trim_version(F.col("feature")) == ids.trim_version(F.col("gene_id"))).withColumn("rna_gene", F.col("feature")).drop("feature")
    n_name, n_id = (d.select("rna_gene").distinct().count() for d in (by_name, by_id))
    best = by_name if n_name >= n_id else by_id
    return first_per(best, ["rna_gene"], ["chrom", "start", "end", "gene_id"])


def regions(genes: DataFrame, kind: str = "combined", promoter: int = 2000) -> DataFrame:
    """chrom, start, end, gene: the stretch that bins are linked with."""
    got = genes.withColumn("_r", intervals.gene_region(F.col("start"), F.col("end"), F.col("strand"), kind, promoter)).where("_r is not null")
    return got.select("chrom", F.col("_r.start").alias("start"), F.col("_r.end").alias("end"), F.col("gene_name").alias("gene"), "strand")


def links(bins: DataFrame, gene_regions: DataFrame, mark: str, window: int, mode: str = "exp", alpha: float = 1.0, decay: float = 20000.0, k: int = 0) -> DataFrame:
    """feature, gene, distance, weight, mark of bins near genes; at most k nearest genes a bin if k > 0."""
    pairs = window_join(gene_regions.select("chrom", "start", "end", "gene"), bins.select("chrom", "start", "end", "name"), window)
    got = pairs.select(F.col("b_name").alias("feature"), F.col("a_gene").alias("gene"), F.abs("distance").alias("distance"))
    got = nearest_k(got, ["feature"], k, ["distance", "gene"])
    return got.withColumns({"weight": intervals.edge_weight(F.col("distance"), mode, alpha, decay), "mark": F.lit(mark)})


def pilot_links(bins: DataFrame, tss: DataFrame, mark: str, window: int, mode: str = "exp", alpha: float = 1.0, decay: float = 20000.0, k: int = 0) -> DataFrame:
    """As ``links``, by the distance of a bin's centre to the transcription start."""
    pairs = center_tss_join(bins.select("chrom", "start", "end", "name"), tss.select("chrom", "tss", "gene_name"), window)
    got = pairs.select(F.col("a_name").alias("feature"), F.col("b_gene_name").alias("gene"), "distance")
    got = nearest_k(got, ["feature"], k, ["distance", "gene"])
    return got.withColumns({"weight": intervals.edge_weight(F.col("distance"), mode, alpha, decay), "mark": F.lit(mark)})


def edges(found: DataFrame, signs: dict[str, int], bins: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene to bin, bin to gene, and a loop for every bin of every mark and for every gene once.

    ``found`` is (feature, gene, distance, weight, mark), ``bins`` (feature, mark), ``genes`` (gene).
    """
    sign = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in signs.items() for x in p)), F.col("mark")), F.lit(1)) if signs else F.lit(1)
    base = found.withColumn("sign", sign.cast("int")).withColumn("distance_bp", F.col("distance").cast("bigint"))

    def edge(source, target, kind):
        return base.select(F.col(source).alias("source"), F.col(target).alias("target"), "weight", "sign", "distance_bp", "mark", F.lit(kind).alias("type"))

    def loop(df, name, mark):
        return df.select(F.col(name).alias("source"), F.col(name).alias("target"), F.lit(1.0).alias("weight"), F.lit(1).alias("sign"), F.lit(0).cast("bigint").alias("distance_bp"), F.lit("self").alias("mark"), F.lit("loop").alias("type"), mark.alias("_m"))

    loops = loop(bins.select("feature", "mark").distinct(), "feature", F.col("mark")).unionByName(loop(genes.select("gene").distinct(), "gene", F.lit("")))
    return edge("gene", "feature", "fwd").unionByName(edge("feature", "gene", "rev")).unionByName(loops.drop("_m"))


def nodes(edge_table: DataFrame, genes: DataFrame, bins: DataFrame) -> DataFrame:
    """node, node_type, modality, mark of everything in the graph."""
    g = genes.select(F.col("gene").alias("node"), F.lit("gene").alias("node_type"), F.lit("rna").alias("modality"), F.lit("").alias("mark")).distinct()
    b = bins.select(F.col("feature").alias("node"), F.lit("chromatin").alias("node_type"), F.concat(F.lit("chrom_"), F.col("mark")).alias("modality"), "mark").distinct()
    used = edge_table.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return g.unionByName(b).join(used, "node", "left_semi")


def graph_stats(edge_table: DataFrame) -> DataFrame:
    """Edges, connected genes and connected bins of each mark."""
    fwd = edge_table.where("type = 'fwd'")
    return fwd.groupBy("mark").agg(F.count("*").alias("n_links"), F.count_distinct("source").alias("n_genes"), F.count_distinct("target").alias("n_bins"))


def link_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("mark").agg(F.count("*").alias("n_pairs"), F.count_distinct("feature").alias("n_peaks"), F.count_distinct("gene").alias("n_genes"))


def linked_features(edge_table: DataFrame, gene: str, mark: str) -> DataFrame:
    """Features joined with a gene in a mark by an edge either way."""
    own = edge_table.where((F.col("mark") == mark) & (F.col("type") != "loop"))
    fwd = own.where(F.col("source") == gene).select(F.col("target").alias("feature"))
    return fwd.union(own.where(F.col("target") == gene).select(F.col("source").alias("feature"))).distinct().orderBy("feature")


def subgraph(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    n = node_table.select(F.col("node").alias("source"))
    return edge_table.join(n, "source", "left_semi").join(n.withColumnRenamed("source", "target"), "target", "left_semi").select(edge_table.columns)


def universe(rna: DataFrame, genes: DataFrame, found: DataFrame, mode: str = "union_linked") -> DataFrame:
    """Genes of the shared feature space in order of position: feature_id, gene_name, gene_id, present_in_rna, gene_index.

    ``rna`` is (feature, gene_id): RNA features and the gene they map to.  A gene's
    feature id is its RNA feature, else the first unused of name, id, name and id.
    """
    if mode not in ("rna", "union_linked", "gtf_all"):
        raise ValueError(f"unknown universe {mode!r}")
    all_ = genes.join(rna.select(F.col("feature").alias("rna_gene"), "gene_id").dropDuplicates(["gene_id"]), "gene_id", "left").withColumn("present_in_rna", F.col("rna_gene").isNotNull())
    if mode == "rna":
        all_ = all_.where("present_in_rna")
    elif mode == "union_linked":
        linked = found.select(F.col("gene").alias("gene_name")).distinct().withColumn("_linked", F.lit(True))
        all_ = all_.join(linked, "gene_name", "left").where("present_in_rna or _linked").drop("_linked")
    rows = [r.asDict() for r in all_.orderBy("chrom", "start", "gene_name", "gene_id").select("gene_id", "gene_name", "rna_gene", "present_in_rna", "chrom", "start", "end", "strand").toLocalIterator()]
    used = {r["rna_gene"] for r in rows if r["rna_gene"]}
    for k, r in enumerate(rows):
        r["gene_index"] = k
        r["feature_id"] = r["rna_gene"]
        if not r["feature_id"]:
            wanted = [r["gene_name"], ids_trim(r["gene_id"]), r["gene_id"], f"{r['gene_name']}_{r['gene_id']}", f"gene_{k}"]
            base = next((w for w in wanted if w and w not in used), wanted[-1])
            name, n = base, 1
            while name in used:
                name, n = f"{base}_{n}", n + 1
            r["feature_id"] = name
            used.add(name)
    return genes.sparkSession.createDataFrame(rows, "gene_id string, gene_name string, rna_gene string, present_in_rna boolean, chrom string, start bigint, end bigint, strand string, gene_index int, feature_id string")


def ids_trim(gene_id: str | None) -> str:
    head, _, tail = (gene_id or "").rpartition(".")
    return head if tail.isdigit() and head else gene_id or ""


def availability(target: DataFrame, found: DataFrame) -> DataFrame:
    """Whether each feature has a link at all, and how many peaks."""
    n = found.groupBy("gene").agg(F.count_distinct("feature").alias("n_peak_links"))
    got = target.join(n, target.feature == n.gene, "left")
    return got.select("feature", F.col("gene").isNotNull().cast("int").alias("feature_available"), F.coalesce("n_peak_links", F.lit(0)).cast("int").alias("n_peak_links"))


def indexed(names: DataFrame, order: list[str]) -> DataFrame:
    """0-based places in the defining order, for tables of features."""
    return numbered(names, order).withColumn("idx", F.col("idx").cast("int"))
