"""Matrices for graph searches: peaks near a gene, curated regions, metacells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals, scores
from ..schema import require_rows
from . import counting, matrix


def harmonise(annotation: DataFrame, table: DataFrame) -> DataFrame:
    """Annotation with harmonised labels; pairs the table lacks keep their own."""
    got = annotation.join(table, ["coarse_cell_type", "fine_cell_type"], "left")
    return got.withColumns({"unmapped": F.col("harmonized_coarse").isNull(), "harmonized_coarse": F.coalesce("harmonized_coarse", "coarse_cell_type"), "harmonized_fine": F.coalesce("harmonized_fine", "fine_cell_type")})


def two_step(cells: DataFrame, samples: DataFrame, exact: Column, core: Column, default: str) -> DataFrame:
    """sample_id by exact barcode, else by core barcode, else a constant; ``samples`` is (barcode, core, sample_id)."""
    by_exact = samples.select(F.col("barcode").alias("_e"), F.col("sample_id").alias("_by_e"))
    by_core = samples.groupBy(F.col("core").alias("_c")).agg(F.min_by("sample_id", "barcode").alias("_by_c"))
    got = cells.withColumns({"_x": exact, "_y": core}).join(by_exact, F.col("_x") == F.col("_e"), "left").join(by_core, F.col("_y") == F.col("_c"), "left")
    return got.withColumn("sample_id", F.coalesce("_by_e", "_by_c", F.lit(default))).drop("_x", "_y", "_e", "_c", "_by_e", "_by_c")


def labelled(df: DataFrame, label: str, value: str, min_confidence: float) -> DataFrame:
    """Rows of one label with enough confidence; the confidence column goes by the label's name."""
    conf = "fine_confidence" if "fine" in label else "coarse_confidence"
    return df.where((F.col(label) == value) & (F.coalesce(conf, F.lit(0.0)) >= min_confidence))


def nearby_peaks(peaks: DataFrame, genes: DataFrame, window: int) -> DataFrame:
    """Peaks that overlap tss ± window of a gene, with names and signed distance; PEAK_ORDER is their order in files."""
    from .range_joins import overlap_join

    around = genes.select("chrom", F.greatest(F.col("tss") - window, F.lit(0)).alias("start"), (F.col("tss") + window).alias("end"), "gene", "tss", "strand")
    got = overlap_join(peaks, around, tile=max(1000, window))
    name = F.concat(intervals.format_name(F.col("a_chrom"), F.col("a_start"), F.col("a_end")), F.lit("__"), F.col("a_mark"))
    return got.select(
        F.col("b_gene").alias("gene"), F.col("a_mark").alias("mark"), name.alias("variable_name"), F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end"),
        intervals.signed_distance_to_tss(F.col("a_start"), F.col("a_end"), F.col("b_tss"), F.col("b_strand")).cast("bigint").alias("signed_distance_to_tss"),
    )


PEAK_ORDER = ["gene", "chrom", "start", "end", "mark"]


def curated_overlaps(peaks: DataFrame, loci: DataFrame) -> DataFrame:
    """Names of the curated regions each peak overlaps, in the order of ``pos``, and a flag."""
    from .range_joins import overlap_join

    hits = overlap_join(peaks.select("chrom", "start", "end", "variable_name", "gene"), loci.select("chrom", "start", "end", "region_name", "gene", "pos"), tile=10000).where("a_gene = b_gene")
    names = hits.groupBy("a_gene", "a_variable_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_pos", "b_region_name"))), lambda x: x["b_region_name"]), ";").alias("curated_regions"))
    got = peaks.join(names, (F.col("gene") == F.col("a_gene")) & (F.col("variable_name") == F.col("a_variable_name")), "left").drop("a_gene", "a_variable_name")
    return got.withColumns({"overlaps_curated": F.col("curated_regions").isNotNull(), "curated_regions": F.coalesce("curated_regions", F.lit(""))})


def expression(entries: DataFrame, cells: DataFrame, gene: str, target: float = 1e4) -> DataFrame:
    """Long columns expr__GENE_log1p, expr__GENE_raw_counts and libsize__rna of the cells; an unknown gene is null."""
    known = not entries.where(F.col("feature") == gene).limit(1).isEmpty()
    counts = entries.where(F.col("feature") == gene).groupBy("cell").agg(F.sum("value").alias("x"))
    got = cells.join(counting.library_sizes(entries), "cell").join(counts, "cell", "left").withColumn("x", F.coalesce("x", F.lit(0.0)) if known else F.lit(None).cast("double"))
    cols = F.array(
        F.struct(F.lit(f"expr__{gene}_log1p").alias("variable"), scores.log1p_norm(F.col("x"), F.col("library"), target).alias("value")),
        F.struct(F.lit(f"expr__{gene}_raw_counts").alias("variable"), F.col("x").alias("value")),
        F.struct(F.lit("libsize__rna").alias("variable"), F.col("library").alias("value")),
    )
    return got.select("cell", F.inline(cols))


def locus_matrix(samples: DataFrame, rna: DataFrame, gene: str, regions: DataFrame, signals: dict[str, tuple[DataFrame, DataFrame]], target: float = 1e4, mode: str = "log1p_norm") -> DataFrame:
    """Long (sample_id, variable, value) of a gene's expression, libraries and region scores.

    ``signals`` has entries and bins of each mark; samples hold cell_rna and cell_MARK.
    A cell that a matrix lacks gives null.
    """
    cells = samples.select("sample_id", F.col("cell_rna").alias("cell"))
    out = cells.join(expression(rna, cells.select("cell").distinct(), gene, target), "cell", "left").select("sample_id", "variable", "value")
    for mark, (entries, bins) in signals.items():
        own = regions.where(F.col("mark") == mark) if "mark" in regions.columns else regions
        pairs = counting.bins_of_regions(bins, own.withColumn("region", F.col("variable_name")))
        cells = samples.select("sample_id", F.col(f"cell_{mark}").alias("cell"))
        got = counting.region_scores(entries, pairs, own.select(F.col("variable_name").alias("region")), cells.select("cell").distinct(), target, mode)
        scored = got.select("cell", F.col("region").alias("variable"), F.col("score").alias("value"))
        lib = got.select("cell", F.lit(f"libsize__{mark}").alias("variable"), F.col("library").alias("value")).distinct()
        out = out.unionByName(cells.join(scored.unionByName(lib), "cell").select("sample_id", "variable", "value"))
    return out


def column_order(gene: str, marks: list[str], peaks: list[str]) -> list[str]:
    return [f"expr__{gene}_log1p", f"expr__{gene}_raw_counts", "libsize__rna", *(f"libsize__{m}" for m in marks), *peaks]


def variables(long: DataFrame) -> DataFrame:
    """variable, role, mark, chrom, start, end read off the names."""
    name = F.col("variable")
    at = intervals.parse(F.element_at(F.split(name, "__"), 1))
    role = F.when(name.startswith("libsize__"), "libsize").when(name.startswith("expr__"), "expr").otherwise("signal")
    return long.select("variable").distinct().select("variable", role.alias("role"), F.when(role != "expr", scores.peak_mark(name)).alias("mark"), at["chrom"].alias("chrom"), at["start"].alias("start"), at["end"].alias("end"))


def metadata(peaks: DataFrame, bin_lists: DataFrame, long: DataFrame) -> DataFrame:
    """Peaks with their bins and the statistics of their column."""
    stats = matrix.column_stats(long).withColumnRenamed("variable", "variable_name")
    return peaks.join(bin_lists.withColumnRenamed("region", "variable_name"), "variable_name", "left").join(stats, "variable_name", "left")


def causal_export(gene: str, rna: DataFrame, edges: DataFrame, signals: dict[str, DataFrame], assigned: DataFrame, min_rna: int = 5, min_other: int = 2) -> DataFrame:
    """Per metacell: mean expression, mean linked signal of each mark, cells of each modality, whether it passes.

    ``assigned`` is (modality_key, id, metacell); signals have (cell, feature, value) and the linked
    features of a mark are summed a cell before the mean over cells, cells without signal counting 0.
    """
    from .guidance import linked_features

    require_rows(assigned, "metacell assignments")
    counts = assigned.groupBy("metacell").agg(*(F.count_if(F.col("modality_key") == k).alias(f"n_{k}") for k in ["rna", *(f"chrom_{m}" for m in signals)]))

    def mean(entries: DataFrame, key: str, name: str) -> DataFrame:
        total = entries.groupBy("cell").agg(F.sum("value").alias("x"))
        got = assigned.where(F.col("modality_key") == key).join(total, F.col("id") == F.col("cell"), "left")
        return got.groupBy("metacell").agg(F.avg(F.coalesce("x", F.lit(0.0))).alias(name))

    out = counts.join(mean(counting.normalise(rna).where(F.col("feature") == gene), "rna", f"expr__{gene}"), "metacell", "left")
    ok = F.col("n_rna") >= min_rna
    for m, entries in signals.items():
        own = counting.normalise(entries).join(linked_features(edges, gene, m), "feature", "left_semi")
        out = out.join(mean(own, f"chrom_{m}", f"linked__{m}"), "metacell", "left")
        ok &= F.col(f"n_chrom_{m}") >= min_other
    return out.withColumn("qc_pass", ok)
