"""From count matrices and fragments to clean cells and their sparse matrices."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counting, demux, peaks, qc
from ..sinks import tables
from ..sources import delimited


@dataclass
class CleanData:
    counts: DataFrame
    cells: DataFrame
    fragments: DataFrame
    peaks: DataFrame
    peak_counts: DataFrame
    bins: DataFrame
    bin_counts: DataFrame


def metadata_of(adt: DataFrame, hto: DataFrame, min_adt: float = 1, min_hto: float = 1, quantile: float = 0.99) -> DataFrame:
    """Demultiplexed cells that both matrices have, with totals."""
    both = qc.shared_cells(adt, hto)
    totals = qc.count_thresholds(adt.join(both.select(F.col("adt_barcode").alias("barcode"), "key"), "barcode").withColumn("barcode", F.col("key")), hto.join(both.select(F.col("hto_barcode").alias("barcode"), "key"), "barcode").withColumn("barcode", F.col("key")), min_adt, min_hto, required=True)
    kept = hto.join(both.select(F.col("hto_barcode").alias("barcode"), "key"), "barcode").withColumn("barcode", F.col("key")).join(totals.select("barcode"), "barcode", "left_semi")
    return totals.join(demux.demux(kept.select("feature", "barcode", "count"), quantile), "barcode")


def clean(fragments: DataFrame, metadata: DataFrame, sizes: DataFrame, called: DataFrame | None = None, min_fragments: int = 100, bin_size: int = 5000, q: float = 0.01, genome_size: float | None = None) -> CleanData:
    """Counts, clean cells, their fragments, peaks (called if not given) and both matrices."""
    counts = qc.fragment_counts(fragments)
    cells = qc.clean_cells(metadata, counts, min_fragments)
    kept = qc.keep_listed(fragments, cells.select("barcode")).withColumn("barcode", delimited.ids.normalize_barcode(F.col("barcode")))
    if called is None:
        size = genome_size or float(sizes.agg(F.sum("size")).first()[0])
        called = peaks.call(kept, size, q)
        called = called.withColumn("name", F.concat_ws("_", F.lit("peak"), "chrom", "start"))
    return CleanData(counts, cells, kept, called, counting.peak_counts(kept, called), counting.bin_universe(sizes, bin_size), counting.bin_counts(kept, bin_size, sizes))


def write(data: CleanData, prefix: str | Path) -> dict:
    """All files of a run under a prefix; returns the summary that is written too."""
    n = tables.write_tsv(data.cells, f"{prefix}_clean_cells.tsv", qc.cell_order())
    tables.write_tsv(data.cells.select("barcode"), f"{prefix}_clean_barcodes.tsv", ["barcode"])
    tables.write_counts(data.counts, f"{prefix}_fragment_counts.tsv")
    tables.write_tsv(tables.bed4(data.bins), f"{prefix}_bins.bed", ["chrom", "start"], header=False)
    out = {"clean_cells": n}
    for name, entries, features in (("chromatin", data.peak_counts, data.peaks.select("name")), ("bin_chromatin", data.bin_counts, data.bins.select("name"))):
        cells = tables.index_names(data.cells, "barcode")
        cols = tables.index_names(features, "name")
        placed = entries.join(cells.select(F.col("idx").alias("row_idx"), F.col("name").alias("cell")), "cell").join(cols.select(F.col("idx").alias("col_idx"), F.col("name").alias("feature")), "feature")
        out[name] = tables.write_mtx(placed, cells, cols, f"{prefix}_{name}_clean")
    tables.write_json(out, f"{prefix}_summary.json")
    return out


def run(spark: SparkSession, adt: str, hto: str, fragments: str, sizes: str, prefix: str, peaks_bed: str | None = None, **options) -> dict:
    """The chain over files."""
    meta = metadata_of(delimited.numeric_matrix(spark, adt), delimited.numeric_matrix(spark, hto))
    called = delimited.bed(spark, peaks_bed) if peaks_bed else None
    return write(clean(delimited.fragments(spark, fragments), meta, delimited.chrom_sizes(spark, sizes), called, **options), prefix)
