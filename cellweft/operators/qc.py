"""Cell quality control: counts, thresholds, clean cells and whitelist filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..recovery import keep, looked_up
from ..schema import require_rows
from ..sources.delimited import first_per


def fragment_counts(fragments: DataFrame) -> DataFrame:
    """Fragments of each barcode as spelled."""
    return fragments.groupBy("barcode").agg(F.count("*").alias("n"))


def normalized_counts(counts: DataFrame) -> DataFrame:
    """The largest count among spellings of one barcode."""
    return counts.groupBy(ids.normalize_barcode(F.col("barcode")).alias("barcode")).agg(F.max("n").alias("n"))


def cell_totals(long: DataFrame, name: str = "total") -> DataFrame:
    return long.groupBy("barcode").agg(F.sum("count").alias(name))


def shared_cells(adt: DataFrame, hto: DataFrame) -> DataFrame:
    """Normalised barcodes of both matrices with the first spelling of each, in the first one's order."""
    sides = []
    for name, df in (("adt", adt), ("hto", hto)):
        cells = df.select("barcode", "col_pos").distinct().withColumn("key", ids.normalize_barcode(F.col("barcode")))
        sides.append(first_per(cells, ["key"], ["col_pos"]).select("key", F.col("barcode").alias(f"{name}_barcode"), F.col("col_pos").alias(f"{name}_pos")))
    return sides[0].join(sides[1], "key")


def count_thresholds(adt: DataFrame, hto: DataFrame, min_adt: float, min_hto: float, required: bool = False) -> DataFrame:
    """Cells with enough of both totals; ``required`` makes none an error, at the price of a job."""
    both = cell_totals(adt, "adt_total").join(cell_totals(hto, "hto_total"), "barcode")
    got = both.where((F.col("adt_total") >= min_adt) & (F.col("hto_total") >= min_hto))
    return require_rows(got, "cells above the thresholds") if required else got


def class_flags(df: DataFrame, column: str = "hto_classification") -> DataFrame:
    return df.withColumns({f"{k.lower()}_flag": F.coalesce(F.col(column) == k, F.lit(False)) for k in ("Doublet", "Negative", "Singlet")})


def choose_class(df: DataFrame, preferred: str = "hto_classification_global", other: str = "hto_assignment") -> Column:
    return F.col(preferred) if preferred in df.columns else F.col(other)


def clean_cells(metadata: DataFrame, counts: DataFrame, min_fragments: int = 100, allow_missing_donor: bool = False) -> DataFrame:
    """Singlets of a donor with enough fragments, barcodes normalised; repeated metadata rows stay."""
    meta = metadata.withColumn("barcode", ids.normalize_barcode(F.col("barcode"))).where("barcode <> ''")
    meta = meta.where(ids.strip(F.col("hto_classification")) == "Singlet")
    if not allow_missing_donor:
        meta = meta.where(ids.donor_present(F.col("donor_id")))
    best = normalized_counts(counts).where(F.col("n") >= min_fragments).withColumnRenamed("n", "n_cuttag_fragments")
    got = meta.join(best, "barcode")
    if "singlet_flag" in got.columns:
        got = got.withColumn("singlet_flag", ids.to_bool(F.col("singlet_flag").cast("string")))
    return got.select(*metadata.columns, "n_cuttag_fragments")


def cell_order() -> list[Column]:
    """Order of clean cells in files: sinks sort by it, the operator doesn't."""
    return [F.coalesce("donor_id", F.lit("")), F.col("barcode")]


def keep_listed(df: DataFrame, whitelist: DataFrame, column: str = "barcode") -> DataFrame:
    """Rows whose normalised barcode is listed; rows themselves don't change."""
    listed = whitelist.select(F.col("barcode").alias("_listed"))
    return df.join(listed, ids.normalize_barcode(F.col(column)) == F.col("_listed"), "left_semi")


def drop_listed(df: DataFrame, whitelist: DataFrame, column: str = "barcode") -> DataFrame:
    listed = whitelist.select(F.col("barcode").alias("_listed"))
    return df.join(listed, ids.normalize_barcode(F.col(column)) == F.col("_listed"), "left_anti")


def non_empty_cells(entries: DataFrame, cell: str = "cell") -> DataFrame:
    """Entries of cells with a positive total."""
    return entries.join(entries.groupBy(cell).agg(F.sum("value").alias("_t")).where("_t > 0").select(cell), cell, "left_semi")


def finite_vectors(df: DataFrame, column: str = "emb") -> DataFrame:
    return df.where(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def filter_matrix(entries: DataFrame, min_cells: int = 0, min_features: int = 0, unique: bool = False) -> DataFrame:
    """Features in enough cells, then cells with enough of these features.

    ``unique`` says that no cell has a feature twice: then rows are counted, where else tasks hold every pair of a cell and a feature.
    Entries are stored, so what makes them runs once.
    """

    def number(of: str) -> Column:
        return F.count_if((F.col("value") > 0) & F.col(of).isNotNull()) if unique else F.count_distinct(F.when(F.col("value") > 0, F.col(of)))

    columns = entries.columns
    if min_cells or min_features:
        entries = keep(entries, "entries")
    if min_cells:
        enough = entries.groupBy("feature").agg(number("cell").alias("_n")).where(F.col("_n") >= min_cells).select("feature")
        entries = entries.join(looked_up(enough, "features"), "feature", "left_semi")
    if min_features and unique:
        # one exchange by cells, and no second table of them
        entries = entries.withColumn("_n", number("feature").over(Window.partitionBy("cell"))).where((F.col("_n") >= min_features) & F.col("cell").isNotNull()).drop("_n")
    elif min_features:
        entries = keep(entries, "entries")
        enough = entries.groupBy("cell").agg(number("feature").alias("_n")).where(F.col("_n") >= min_features).select("cell")
        entries = entries.join(enough, "cell", "left_semi")
    return entries.select(columns)


def metacell_pass(counts: DataFrame, modalities: list[str], rna: str = "rna", min_rna: int = 5, min_other: int = 2) -> DataFrame:
    """Metacells with enough cells of every modality; counts are (metacell, modality, n)."""
    sums = [F.sum(F.when(F.col("modality") == m, F.col("n")).otherwise(0)).alias(f"_{k}") for k, m in enumerate(modalities)]
    ok = reduce(lambda a, b: a & b, [F.col(f"_{k}") >= (min_rna if m == rna else min_other) for k, m in enumerate(modalities)])
    return counts.groupBy("metacell").agg(*sums).select("metacell", ok.alias("qc_pass"))


def capped_sample(df: DataFrame, group: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows a group, by hash order, so the sample is stable."""
    return first_n(df, [group], [F.xxhash64(key, F.lit(seed)), key], most)


def first_n(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
