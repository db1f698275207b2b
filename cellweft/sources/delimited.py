"""Line formats: fragments, BED, GTF, sizes, counts, matrices, panels and manifests.

Every reader has an explicit schema or a set of required columns; rows that the
format says to skip are filters, so they run in the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, intervals
from ..schema import BED4, FRAGMENTS, GTF, NARROW_PEAK, SchemaError, require_columns, require_rows, require_unique


def tsv(spark: SparkSession, path: str | list[str], required: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A table with a header; all columns are strings."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote="")
    return require_columns(df, required or [], str(path))


def fragments(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """Fragments; comments and rows of under four fields are skipped.

    A gzip file is one task's to read, so large inputs should be dealt out with
    ``partitions``.
    """
    df = spark.read.csv(path, sep="\t", comment="#", schema=FRAGMENTS, mode="PERMISSIVE", quote="").where("barcode is not null")
    return df.repartition(partitions) if partitions else df


def fragment_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Verbatim lines with their barcode, for filters that must not change a line."""
    df = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    return df.select("value", F.get(parts, F.lit(3)).alias("barcode")).where("barcode is not null")


def fragment_counts(spark: SparkSession, path: str) -> DataFrame:
    """barcode and n of a count table; rows whose count is no number are skipped."""
    df = tsv(spark, path, ["barcode"])
    name = next((c for c in ("n_cuttag_fragments", "n_fragments") if c in df.columns), None)
    if name is None:
        raise SchemaError(f"{path} has no fragment count column")
    return df.select("barcode", ids.int_of_text(F.col(name)).alias("n")).where("n is not null")


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom and size; bad and non-positive sizes are skipped, the last of repeated names holds."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).where(~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    rows = lines.select(F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("bigint").alias("size"), "line").where("size > 0")
    return require_rows(rows.groupBy("chrom").agg(F.max_by("size", "line").alias("size")), path)


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised barcodes."""
    df = tsv(spark, path, ["barcode"]).select(ids.normalize_barcode(F.col("barcode")).alias("barcode"))
    return df.where("barcode <> ''").distinct()


def expanded_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return require_rows(expand_barcodes(tsv(spark, path, ["barcode"])), path)


def expand_barcodes(df: DataFrame) -> DataFrame:
    """Every spelling of each barcode, once."""
    return df.where(ids.strip(F.col("barcode")) != "").select(F.explode(ids.barcode_variants(ids.strip(F.col("barcode")))).alias("barcode")).distinct()


def bed(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    df = spark.read.csv(path, sep="\t", comment="#", schema=BED4, quote="").where("end is not null")
    return df if mark is None else df.withColumn("mark", F.lit(mark))


def narrow_peaks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=NARROW_PEAK, quote="").where("end is not null")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF records with gene_id and gene_name taken from the attributes."""
    df = spark.read.csv(path, sep="\t", comment="#", schema=GTF, quote="").where("attributes is not null")
    return df.withColumns({k: intervals.gtf_attribute(F.col("attributes"), k) for k in ("gene_id", "gene_name", "gene_type")})


def _order(df: DataFrame) -> DataFrame:
    return df.withColumn("_line", F.monotonically_increasing_id())


def first_per(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def sample_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and barcode of a table without header; the first line of a barcode holds."""
    df = _order(spark.read.csv(path, schema="sample_id string, barcode string", quote="").where("barcode is not null"))
    return first_per(df, ["barcode"], ["_line"]).drop("_line")


def named_column(df: DataFrame, preferred: str) -> DataFrame:
    """The preferred column, else the first."""
    return df.select(F.col(f"`{preferred if preferred in df.columns else df.columns[0]}`").alias(preferred))


def manifest_row(manifest: DataFrame, mark: str) -> dict[str, str]:
    row = manifest.where(F.col("mark") == mark).limit(1).collect()
    if not row:
        raise SchemaError(f"mark {mark!r} is not in the manifest")
    return row[0].asDict()


def parse_marks(manifest: DataFrame, marks: str) -> list[str]:
    """Comma-separated marks in order, once each; all must be in the manifest."""
    wanted = list(dict.fromkeys(m.strip() for m in marks.split(",") if m.strip()))
    known = {r.mark for r in manifest.select("mark").where(F.col("mark").isin(*wanted)).distinct().collect()} if wanted else set()
    missing = [m for m in wanted if m not in known]
    if missing:
        raise SchemaError(f"marks not in the manifest: {', '.join(missing)}")
    return wanted


def gene_panel(spark: SparkSession, path: str, cell_type: str | None = "monocyte") -> DataFrame:
    df = tsv(spark, path, ["gene", "chrom", "tss", "strand", "cell_type", "curated_locus_config"]).withColumn("tss", F.col("tss").cast("bigint"))
    if cell_type and not df.where(F.col("cell_type") != cell_type).isEmpty():
        raise SchemaError(f"{path} has cells other than {cell_type}")
    return require_unique(df, ["gene"], path)


def panel_genes(spark: SparkSession, path: str) -> list[str]:
    return [r.gene for r in tsv(spark, path, ["gene"]).select(ids.strip(F.col("gene")).alias("gene")).where("gene <> ''").collect()]


LOCUS_COLUMNS = ["locus_id", "gene", "chrom", "start", "end", "strand", "region_name", "region_type"]


def curated_loci(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Curated regions; a locus belongs to one gene."""
    df = tsv(spark, path, LOCUS_COLUMNS).withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})
    mixed = df.groupBy("locus_id").agg(F.count_distinct("gene").alias("n")).where("n > 1").limit(3).collect()
    if mixed:
        raise SchemaError("loci with more than one gene: " + ", ".join(r.locus_id for r in mixed))
    return df


def evidence(spark: SparkSession, path: str, source: str) -> DataFrame:
    """External support regions; optional columns are empty strings."""
    df = tsv(spark, path, ["chrom", "start", "end"])
    for c in ("gene", "support_label", "external_id", "biosample", "notes"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit(""))
    return df.withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint"), "source": F.lit(source)})


def harmonisation(spark: SparkSession, path: str) -> DataFrame:
    df = tsv(spark, path, ["coarse_cell_type", "fine_cell_type", "harmonized_coarse", "harmonized_fine"])
    return require_unique(df, ["coarse_cell_type", "fine_cell_type"], path)


def gene_coordinates(df: DataFrame) -> DataFrame:
    """gene_name, gene_id, chrom, start, end, strand from coordinates, or 1 bp intervals from a TSS."""
    if {"chromStart", "chromEnd"} <= set(df.columns):
        span = (F.col("chromStart").cast("bigint"), F.col("chromEnd").cast("bigint"))
    elif "tss" in df.columns:
        span = (F.col("tss").cast("bigint"), F.col("tss").cast("bigint") + 1)
    else:
        raise SchemaError("gene table has neither chromStart and chromEnd nor tss")
    require_columns(df, ["chrom", "strand", "gene_name"], "gene table")
    gene_id = F.col("gene_id") if "gene_id" in df.columns else F.col("gene_name")
    return df.select("gene_name", gene_id.alias("gene_id"), "chrom", span[0].alias("start"), span[1].alias("end"), "strand")


def tss_table(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, ["chrom", "tss", "gene_name", "strand"]).withColumn("tss", F.col("tss").cast("bigint"))


def gene_universe(spark: SparkSession, path: str) -> DataFrame:
    """Shared gene table in order of gene_index; missing columns are filled from what is there."""
    df = tsv(spark, path, ["feature_id"])
    fill = {"rna_gene": F.lit(None).cast("string"), "gene_name": F.col("feature_id"), "gene_id": F.col("feature_id"), "present_in_rna": F.lit("true"), "gene_index": F.monotonically_increasing_id().cast("string")}
    df = df.withColumns({c: e for c, e in fill.items() if c not in df.columns})
    df = df.withColumns({"present_in_rna": ids.as_bool(F.col("present_in_rna")), "gene_index": F.col("gene_index").cast("bigint")})
    return require_unique(df, ["feature_id"], path).orderBy("gene_index")


def guidance_graph(edges: DataFrame) -> DataFrame:
    """Edges fit for training: finite positive weights, at most 1, signs +1 or -1."""
    w = F.col("weight").cast("double")
    ok = w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))
    return edges.where(ok).withColumns({"weight": F.least(w, F.lit(1.0)), "sign": F.when(F.col("sign").cast("double") >= 0, 1).otherwise(-1)})


def detect_delimiter(line: str) -> str | None:
    """Tab, comma, or None for runs of white space."""
    return "\t" if "\t" in line else "," if "," in line else None


def split_line(line: str, sep: str | None) -> list[str]:
    return line.rstrip("\r\n").split(sep) if sep else line.split()


def wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A feature by cell text matrix in long form: feature, barcode, col_pos, value (text), row_pos.

    The delimiter is the header's.  A header one shorter than the first row has
    no name for the features.  Short rows are padded with ``0``, long ones cut.
    """
    lines = spark.read.text(path).withColumn("row_pos", F.monotonically_increasing_id()).where(F.trim("value") != "")
    head = lines.orderBy("row_pos").limit(2).collect()
    if not head:
        raise SchemaError(f"{path} is empty")
    sep = detect_delimiter(head[0].value)
    header = split_line(head[0].value, sep)
    width = len(split_line(head[1].value, sep)) if len(head) > 1 else len(header)
    if width == len(header) + 1:
        cells = header
    elif width >= len(header) or len(head) == 1:
        cells = header[1:]
    else:
        raise SchemaError(f"{path}: the header has {len(header)} fields, the first row {width}")
    row = F.split(F.regexp_replace("value", r"[\r\n]+$", "") if sep else F.trim("value"), sep or r"\s+", -1)
    names = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "col_pos int, barcode string")
    body = lines.where(F.col("row_pos") != head[0].row_pos).select("row_pos", row.alias("parts"))
    padded = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(cells)))), lambda k: F.coalesce(F.get("parts", k), F.lit("0")))
    long = body.select("row_pos", F.col("parts")[0].alias("feature"), F.posexplode(padded).alias("col_pos", "value"))
    return long.join(F.broadcast(names), "col_pos").select("feature", "barcode", "col_pos", "value", "row_pos")


def numeric_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``wide_matrix`` with numeric counts; text that is no number counts 0."""
    return wide_matrix(spark, path).select("feature", "barcode", "col_pos", F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)).alias("count"))
