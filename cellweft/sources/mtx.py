"""MatrixMarket coordinate files.

``read`` drops comments and the size line, whatever its spelling; ``read_triple``
joins cells and features on by position and checks the sizes that the file
declares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SchemaError


def read(spark: SparkSession, path: str, rows_wanted: DataFrame | None = None) -> DataFrame:
    """row_idx, col_idx (0-based) and value; a plain scan, so large files split.

    ``rows_wanted`` (row_idx) keeps the entries of these rows alone, in the stage of the scan if they are few.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    size = shape(spark, path)
    first = F.monotonically_increasing_id()
    rows = lines.select(parts.alias("p"), first.alias("at"))
    start = rows.agg(F.min("at")).first()[0]
    rows = rows.where(F.col("at") != start).select((F.get("p", F.lit(0)).cast("bigint") - 1).alias("row_idx"), (F.get("p", F.lit(1)).cast("bigint") - 1).alias("col_idx"), F.coalesce(F.get("p", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("value"))
    # indices outside the declared size are an error, not data
    inside = rows.where(F.when((F.col("row_idx") < 0) | (F.col("row_idx") >= size[0]) | (F.col("col_idx") < 0) | (F.col("col_idx") >= size[1]), F.raise_error(F.lit(f"{path}: an index is outside the matrix"))).isNull())
    return inside if rows_wanted is None else inside.join(rows_wanted.select("row_idx"), "row_idx", "left_semi")


def shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Rows, columns and entries that the file declares."""
    for line in spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).limit(1).collect():
        parts = line.value.split()
        if len(parts) == 3:
            return int(parts[0]), int(parts[1]), int(parts[2])
    raise SchemaError(f"{path} has no size line")


def read_triple(spark: SparkSession, matrix: str, cells: DataFrame, features: DataFrame) -> DataFrame:
    """barcode, feature and value; ``cells`` and ``features`` have (idx, name), checked against the sizes."""
    rows, cols, _ = shape(spark, matrix)
    if (cells.count(), features.count()) != (rows, cols):
        raise SchemaError(f"{matrix} is {rows} by {cols}, but there are {cells.count()} cells and {features.count()} features")
    entries = read(spark, matrix)
    named = entries.join(cells.select(F.col("idx").alias("row_idx"), F.col("name").alias("barcode")), "row_idx")
    return named.join(features.select(F.col("idx").alias("col_idx"), F.col("name").alias("feature")), "col_idx").select("barcode", "feature", "value")


def csr_to_entries(indptr: list[int], indices: list[int], data: list[float], spark: SparkSession) -> DataFrame:
    """Row, column and value of a compressed sparse row matrix."""
    ptr = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(indptr, indptr[1:], strict=False))], "row_idx bigint, a bigint, b bigint").where("b > a")
    body = spark.createDataFrame(list(zip(range(len(indices)), indices, data, strict=True)), "at bigint, col_idx bigint, value double")
    spread = ptr.select("row_idx", F.explode(F.sequence("a", F.col("b") - 1)).alias("at"))
    return spread.join(body, "at").select("row_idx", "col_idx", "value")
