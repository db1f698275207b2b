"""Schemas of the engine's tables, and assertions on frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAGMENTS = "chrom string, start bigint, end bigint, barcode string, dup int"
COUNTS_LONG = "feature string, barcode string, col_pos int, count double"
BED4 = "chrom string, start bigint, end bigint, name string"
NARROW_PEAK = BED4 + ", score int, strand string, signal double, neg_log10_p double, neg_log10_q double, summit_offset int"
CHROM_SIZES = "chrom string, size bigint"
GTF = "chrom string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string"
ENTRIES = "row_idx bigint, col_idx bigint, value double"
EDGES = "source string, target string, weight double, sign int, distance_bp bigint, mark string, type string"


class SchemaError(ValueError):
    """A table lacks columns or breaks a key."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    again = df.groupBy(*keys).count().where(F.col("count") > 1).limit(5).collect()
    if again:
        raise SchemaError(f"{what} has repeated {', '.join(keys)}: " + "; ".join(str(tuple(r)[:-1]) for r in again))
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise SchemaError(f"{what} is empty")
    return df
