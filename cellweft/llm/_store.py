"""Where intermediate tables go, and how rows are told from a table of keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import recovery
from ..recovery import scratch, shared_dir

__all__ = ["BROADCAST_KEYS", "bound_batches", "bounded", "keep", "once", "scratch", "shared_dir", "text_keys", "without"]

#: Rows of two bigints that are sent to every executor (about 64 MB as a hash table); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

#: Upper bound of one Arrow batch of texts while a table is written.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the batches that go to Python meanwhile, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, "1") == "1"
    if own:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(key)


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of what an operator returns to be run later, unless the session has a bound of its own; it stays set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":
        spark.conf.set(key, str(BATCH_BYTES))


def keep(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``recovery.keep`` with small batches."""
    with small_batches(df.sparkSession):
        return recovery.keep(df, name, schema)


def text_keys() -> list[Column]:
    """Two hashes that name a text; never null, and alike for all null texts."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(17), text).alias("key2")]


def bounded(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A stored table of a few bigint columns: to be broadcast if its count allows, else joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys.hint("merge")


def without(rows: DataFrame, names: list[Column], keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows, all columns as they are, whose ``names`` are not (left_semi: are) in the stored table ``keys``, column by column."""
    row = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.struct(*names).alias("own"))
    other = bounded(keys.select(F.struct(*(F.col(c) for c in keys.columns)).alias("other")))
    return row.join(other, F.col("own") == F.col("other"), how).select("row.*")


def once(rows: DataFrame, names: list[Column], keys: DataFrame) -> DataFrame:
    """The rows, all columns as they are, but one alone (of least hash) of those whose ``names`` are alike and in the stored table ``keys``."""
    again = without(rows, names, keys, "left_semi")
    row = again.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.struct(*names).alias("own"))
    one = row.groupBy("own").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return without(rows, names, keys).unionByName(one)
