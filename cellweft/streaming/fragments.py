"""Fragment counts and bin counts as Structured Streaming queries.

The reference's data has no event time, so there is no watermark: state is one
count a barcode, or a (barcode, bin), the size of the answer itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids, intervals
from ..operators.range_joins import covered_bins
from ..schema import FRAGMENTS


def read(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Fragments of all files that arrive in a folder."""
    source = spark.readStream.schema(FRAGMENTS).option("sep", "\t").option("comment", "#").option("quote", "")
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    return source.csv(folder).where("barcode is not null")


def counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("barcode").agg(F.count("*").alias("n"))


def filtered(fragments: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Stream-static semi-join with normalised barcodes."""
    listed = whitelist.select(F.col("barcode").alias("_listed"))
    return fragments.join(listed, ids.normalize_barcode(F.col("barcode")) == F.col("_listed"), "left_semi")


def bin_counts(fragments: DataFrame, size: int) -> DataFrame:
    hits = covered_bins(fragments, size)
    name = intervals.format_name(F.col("chrom"), F.col("bin") * size, (F.col("bin") + 1) * size)
    return hits.groupBy(F.col("barcode").alias("cell"), name.alias("feature")).agg(F.count("*").alias("value"))


def run_available(result: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; the in-memory table holds the complete answer."""
    query = result.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
