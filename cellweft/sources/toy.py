"""A small synthetic experiment with fixed hashes: no random state, same rows anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHROMS = {"chr1": 8000, "chr2": 8000}
PEAKS = [("chr1", 2000, 2600), ("chr1", 3000, 3600), ("chr1", 4000, 4600), ("chr2", 2000, 2600), ("chr2", 3000, 3600)]
N_SINGLET, N_DOUBLET, N_NEGATIVE = 40, 2, 2


def _u(*parts: Column | int, m: int) -> Column:
    return F.pmod(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), m)


def cells(spark: SparkSession) -> DataFrame:
    """cell, barcode, class and donor of the 44 cells."""
    n = N_SINGLET + N_DOUBLET + N_NEGATIVE
    letters = F.array(*(F.element_at(F.array(*map(F.lit, "ACGT")), (F.floor(F.col("id") / 4**k) % 4 + 1).cast("int")) for k in range(8)))
    cls = F.when(F.col("id") < N_SINGLET, "Singlet").when(F.col("id") < N_SINGLET + N_DOUBLET, "Doublet").otherwise("Negative")
    donor = F.when(cls == "Negative", "NA").when(F.col("id") % 2 == 0, "HTO_A").otherwise("HTO_B")
    return spark.range(n).select(F.col("id").alias("cell"), F.concat(F.array_join(letters, ""), F.lit("AACC-1")).alias("barcode"), cls.alias("hto_classification"), donor.alias("donor_id"))


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHROMS.items()), "chrom string, size bigint")


def peaks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p, f"peak_{k + 1}") for k, p in enumerate(PEAKS)], "chrom string, start bigint, end bigint, name string")


def fragments(spark: SparkSession, in_peak: int = 160, outside: int = 10) -> DataFrame:
    """Fragments of 60 to 119 bases: most inside a peak, some before position 1500; doublets have 10 more, negatives 50."""
    base = cells(spark)
    n = F.when(F.col("hto_classification") == "Negative", 50).when(F.col("hto_classification") == "Doublet", in_peak + outside + 10).otherwise(in_peak + outside)
    each = base.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    at = F.element_at(F.array(*(F.struct(F.lit(c).alias("chrom"), F.lit(s).alias("s")) for c, s, _ in PEAKS)), (_u(F.col("cell"), F.col("k"), 1, m=len(PEAKS)) + 1).cast("int"))
    inside = F.col("k") < in_peak
    start = F.when(inside, at["s"] + _u(F.col("cell"), F.col("k"), 2, m=480)).otherwise(_u(F.col("cell"), F.col("k"), 3, m=1300))
    return each.select(at["chrom"].alias("chrom"), start.cast("bigint").alias("start"), (start + 60 + _u(F.col("cell"), F.col("k"), 4, m=60)).cast("bigint").alias("end"), "barcode", F.lit(1).alias("dup"))


def counts(spark: SparkSession, tags: list[str], kind: str) -> DataFrame:
    """Long counts: a cell's own tag (doublets: two, negatives: none) is high."""
    base = cells(spark).withColumn("col_pos", F.col("cell").cast("int"))
    each = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(tags) - 1))))
    own = F.when(F.col("hto_classification") == "Negative", F.lit(False)).when(F.col("hto_classification") == "Doublet", F.lit(True)).otherwise(F.col("cell") % len(tags) == F.col("k"))
    value = F.when(own, 200 + _u(F.col("cell"), F.col("k"), 5, m=80)).otherwise(_u(F.col("cell"), F.col("k"), 6, m=8))
    name = F.element_at(F.array(*map(F.lit, tags)), F.col("k") + 1)
    return each.select(name.alias("feature"), "barcode", "col_pos", value.cast("double").alias("count"), F.lit(kind).alias("kind"))
