"""Sparse matrices in long form: statistics, TF-IDF, products and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..recovery import keep, looked_up
from .places import weighed


def column_stats(long: DataFrame, key: str = "variable", value: str = "value") -> DataFrame:
    """Distinct values, sample std (0 for at most one), shares of zeros and of missing, min and max."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    n = F.count(x)
    return long.groupBy(key).agg(
        F.count_distinct(x).alias("n_unique"),
        F.when(n <= 1, 0.0).otherwise(F.stddev_samp(x)).alias("std"),
        F.coalesce(F.avg((x == 0).cast("double")), F.lit(1.0)).alias("zero_fraction"),
        F.avg(x.isNull().cast("double")).alias("missing_fraction"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
    )


def sparse_feature_stats(entries: DataFrame, n_cells: int | Column) -> DataFrame:
    """Mean and population std of each feature over all cells, zeros included; tiny stds are 1."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    mean = F.sum("value") / n
    var = F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0))
    std = F.sqrt(var)
    return entries.groupBy("feature").agg(mean.alias("mean"), F.when((std < 1e-6) | F.isnan(std), 1.0).otherwise(std).alias("std"))


def tf_idf(entries: DataFrame, n_cells: int) -> DataFrame:
    """Share of the cell times log1p(cells / cells with the feature)."""
    rows = entries.groupBy("cell").agg(F.sum("value").alias("_row"))
    cols = entries.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("_df"))
    got = entries.join(rows, "cell").join(cols, "feature")
    return got.select("cell", "feature", scores.tf_idf(F.col("value"), F.col("_row"), F.lit(n_cells), F.col("_df")).alias("value"))


def top_features(entries: DataFrame, k: int) -> DataFrame:
    """The k features of largest total; ties go to the first by name."""
    return entries.groupBy("feature").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "feature").limit(k)


#: Entries that a task of a product takes, on average.
TASK_ENTRIES = 1 << 20


def gene_scores(entries: DataFrame, links: DataFrame, task_entries: int = TASK_ENTRIES) -> DataFrame:
    """Cells by genes from cells by peaks and (feature, gene, weight); zeros are left out.

    Stored entries of more tasks than there are cores meet their links in as many tasks as their number asks for, so a task's
    memory does not grow with the table. Entries of a feature that alone has more than a task's stay where they are, and the links of such features come to them.
    """
    entries, links = keep(entries.where("feature is not null").select("cell", "feature", "value"), "entries"), links.select("feature", "gene", "weight")
    session = entries.sparkSession
    width, usual = -(-entries.count() // task_entries), int(session.conf.get("spark.sql.shuffle.partitions"))
    got = entries.join(links, "feature")
    if width > session.sparkContext.defaultParallelism:
        hot = F.broadcast(keep(entries.groupBy("feature").count().where(F.col("count") > task_entries).select("feature"), "hot"))
        apart = entries.join(hot, "feature", "left_anti").repartition(max(width, usual), "feature").join(links.repartition(max(width, usual), "feature"), "feature")
        got = apart.unionByName(entries.join(hot, "feature", "left_semi").join(looked_up(links.join(hot, "feature", "left_semi"), "hot-links"), "feature"))
    return got.groupBy("cell", "gene").agg(F.sum(F.col("value") * F.col("weight")).alias("value")).where("value <> 0")


def align_features(entries: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries re-indexed to ``target`` (feature, idx), and which target features are there."""
    aligned = entries.join(target, "feature").select("cell", "idx", "feature", "value")
    present = entries.select("feature").distinct().withColumn("_here", F.lit(True))
    flags = target.join(present, "feature", "left").select("feature", "idx", F.coalesce("_here", F.lit(False)).alias("feature_available"))
    return aligned, flags


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each row key by the given values; absent pairs are 0."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def row_fractions(table: DataFrame, values: list[str]) -> DataFrame:
    """Each value over its row's total; empty rows are 0."""
    total = sum((F.col(v) for v in values), F.lit(0))
    return table.withColumns({v: F.coalesce(F.try_divide(F.col(v), total), F.lit(0.0)) for v in values})


def zscore(df: DataFrame, key: str, value: str, out: str = "z") -> DataFrame:
    """(x - mean) / sample std within key; null where the std is 0.

    Statistics are a grouped aggregate joined back, so a large key isn't sorted in one task.
    """
    stats = looked_up(df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")), "spreads")
    return df.join(stats, key).withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def average_rank(df: DataFrame, key: str, value: str, out: str = "rank") -> DataFrame:
    """Rank within key, ties sharing their mean rank; nulls come first and NaNs last.

    Ranks follow from the counts of distinct values, summed over range partitions, so no task sorts a key.
    """
    counts = df.groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = weighed(counts, ["_k", "_v"], "_n", "_before")
    first = looked_up(placed.groupBy(F.col("_k").alias("_key")).agg(F.min("_before").alias("_first")), "first-places")
    ranks = placed.join(first, F.col("_k").eqNullSafe(F.col("_key"))).select("_k", "_v", (F.col("_before") - F.col("_first") + (F.col("_n") + 1) / 2).alias(out))
    return df.drop(out).join(ranks, F.col(key).eqNullSafe(F.col("_k")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_k", "_v")


def drop_constant(long: DataFrame, min_unique: int = 2, min_std: float = 1e-8, key: str = "variable") -> DataFrame:
    """Why a variable is dropped before a graph search, null if it stays; the first reason counts."""
    number = F.col("value").try_cast("double")
    stats = long.groupBy(key).agg(
        F.count_if(F.col("value").isNotNull() & number.isNull()).alias("_text"),
        F.count_distinct(number).alias("n_unique"),
        F.coalesce(F.stddev_samp(number), F.lit(0.0)).alias("std"),
    )
    reason = F.when(F.col("_text") > 0, "non_numeric").when(F.col("n_unique") < min_unique, "too_few_unique").when(F.col("std") <= min_std, "near_constant")
    return stats.select(key, "n_unique", "std", reason.alias("drop_reason"))


def to_wide(long: DataFrame, key: str, variables: list[str]) -> DataFrame:
    """Long to wide for numeric kernels; the variables are known."""
    return long.groupBy(key).pivot("variable", variables).agg(F.first("value"))
