"""Places in a total order, without a task that sorts everything.

Rows are range-partitioned and sorted; a row's place is its place in its
partition plus the rows of the partitions before.  The sorted rows are stored
first: partition borders come from a sample, so a second run could draw others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..recovery import keep

#: Bits of monotonically_increasing_id() that count within a partition.
_WITHIN = 33


def _ordered(df: DataFrame, order: list[str | Column], drop: str) -> DataFrame:
    """(row, part, at): stored rows, their range partition and their place in it; a row's column ``drop`` is left out."""
    columns = [f"`{c}`" for c in df.columns if c != drop]
    keys = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    return keep(placed.select("row", F.shiftright("at", _WITHIN).alias("part"), F.col("at").bitwiseAND(F.lit((1 << _WITHIN) - 1)).alias("at")), "places")


def _starts(placed: DataFrame, weight: Column, start: int) -> DataFrame:
    """(part, before): what the partitions before each one weigh, from ``start`` on."""
    before, total = [], start
    for part, n in sorted(placed.groupBy("part").agg(F.sum(weight)).collect()):  # a row a partition
        before.append((part, total))
        total += n
    return placed.sparkSession.createDataFrame(before, "part bigint, before bigint")


def numbered(df: DataFrame, order: list[str | Column], name: str = "idx", start: int = 0) -> DataFrame:
    """``df`` with ``name`` (bigint): start, start + 1, ... in ``order``; rows that tie are numbered in any order."""
    placed = _ordered(df, order, name)
    return placed.join(_starts(placed, F.lit(1), start), "part").select("row.*", (F.col("at") + F.col("before")).alias(name))


def weighed(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``name`` (bigint): the sum of the whole numbers ``weight`` over the rows before, in a total ``order``."""
    placed = _ordered(df, order, name)
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col(f"row.`{weight}`")
    summed = placed.withColumn("own", F.coalesce(F.sum(own).over(within), F.lit(0)))
    return summed.join(_starts(placed, own, 0), "part").select("row.*", (F.col("own") + F.col("before")).alias(name))


def numbered_within(df: DataFrame, group: str, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with places from ``start`` on in each group, null being a group; no task sorts a group.

    The rows before a group are those of smaller groups, so one count a group is joined to the places of all rows.
    """
    every = numbered(df, [group, *order], name)
    first = every.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"))
    return every.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first") + start).drop("_group", "_first")
