"""Column transforms before a graph search, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..recovery import looked_up
from .matrix import average_rank, zscore

_EDGE = 1e-6

# The published rational approximations of the normal quantile (algorithm AS 241 of Applied Statistics,
# double precision), numerator and denominator, highest power first, for the centre, the tails and the far tails.
QUANTILE = {
    "centre": (
        (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
        (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
    ),
    "tail": (
        (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
        (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
    ),
    "far tail": (
        (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
        (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.1369298809227358053, 0.59983220655588793769, 1.0),
    ),
}


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of a probability inside (0, 1), as a built-in expression."""

    def ratio(part: str, x: Column) -> Column:
        top, bottom = (reduce(lambda sum_, c: sum_ * x + F.lit(c), cs[1:], F.lit(cs[0])) for cs in QUANTILE[part])
        return top / bottom

    off = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(r <= 5, ratio("tail", r - 1.6)).otherwise(ratio("far tail", r - 5))
    return F.when(F.abs(off) <= 0.425, off * ratio("centre", F.lit(0.180625) - off * off)).otherwise(F.signum(off) * outer)


def rank_gaussian(long: DataFrame, key: str = "variable", value: str = "value", out: str = "value") -> DataFrame:
    """Normal scores of average ranks: (rank - 0.5) / n, kept off 0 and 1."""
    n = looked_up(long.groupBy(key).agg(F.count(value).alias("_n")), "counts")
    ranked = average_rank(long.where(F.col(value).isNotNull()), key, value, "_rank").join(n, key)
    p = F.least(F.greatest((F.col("_rank") - 0.5) / F.col("_n"), F.lit(_EDGE)), F.lit(1 - _EDGE))
    return ranked.withColumn(out, normal_quantile(p)).drop("_rank", "_n")


def standardise(long: DataFrame) -> DataFrame:
    return zscore(long, "variable", "value", "value")


def centre_and_scale(long: DataFrame) -> DataFrame:
    """z-scores; columns without spread are centred only."""
    stats = looked_up(long.groupBy("variable").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")), "spreads")
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    return long.join(stats, "variable").withColumn("value", (F.col("value") - F.col("_m")) / scale).drop("_m", "_s")


def prepare(long: DataFrame, transform: str = "none", scale: bool = True) -> DataFrame:
    """(row, variable, value) ready for PC or FCI."""
    if transform == "rank_gaussian":
        long = rank_gaussian(long)
    elif transform != "none":
        raise ValueError(f"unknown transform {transform!r}")
    return standardise(long) if scale else long


def complete_rows(long: DataFrame, n_variables: int, row: str = "row") -> DataFrame:
    """Rows that have every variable."""
    full = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(row).agg(F.count_distinct("variable").alias("_n")).where(F.col("_n") == n_variables)
    return long.join(full, row, "left_semi")
