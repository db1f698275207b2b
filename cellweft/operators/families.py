"""Count families of matched expression: rates, dispersions, likelihoods and AIC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import weighed

THETA_GRID = np.logspace(-2, 6, 200)
ALPHA_GRID = np.logspace(-4, 4, 200)
FLOOR, CAP = 1e-6, 1e6
_HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: Stirling's series above 8, shifted there from below by a product of eight factors."""
    x = np.asarray(x, float)
    low = x < 8
    y = np.where(low, x + 8, x)
    inv = 1 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv / 1188)))) / y
    out = np.array((y - 0.5) * np.log(y) - y + _HALF_LOG_2PI + series)
    # x (x + 1) ... (x + 7), the factors paired from both ends
    t = x[low] * (x[low] + 7)
    out[low] -= np.log(t) + np.log((t + 6) * (t + 10) * (t + 12))
    return out[()]


def middle(df: DataFrame, column: str) -> float | None:
    """The median of the positive numbers of a column: exact, from counts of distinct values over range partitions."""
    counts = df.where(F.col(column) > 0).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = weighed(counts, ["v"], "n", "before")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return None
    ends = (total - 1) // 2, total // 2
    found = placed.where(" or ".join(f"(before <= {e} and {e} < before + n)" for e in ends)).orderBy("v").collect()  # two rows at most
    return (found[0].v + found[-1].v) / 2


def size_factors(cells: DataFrame) -> DataFrame:
    """``size`` of each cell: library over the median positive library (at least 1), at least 1e-6."""
    return cells.withColumn("size", F.greatest(F.col("library") / F.lit(max(middle(cells, "library") or 1.0, 1.0)), F.lit(FLOOR)))


def library_stats(cells: DataFrame) -> DataFrame:
    return cells.agg(F.avg("library").alias("mean"), F.stddev_samp("library").alias("std"), F.min("library").alias("min"), F.max("library").alias("max"))


def moments_dispersion(mean: Column, variance: Column) -> Column:
    """NB2 size parameter by moments, mean² / (variance - mean), within floor and cap; the cap where there is no excess."""
    return F.when((variance > mean) & (mean > 0), F.least(F.greatest(mean * mean / (variance - mean), F.lit(FLOOR)), F.lit(CAP))).otherwise(F.lit(CAP))


def dispersions(long: DataFrame) -> DataFrame:
    """mean, variance and dispersion of ``y`` of each gene."""
    got = long.groupBy("gene").agg(F.avg("y").alias("mean"), F.var_samp("y").alias("variance"))
    return got.withColumn("dispersion", moments_dispersion(F.col("mean"), F.col("variance")))


def poisson_rates(long: DataFrame) -> DataFrame:
    return long.groupBy("gene").agg((F.sum("y") / F.sum("size")).alias("rate"))


def _log_likelihoods(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Sums over cells: Poisson, then NB2 at each theta, then NB1 at each alpha."""
    mu = np.maximum(mu, 1e-12)
    # counts repeat, so what depends on them and the grid alone is found once for each
    distinct, times = np.unique(y, return_counts=True)
    base = (lgamma(distinct + 1) * times).sum()
    log_mu, total = np.log(mu), y.sum()
    poisson = (y * log_mu - mu).sum() - base
    theta = THETA_GRID[:, None]
    gammas = ((lgamma(distinct + theta) - lgamma(theta)) * times).sum(1)
    log_both = np.log(theta + mu)
    nb2 = gammas - base + (theta * (np.log(theta) - log_both) + y * (log_mu - log_both)).sum(1)
    alpha = ALPHA_GRID[:, None]
    r = mu / alpha
    nb1 = (lgamma(y + r) - lgamma(r)).sum(1) - base - r.sum(1) * np.log1p(ALPHA_GRID) + total * (np.log(ALPHA_GRID) - np.log1p(ALPHA_GRID))
    return np.concatenate([[poisson], nb2, nb1])


def log_likelihoods(long: DataFrame) -> DataFrame:
    """gene, family, parameter and log-likelihood over both grids; ``long`` is (gene, y, size).

    Every batch sums the whole grid for its rows, so partial sums of 401 numbers a
    gene are what is shuffled, not cells times grid.
    """
    rows = long.join(F.broadcast(poisson_rates(long)), "gene").select("gene", F.col("y").cast("double").alias("y"), (F.col("size") * F.col("rate")).alias("mu"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            genes = np.array(batch.column("gene").to_pylist(), dtype=object)
            y, mu = batch.column("y").to_numpy(), batch.column("mu").to_numpy()
            for g in dict.fromkeys(genes):
                at = np.flatnonzero(genes == g)
                total = np.zeros(1 + len(THETA_GRID) + len(ALPHA_GRID))
                for k in range(0, len(at), 2000):
                    part = at[k : k + 2000]
                    total += _log_likelihoods(y[part], mu[part])
                n = len(total)
                yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array(np.arange(n), pa.int32()), pa.array(total)], names=["gene", "k", "ll"])

    sums = rows.mapInArrow(run, "gene string, k int, ll double").groupBy("gene", "k").agg(F.sum("ll").alias("ll"))
    n = len(THETA_GRID)
    grid = F.array(*(F.lit(float(v)) for v in np.concatenate([[np.nan], THETA_GRID, ALPHA_GRID])))
    family = F.when(F.col("k") == 0, "poisson").when(F.col("k") <= n, "nb2").otherwise("nb1")
    return sums.select("gene", family.alias("family"), F.when(F.col("k") > 0, F.get(grid, F.col("k"))).alias("parameter"), "ll", "k")


def compare(long: DataFrame) -> DataFrame:
    """Best parameter, log-likelihood and AIC of each gene and family; of ties the smaller parameter."""
    ll = log_likelihoods(long)
    best = ll.groupBy("gene", "family").agg(F.max_by("parameter", F.struct("ll", -F.col("k"))).alias("parameter"), F.max("ll").alias("log_likelihood"))
    params = F.when(F.col("family") == "poisson", 1).otherwise(2)
    return best.withColumn("aic", 2 * params - 2 * F.col("log_likelihood"))


def best_family(compared: DataFrame) -> DataFrame:
    """Family of least AIC of each gene."""
    order = F.when(F.col("family") == "nb2", 0).when(F.col("family") == "nb1", 1).otherwise(2)
    return compared.groupBy("gene").agg(F.min_by("family", F.struct("aic", order)).alias("best_family"), F.min("aic").alias("aic"))


def recommend(best: DataFrame, wins: int = 2) -> str:
    """The family best for at least ``wins`` genes, NB2 asked first, else ``mixed``."""
    n = {r.best_family: r["count"] for r in best.groupBy("best_family").count().collect()}
    return next((f for f in ("nb2", "nb1", "poisson") if n.get(f, 0) >= wins), "mixed")
