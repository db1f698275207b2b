"""Conditional independence from random Fourier features, without rows on the driver.

A Gaussian kernel of some variables is stood for by cosines of random projections: few of
them for the two variables of a test, many for what it is conditioned on.  The features'
cross-products are one sum over all rows; from them the driver has the ridge regression of
both on the condition and with it the covariance of what is left, whose squares are the
statistic.  Under independence this is a weighted sum of squares; its mean and variance
come from the products of the residuals, a second sum over all rows, and a gamma of these
moments gives the p-value.  The tests of a depth of a search share both passes, ``TOGETHER`` at
a time, so what a task holds is bounded by that and the number of features.

Projections follow from the seed and the variables.  Variables are standardised, and the
kernel's width is the median distance of normal variables of that number, so nothing is sampled.
Conditions take half and twice that width besides: with one width what curved dependence on the
condition is left shows as the rows grow (on planted pairs 0.11 of p-values below 0.05 at 5,000
rows, with three widths 0.055; 0.06 and 0.04 at 800 and 2,000; 800 tests each).

Defined cases: a constant variable is independent of all; rows with a missing value in one
of the variables must be left out before; no rows give p-values of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sums
from .tests import gamma_upper

#: Features of a variable and of a condition, ridge as a share of the features' mean variance, tests that share a pass.
FEW = 5
MANY = 100
RIDGE = 1e-9
#: Condition features take these multiples of the kernel's inverse width in turn.
SCALES = (0.5, 1.0, 2.0)
TOGETHER = 100
#: Rows whose features are held at once.
ROWS = 4096

Key = tuple[int, int, tuple[int, ...]]


class Features:
    """Random features of the standardised values of some variables."""

    def __init__(self, at: tuple[int, ...], n: int, seed: int, wide: bool = False) -> None:
        rng = np.random.default_rng([seed, n, *at])
        m = len(at)
        width = np.sqrt(2 * m * (1 - 2 / (9 * m)) ** 3)
        ways = rng.normal(size=(m, n)) / width * (np.resize(SCALES, n) if wide else 1.0)
        self.at, self.ways, self.turns = list(at), ways, rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2) * np.cos(x[:, self.at] @ self.ways + self.turns)


def _plan(tests: list[Key], seed: int, few: int, many: int) -> tuple[dict[int, Features], dict[tuple[int, ...], Features], list[int]]:
    """Features of the variables and of the conditions, and the variables in order."""
    names = sorted({v for x, y, _ in tests for v in (x, y)})
    conditions = sorted({g for _, _, g in tests})
    return {v: Features((v,), few, seed) for v in names}, {g: Features(g, many, seed, True) for g in conditions if g}, names


def products(x: np.ndarray, tests: list[Key], seed: int, few: int = FEW, many: int = MANY) -> np.ndarray:
    """Number of rows, and for each condition the sums and cross-products of all variables' features and its own."""
    single, given, names = _plan(tests, seed, few, many)
    own = np.concatenate([single[v](x) for v in names], axis=1) if names else np.zeros((len(x), 0))
    out = [np.array([float(len(x))])]
    for g in sorted({t[2] for t in tests}):
        both = np.concatenate([own, *([given[g](x)] if g else []), np.ones((len(x), 1))], axis=1)
        out.append((both.T @ both).ravel())
    return np.concatenate(out)


class Fitted:
    """Means, regressions and residual covariances of tests, from ``products``."""

    def __init__(self, total: np.ndarray, tests: list[Key], few: int, many: int) -> None:
        names = sorted({v for x, y, _ in tests for v in (x, y)})
        place = {v: slice(k * few, (k + 1) * few) for k, v in enumerate(names)}
        self.n, at, width = total[0], 1, few * len(names)
        self.of: dict[Key, tuple] = {}
        for g in sorted({t[2] for t in tests}):
            size = width + (many if g else 0) + 1
            m = total[at : at + size * size].reshape(size, size) / max(self.n, 1)
            at += size * size
            mean = m[-1, :-1]
            cov = m[:-1, :-1] - np.outer(mean, mean)
            z = slice(width, size - 1)
            ridge = RIDGE * np.trace(cov[z, z]) / max(many, 1) * np.eye(size - 1 - width)
            weights = np.linalg.solve(cov[z, z] + ridge, cov[z, :width]) if g else np.zeros((0, width))
            left = cov[:width, :width] - weights.T @ cov[z, :width] - cov[:width, z] @ weights + weights.T @ cov[z, z] @ weights
            for t in (t for t in tests if t[2] == g):
                a, b = place[t[0]], place[t[1]]
                self.of[t] = (mean[a], mean[b], mean[z], weights[:, a], weights[:, b], left[a, b])


def residual_products(x: np.ndarray, fitted: Fitted, tests: list[Key], seed: int, few: int = FEW, many: int = MANY) -> np.ndarray:
    """For each test the sum of products of the residuals' products."""
    single, given, names = _plan(tests, seed, few, many)
    own, z = {v: single[v](x) for v in names}, {}
    out = []
    for t in tests:
        ma, mb, mz, wa, wb, _ = fitted.of[t]
        if t[2] not in z:
            z = {t[2]: given[t[2]](x) - mz if t[2] else np.zeros((len(x), 0))}
        a, b = own[t[0]] - ma - z[t[2]] @ wa, own[t[1]] - mb - z[t[2]] @ wb
        both = (a[:, :, None] * b[:, None, :]).reshape(len(x), -1)
        out.append((both.T @ both).ravel())
    return np.concatenate(out) if out else np.zeros(0)


def p_values(fitted: Fitted, residuals: np.ndarray, tests: list[Key], few: int = FEW) -> list[float]:
    out = []
    for k, t in enumerate(tests):
        w = residuals[k * few**4 : (k + 1) * few**4].reshape(few**2, few**2) / max(fitted.n, 1)
        cross = fitted.of[t][5].ravel()
        w = w - np.outer(cross, cross)
        mean, var = np.trace(w), 2 * (w * w).sum()
        out.append(float(gamma_upper(float(mean**2 / var), float(fitted.n * (cross @ cross) * mean / var))) if mean > 1e-12 and var > 0 else 1.0)
    return out


class RandomFeatureTest:
    """The test over a table ``wide`` with a column for each of ``names``, which should be stored."""

    def __init__(self, wide: DataFrame, names: list[str], seed: int = 0, few: int = FEW, many: int = MANY) -> None:
        cols = [F.col(f"`{n}`").cast("double") for n in names]
        said = wide.agg(F.count("*"), *(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
        self.n, d = said[0], len(names)
        self.mean = np.array([x or 0.0 for x in said[1 : d + 1]])
        self.sd = np.array([x or 1.0 for x in said[d + 1 :]])
        self.rows = wide.select(F.array(*cols).alias("x"))
        self.seed, self.few, self.many = seed, few, many
        self.known: dict[Key, float] = {}

    def _total(self, run, n: int) -> np.ndarray:
        mean, sd, d = self.mean, self.sd, len(self.mean)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            total = np.zeros(n)
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    x = batch.column("x").slice(k, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    total += run((x - mean) / sd)
            yield total

        return sums.total(self.rows, each, n)

    def ahead(self, tests: list[Key]) -> None:
        """Do these tests now, in as few passes as may be."""
        new = sorted({self._key(*t) for t in tests} - self.known.keys(), key=lambda t: (len(t[2]), t[2], t))
        seed, few, many = self.seed, self.few, self.many
        for k in range(0, len(new), TOGETHER):
            own = new[k : k + TOGETHER]
            size = len(products(np.zeros((0, len(self.mean))), own, seed, few, many))
            fitted = Fitted(self._total(lambda x, own=own: products(x, own, seed, few, many), size), own, few, many)
            left = self._total(lambda x, own=own, fitted=fitted: residual_products(x, fitted, own, seed, few, many), len(own) * few**4)
            self.known |= dict(zip(own, p_values(fitted, left, own, few), strict=True))

    @staticmethod
    def _key(x: int, y: int, given: tuple[int, ...]) -> Key:
        return min(x, y), max(x, y), tuple(sorted(given))

    def __call__(self, x: int, y: int, given: tuple[int, ...] = ()) -> float:
        key = self._key(x, y, given)
        if key not in self.known:
            self.ahead([key])
        return self.known[key]
