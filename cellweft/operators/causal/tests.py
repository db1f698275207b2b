"""Conditional independence tests.

Fisher's z works on a correlation matrix that Spark sums up from the rows, so its
cost on the driver doesn't depend on their number.  The kernel test works on a
matrix of rows in memory, as does any test of its kind.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import erfc, exp, lgamma, log, log1p, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation(wide: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Correlation matrix and number of rows in one pass of sums of products about the means."""
    cols = [F.col(f"`{n}`").cast("double") for n in names]
    first = wide.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{k}") for k, c in enumerate(cols))).first()
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    centred = [c - F.lit(first[f"m{k}"]) for k, c in enumerate(cols)]
    sums: dict[str, float] = {}
    for at in range(0, len(pairs), 400):  # plans of bounded width
        row = wide.agg(*(F.sum(centred[i] * centred[j]).alias(f"s{i}_{j}") for i, j in pairs[at : at + 400])).first()
        sums |= row.asDict()
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = sums[f"s{i}_{j}"] or 0.0
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return cov / sd[:, None] / sd[None], first["n"]


class FisherZ:
    def __init__(self, corr: np.ndarray, n: int) -> None:
        self.corr, self.n = corr, n

    def __call__(self, x: int, y: int, given: tuple[int, ...] = ()) -> float:
        at = [x, y, *given]
        inv = np.linalg.pinv(self.corr[np.ix_(at, at)])
        r = -inv[0, 1] / sqrt(abs(inv[0, 0] * inv[1, 1])) if given else self.corr[x, y]
        r = min(max(r, -1 + 1e-12), 1 - 1e-12)
        z = sqrt(max(self.n - len(given) - 3, 1)) * 0.5 * (log1p(r) - log1p(-r))
        return erfc(abs(z) / sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-14 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return scale * h


class KernelTest:
    """Kernel independence test with Gaussian kernels and a gamma null."""

    def __init__(self, data: np.ndarray, epsilon: float = 1e-3) -> None:
        self.x = (data - data.mean(0)) / np.where(data.std(0) > 0, data.std(0), 1)
        self.epsilon = epsilon
        self.cache: dict[tuple[int, ...], np.ndarray] = {}

    def _kernel(self, at: tuple[int, ...]) -> np.ndarray:
        if at not in self.cache:
            v = self.x[:, list(at)]
            d = np.maximum(((v**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * v @ v.T), 0)
            far = d[np.triu_indices(len(v), 1)]
            width = np.median(far[far > 0]) if (far > 0).any() else 1.0
            k = np.exp(-d / width)
            k -= k.mean(0)[None]
            k -= k.mean(1)[:, None]
            if len(self.cache) > 200:
                self.cache.clear()
            self.cache[at] = k
        return self.cache[at]

    def __call__(self, x: int, y: int, given: tuple[int, ...] = ()) -> float:
        n = len(self.x)
        if given:
            kx, ky = self._kernel((x, *given)), self._kernel((y,))
            kz = self._kernel(tuple(given))
            r = self.epsilon * np.linalg.inv(kz + self.epsilon * np.eye(n))
            kx, ky = r @ kx @ r, r @ ky @ r
            vals, vecs = zip(*(np.linalg.eigh((k + k.T) / 2) for k in (kx, ky)), strict=True)
            px, py = (v[:, e > e.max() * 1e-5] * np.sqrt(e[e > e.max() * 1e-5]) for e, v in zip(vals, vecs, strict=True))
            prod = (px[:, :, None] * py[:, None, :]).reshape(n, -1)
            w = prod.T @ prod if prod.shape[1] < n else prod @ prod.T
            mean, var = np.trace(w), 2 * (w * w).sum()
            stat = (kx * ky).sum()
        else:
            kx, ky = self._kernel((x,)), self._kernel((y,))
            stat = (kx * ky).sum()
            mean = np.trace(kx) * np.trace(ky) / n
            var = 2 * (kx * kx).sum() * (ky * ky).sum() / n**2
        if mean <= 0 or var <= 0:
            return 1.0
        return gamma_upper(mean**2 / var, stat * mean / var)
