"""Score-based search for a weighted DAG with mixed families.

Minimises mu (Q(W, b) + l1 |W|) + h(W) along a path of falling mu, where
h(W) = -log det(sI - W∘W) + d log s is a barrier of the matrices W∘W of spectral
radius below s and is 0 at DAGs alone.  Q adds one loss per child: squared for
gaussian, logistic for bernoulli, NB2 with a log link and fixed dispersion for nb2.

Each stage is a composite problem: the smooth part takes proximal gradient steps,
which threshold W softly, of Barzilai-Borwein length.  A step is halved until it
stays inside the barrier and lowers the objective as far as its quadratic model says,
so the objective never rises; a stage ends where the step's gradient mapping is small,
or a hundred steps lower the objective by next to nothing.
Parents are centred, so intercepts b hardly depend on W and are steps like others.
Where all families are gaussian the second moments are all that Q needs
(``fit_moments``), so rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..families import CAP, FLOOR, lgamma

FAMILIES = ("gaussian", "bernoulli", "nb2")
#: Families of the gene and of the peaks for each preset.
PRESETS = {
    "gaussian": ("gaussian", "gaussian"),
    "nb2_gaussian": ("nb2", "gaussian"),
    "nb2_bernoulli": ("nb2", "bernoulli"),
    "nb2_nb2": ("nb2", "nb2"),
}
#: Bound of a linear predictor on its link scale.
_REACH = 30.0

#: Loss and gradients in W and b.
Smooth = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def acyclicity(w: np.ndarray, s: float) -> tuple[float, np.ndarray]:
    """h(W) and its gradient."""
    d = len(w)
    inner = s * np.eye(d) - w * w
    return float(-np.linalg.slogdet(inner)[1] + d * np.log(s)), 2 * w * np.linalg.inv(inner).T


def radius(w: np.ndarray) -> float:
    """Spectral radius of W∘W."""
    return float(np.abs(np.linalg.eigvals(w * w)).max(initial=0.0))


def dispersion(y: np.ndarray) -> float:
    mean, var = y.mean(), y.var(ddof=1) if len(y) > 1 else 0.0
    return CAP if var <= mean or mean <= 0 else float(np.clip(mean**2 / (var - mean), FLOOR, CAP))


def loss(family: str, y: np.ndarray, z: np.ndarray, theta: float) -> tuple[float, np.ndarray]:
    """Mean loss of predictors ``z`` on the link scale, and its derivative at each row."""
    if family == "gaussian":
        return 0.5 * float(((z - y) ** 2).mean()), z - y
    inside = np.abs(z) < _REACH
    z = np.clip(z, -_REACH, _REACH)
    if family == "bernoulli":
        return float((np.logaddexp(0, z) - y * z).mean()), inside * (1 / (1 + np.exp(-z)) - y)
    mean = np.exp(z)
    fixed = lgamma(np.full_like(y, theta)) + lgamma(y + 1) - lgamma(y + theta) - theta * np.log(theta)
    return float((fixed + (y + theta) * np.log(theta + mean) - y * z).mean()), inside * theta * (mean - y) / (theta + mean)


def start(family: str, y: np.ndarray, off: np.ndarray) -> float:
    """Intercept without parents, about."""
    mean = float(y.mean())
    if family == "gaussian":
        return mean - float(off.mean())
    if family == "bernoulli":
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        return float(np.log(mean / (1 - mean)) - off.mean())
    return float(np.log(max(y.sum(), 0.5) / np.exp(np.clip(off, -_REACH, _REACH)).sum()))


def minimise(smooth: Smooth, w: np.ndarray, b: np.ndarray, mu: float, l1: float, s: float, mask: np.ndarray, most: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """One stage: W, b and whether it settled within ``most`` steps."""

    def value(w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        q, gw, gb = smooth(w, b)
        h, gh = acyclicity(w, s)
        return mu * q + h, np.where(mask, 0.0, mu * gw + gh), mu * gb

    now, gw, gb = value(w, b)
    length, before = 1.0 / max(1.0, float(np.abs(gw).max(initial=0.0))), np.inf
    for k in range(most):
        if k % 100 == 0:
            if before - now <= 1e-2 * tolerance * mu:
                return w, b, True
            before = now
        while True:
            near = w - length * gw
            near = np.where(mask, 0.0, np.sign(near) * np.maximum(np.abs(near) - length * mu * l1, 0.0))
            dw, db = near - w, -length * gb
            square = float((dw * dw).sum() + (db * db).sum())
            if radius(near) < s:
                then, tw, tb = value(near, b + db)
                if then <= now + float((gw * dw).sum() + gb @ db) + square / (2 * length) + 1e-14 * abs(now):
                    break
            length *= 0.5
            if length < 1e-14:
                return w, b, True
        change = float(((tw - gw) * dw).sum() + (tb - gb) @ db)
        size = max(np.abs(dw).max(initial=0.0), np.abs(db).max(initial=0.0)) / length
        w, b, now, gw, gb = near, b + db, then, tw, tb
        if size <= tolerance * mu:
            return w, b, True
        length = min(square / change, 1e6) if change > 0 and square > 0 else 2 * length
    return w, b, False


@dataclass
class Dagma:
    """``fit`` gives W[source, target]; ``converged`` says of each stage whether it ended before its bound of steps."""

    families: list[str]
    offsets: np.ndarray | None = None
    lambda1: float = 0.03
    threshold: float = 0.3
    stages: int = 5
    warm: int = 30000
    last: int = 60000
    path: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.6)
    tolerance: float = 1e-4
    thetas: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercepts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    converged: list[bool] = field(default_factory=list)

    def smooth(self, x: np.ndarray, off: np.ndarray) -> Smooth:
        """Q of the rows ``x``."""
        centred = x - x.mean(0)

        def of(w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            z = centred @ w + b + off
            parts = [loss(f, x[:, j], z[:, j], self.thetas[j]) for j, f in enumerate(self.families)]
            slope = np.stack([p[1] for p in parts], 1) / len(x)
            return sum(p[0] for p in parts), centred.T @ slope, slope.sum(0)

        return of

    def _path(self, smooth: Smooth, b: np.ndarray, exclude: set[tuple[int, int]]) -> np.ndarray:
        d = len(b)
        mask = np.eye(d, dtype=bool)
        for i, j in exclude:
            mask[i, j] = True
        w, self.converged = np.zeros((d, d)), []
        for k in range(self.stages):
            # a stage begins inside its barrier
            s = max(self.path[min(k, len(self.path) - 1)], radius(w) * 1.05 + 1e-3)
            w, b, settled = minimise(smooth, w, b, 0.1**k, self.lambda1, s, mask, self.last if k == self.stages - 1 else self.warm, self.tolerance)
            self.converged.append(settled)
        self.intercepts = b
        return np.where(np.abs(w) < self.threshold, 0.0, w)

    def fit(self, x: np.ndarray, exclude: set[tuple[int, int]] = frozenset()) -> np.ndarray:
        x = x.astype(float)
        if len(self.families) != x.shape[1] or set(self.families) - set(FAMILIES):
            raise ValueError("one known family a column is needed")
        if set(self.families) == {"gaussian"} and self.offsets is None:
            w = self.fit_moments((x - x.mean(0)).T @ (x - x.mean(0)) / len(x), exclude)
            self.intercepts = x.mean(0) - x.mean(0) @ w
            return w
        off = np.zeros_like(x) if self.offsets is None else self.offsets
        self.thetas = np.array([dispersion(x[:, j]) if f == "nb2" else 0.0 for j, f in enumerate(self.families)])
        w = self._path(self.smooth(x, off), np.array([start(f, x[:, j], off[:, j]) for j, f in enumerate(self.families)]), exclude)
        self.intercepts = self.intercepts - x.mean(0) @ w
        return w

    def fit_moments(self, moments: np.ndarray, exclude: set[tuple[int, int]] = frozenset()) -> np.ndarray:
        """W from the second moments of centred gaussian columns."""
        if set(self.families) != {"gaussian"} or len(self.families) != len(moments):
            raise ValueError("moments are enough for gaussian columns alone")

        def of(w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            rest = np.eye(len(w)) - w
            slope = moments @ rest
            return 0.5 * float((rest * slope).sum()), -slope, np.zeros_like(b)

        return self._path(of, np.zeros(len(moments)), exclude)


def edge_records(w: np.ndarray, names: list[str], tolerance: float = 0.0) -> list[dict]:
    """Edges of an adjacency as graph records, heaviest first."""
    out = []
    for i, j in zip(*np.nonzero(np.abs(w) > tolerance), strict=True):
        out.append({"node1": names[i], "endpoint1": "TAIL", "node2": names[j], "endpoint2": "ARROW", "edge_text": f"{names[i]} --> {names[j]}", "source": names[i], "target": names[j], "weight": float(w[i, j]), "abs_weight": float(abs(w[i, j]))})
    return sorted(out, key=lambda r: (-r["abs_weight"], r["source"], r["target"]))
