"""A joint latent space of modalities by an adversarial variational autoencoder.

One encoder and one decoder over features that all modalities share; features a
modality lacks are masked out of its loss.  A discriminator guesses the modality
from the latent mean, and the encoder is trained to mislead it.  Networks are
small, so the fit is numpy on the driver over a bounded sample of cells
(``max_cells`` a modality, by hash); encoding is a map over all cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .families import lgamma
from .qc import capped_sample


def reconstruction_family(kinds: list[str], have_stats: bool) -> str:
    """gaussian if every modality is a shared-feature matrix with statistics, else zinb."""
    return "gaussian" if have_stats and all(k == "shared" for k in kinds) else "zinb"


def kl_standard(mean: np.ndarray, log_var: np.ndarray) -> np.ndarray:
    """KL divergence of each row's Gaussian from the standard one."""
    return 0.5 * (np.exp(log_var) + mean**2 - 1 - log_var).sum(1)


def kl_general(m1: np.ndarray, v1: np.ndarray, m2: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """KL divergence between Gaussians with log variances v1 and v2."""
    return 0.5 * (v2 - v1 + (np.exp(v1) + (m1 - m2) ** 2) / np.exp(v2) - 1).sum(1)


def isometry(x: np.ndarray, z: np.ndarray) -> float:
    """Mean squared difference of pairwise distances, each scaled to mean 1."""
    d = [np.sqrt(np.maximum(((v[:, None] - v[None]) ** 2).sum(2), 0)) for v in (x, z)]
    a, b = (v / max(v[np.triu_indices(len(v), 1)].mean(), 1e-12) for v in d)
    return float(((a - b)[np.triu_indices(len(x), 1)] ** 2).mean())


def zinb_nll(x: np.ndarray, mean: np.ndarray, theta: np.ndarray, dropout: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Mean negative log-likelihood of zero-inflated negative binomial counts; dropout is a logit."""
    eps = 1e-8
    soft = np.logaddexp(0, -dropout)
    log_nb0 = theta * (np.log(theta + eps) - np.log(theta + mean + eps))
    zero = np.logaddexp(0, log_nb0 - dropout) - soft
    some = -dropout - soft + lgamma(x + theta) - lgamma(theta + np.zeros_like(x)) - lgamma(x + 1) + log_nb0 + x * (np.log(mean + eps) - np.log(theta + mean + eps))
    ll = np.where(x < eps, zero, some)
    return float(-(ll if mask is None else ll[mask]).mean())


def masked_mse(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> float:
    return float(((x - y) ** 2)[mask].mean()) if mask.any() else 0.0


def squared_error(x: Column, y: Column, available: Column) -> Column:
    """Squared error of a long row, null where the feature isn't available."""
    return F.when(available, (x - y) * (x - y))


@dataclass
class _Adam:
    rate: float
    state: dict = field(default_factory=dict)
    turn: int = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        if not np.isfinite(norm):
            return
        self.turn += 1
        scale = min(1.0, clip / max(norm, 1e-12))
        for k, g in grads.items():
            m, v = self.state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (scale * g - m)
            v += 0.001 * ((scale * g) ** 2 - v)
            params[k] -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8)


@dataclass
class Model:
    """Weights; ``encode`` gives the latent mean."""

    p: dict[str, np.ndarray]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["w1"] + self.p["b1"])

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.p["wm"] + self.p["bm"]

    def decode(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p["w2"] + self.p["b2"]) @ self.p["w3"] + self.p["b3"]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_arrays(x: np.ndarray, modality: np.ndarray, mask: np.ndarray, latent: int = 10, hidden: int = 64, epochs: int = 200, warmup: int = 40, batch: int = 256, kl: float = 0.01, adversary: float = 1.0, rate: float = 2e-3, seed: int = 0) -> Model:
    """Alternate the discriminator and the autoencoder; KL and adversary come in over ``warmup`` epochs."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    kinds = int(modality.max()) + 1 if n else 1
    init = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    p = {"w1": init(d, hidden), "b1": np.zeros(hidden), "wm": init(hidden, latent), "bm": np.zeros(latent), "wv": 0.1 * init(hidden, latent), "bv": np.full(latent, -2.0), "w2": init(latent, hidden), "b2": np.zeros(hidden), "w3": init(hidden, d), "b3": np.zeros(d)}
    q = {"d1": init(latent, hidden), "e1": np.zeros(hidden), "d2": init(hidden, kinds), "e2": np.zeros(kinds)}
    own, other = _Adam(rate), _Adam(rate)
    label = np.eye(kinds)[modality] if n else np.zeros((0, kinds))
    for epoch in range(epochs if n else 0):
        weight = min(1.0, epoch / max(1, warmup))
        order = rng.permutation(n)
        for at in range(0, n, batch):
            i = order[at : at + batch]
            xb, mb, yb, size = x[i] * mask[i], mask[i], label[i], len(i)
            h = np.tanh(xb @ p["w1"] + p["b1"])
            mean, log_var = h @ p["wm"] + p["bm"], np.clip(h @ p["wv"] + p["bv"], -8, 4)
            # the discriminator on fixed means
            g = np.tanh(mean @ q["d1"] + q["e1"])
            err = (_softmax(g @ q["d2"] + q["e2"]) - yb) / size
            back = err @ q["d2"].T * (1 - g**2)
            other.step(q, {"d2": g.T @ err, "e2": err.sum(0), "d1": mean.T @ back, "e1": back.sum(0)})
            # the autoencoder against it
            noise = rng.normal(size=mean.shape)
            sd = np.exp(0.5 * log_var)
            z = mean + sd * noise
            u = np.tanh(z @ p["w2"] + p["b2"])
            out = u @ p["w3"] + p["b3"]
            do = 2 * (out - xb) * mb / np.maximum(mb.sum(1, keepdims=True), 1) / size
            du = do @ p["w3"].T * (1 - u**2)
            dz = du @ p["w2"].T
            g = np.tanh(mean @ q["d1"] + q["e1"])
            dis = (_softmax(g @ q["d2"] + q["e2"]) - yb) / size
            fool = -(dis @ q["d2"].T * (1 - g**2)) @ q["d1"].T
            dm = dz + weight * (kl * mean / size + adversary * 0.1 * fool)
            dv = dz * noise * 0.5 * sd + weight * kl * 0.5 * (np.exp(log_var) - 1) / size
            dh = (dm @ p["wm"].T + dv @ p["wv"].T) * (1 - h**2)
            own.step(p, {"w3": u.T @ do, "b3": do.sum(0), "w2": z.T @ du, "b2": du.sum(0), "wm": h.T @ dm, "bm": dm.sum(0), "wv": h.T @ dv, "bv": dv.sum(0), "w1": xb.T @ dh, "b1": dh.sum(0)})
    return Model(p)


def fit(cells: DataFrame, features: int, max_cells: int = 5000, **options) -> tuple[Model, list[str]]:
    """``cells`` is (cell, modality_key, x array, available array); returns the model and the modalities in order."""
    sample = capped_sample(cells, "modality_key", "cell", max_cells).select("cell", "modality_key", "x", "available").toPandas().sort_values(["modality_key", "cell"])
    kinds = sorted(sample.modality_key.unique())
    x = np.array(sample.x.tolist(), float).reshape(-1, features)
    mask = np.array(sample.available.tolist(), float).reshape(-1, features)
    return fit_arrays(x, sample.modality_key.map(kinds.index).to_numpy(int) if len(sample) else np.zeros(0, int), mask, **options), kinds


def encode(cells: DataFrame, model: Model) -> DataFrame:
    """cell, modality_key and emb (the latent mean) of all cells, in Arrow batches."""
    shared = cells.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, here = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1)) for c in ("x", "available"))
            z = shared.value.encode(x * here) if n else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("modality_key"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))], names=["cell", "modality_key", "emb"])

    picked = cells.select("cell", "modality_key", F.col("x").cast("array<double>").alias("x"), F.col("available").cast("array<double>").alias("available"))
    return picked.mapInArrow(run, StructType([picked.schema["cell"], picked.schema["modality_key"], StructField("emb", ArrayType(DoubleType()))]))


def shared_features(entries: DataFrame, target: DataFrame, n_features: int) -> DataFrame:
    """Cells as dense arrays over the shared features: log-normalised, standardised, with availability.

    ``entries`` is (modality_key, cell, feature, value), ``target`` (feature, idx).
    """
    lib = entries.groupBy("modality_key", "cell").agg(F.sum("value").alias("_lib"))
    lognorm = entries.join(lib, ["modality_key", "cell"]).join(target, "feature").withColumn("v", F.log1p(F.col("value") * 1e4 / F.col("_lib")))
    n = lib.groupBy("modality_key").agg(F.count("*").alias("_n"))
    stats = lognorm.groupBy("modality_key", "idx").agg(F.sum("v").alias("_s"), F.sum(F.col("v") * F.col("v")).alias("_q")).join(n, "modality_key")
    mean = F.col("_s") / F.col("_n")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    of_feature = F.struct(F.col("idx").cast("int").alias("idx"), F.struct(mean.alias("m"), F.when(sd < 1e-6, 1.0).otherwise(sd).alias("s")).alias("v"))
    packed = stats.groupBy("modality_key").agg(F.array_sort(F.collect_list(of_feature)).alias("_e"))
    packed = packed.select("modality_key", dense(F.col("_e"), n_features, F.lit(None).cast("struct<m:double,s:double>")).alias("_stats"))
    rows = lognorm.groupBy("modality_key", "cell").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "v"))).alias("_e"))
    rows = rows.withColumn("_v", dense(F.col("_e"), n_features, F.lit(0.0))).drop("_e")
    x = F.zip_with("_v", "_stats", lambda v, s: F.coalesce((v - s["m"]) / s["s"], F.lit(0.0)))
    here = F.transform("_stats", lambda s: s.isNotNull().cast("double"))
    # a row a modality, each of n_features pairs
    return rows.join(F.broadcast(packed), "modality_key").select("cell", "modality_key", x.alias("x"), here.alias("available"))


def dense(entries: Column, size: int, empty: Column) -> Column:
    """Array of ``size`` from entries (idx, v) sorted by idx, in one pass; a repeated idx is an error."""
    before = F.slice(F.array_prepend(F.transform(entries, lambda e: e["idx"]), F.lit(-1)), F.lit(1), F.size(entries))
    parts = F.zip_with(entries, before, lambda e, last: F.when(e["idx"] > last, F.concat(F.array_repeat(empty, e["idx"] - last - 1), F.array(e["v"]))).otherwise(F.raise_error(F.concat(F.lit("two values of feature "), e["idx"].cast("string")))))
    rest = F.lit(size - 1) - F.coalesce(F.try_element_at(entries, F.lit(-1))["idx"], F.lit(-1))
    return F.concat(F.flatten(parts), F.array_repeat(empty, rest))
