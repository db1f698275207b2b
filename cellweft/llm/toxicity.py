"""Toxicity: a factorization machine over hashed terms.

A text's terms are its lower-cased words and the words' first four, five and
six bytes, hashed; a term counts once a text.  Beside a weight, each
term has a short vector; the product of two terms' vectors weighs the pair, so
an insult scores otherwise beside a group than alone.

Training: at most ``max_rows`` labelled rows, those of least hash among rows
whose crc32(doc_id as text) mod 4 is not 2, one text an id (the least).  The
machine sees every term that ``min_share`` of the sampled texts hold (3 texts at
least), whatever its own relation to the label, so a pair can be learned of
which neither term shows anything alone.  Steps take an eighth of the rows; after
each, weights and vectors shrink towards zero, and what reaches it is no part of
the model.  Scores cover whole texts.

Defined cases: null and empty texts get the score of a text without terms;
null doc_ids are held in no fold and never learned; repeated rows score alike;
a doc_id with labels of both kinds counts as toxic; texts of any length are
scored whole; extra columns, such as label or score, are ignored; an empty table
gives an empty result;
without labels of both classes every score is the share of label 1 (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import keep

TOXIC_FROM = 0.3
BITS = 22
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    bias: float = -20.0
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    slope: float = 1.0
    shift: float = 0.0

    def score(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities; (row, term) are the kept terms of each row, once each."""
        z = self.bias + np.bincount(row, self.weights[term], rows)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            z += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every term, repeats included."""
    data = T.LOWER[data]
    words = T.runs(data, offsets, T.PLAIN)
    sums, rows = T.prefix_sums(data), words.rows()
    shift = np.uint64(64 - BITS)
    out, at = [T.hashes(sums, words.starts, words.ends, data) >> shift], [rows]
    for n in PREFIXES:
        long = words.ends - words.starts > n
        h = T.hashes(sums, words.starts[long], words.starts[long] + n, data)
        out.append(T.mix(h + np.uint64(n)) >> shift)
        at.append(rows[long])
    return np.concatenate(at), np.concatenate(out).astype(np.int32)


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 8000, min_share: float = 0.004, factors: int = 4, epochs: int = 30, seed: int = 7) -> Model:
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.pieces(batch.column("text")):
                row, bucket = _terms(data, offsets)
                pair = np.unique(row.astype(np.int64) << 32 | bucket)
                cut = np.searchsorted(pair, np.arange(j - i + 1) << 32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array([(pair[a:b] & 0xFFFFFFFF).astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                    names=["doc_id", "label", "terms"],
                )

    texts = T.one_text(documents, chosen, ["label"])
    rows = texts.select("doc_id", "label", "text").mapInArrow(featurise, "doc_id bigint, label int, terms binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.label > 0 for r in rows], float), min_share, factors, epochs, seed)


def fit(texts: list[np.ndarray], y: np.ndarray, min_share: float = 0.004, factors: int = 4, epochs: int = 30, seed: int = 7) -> Model:
    """Adam on the logistic loss with proximal shrinkage; ``texts`` are distinct terms."""
    if len(y) < 2 or y.min() == y.max():
        return Model(bias=20.0 if len(y) and y[0] else -20.0)
    size, cols = np.array([len(t) for t in texts]), np.concatenate(texts)
    found, inverse, count = np.unique(cols, return_inverse=True, return_counts=True)
    some = count >= max(3, int(min_share * len(y)))
    found, place = found[some], np.cumsum(some) - 1
    held = some[inverse]
    row, term = np.repeat(np.arange(len(y)), size)[held], place[inverse][held]
    cut = np.searchsorted(row, np.arange(len(y) + 1))
    rate, k = y.mean(), len(found)
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(rate / (1 - rate))], np.float32), np.zeros(k, np.float32), rng.normal(0, 0.1, (k, factors)).astype(np.float32)]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    step = 0
    for epoch in range(epochs):
        pace = 0.03 * (1 - 0.9 * epoch / epochs)
        for part in np.array_split(rng.permutation(len(y)), 8):
            if not len(part):
                continue
            step += 1
            n = cut[part + 1] - cut[part]
            r = np.repeat(np.arange(len(part)), n)
            t = term[np.repeat(cut[part] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            b, w, v = params
            own = v[t]
            sums = np.stack([np.bincount(r, own[:, f], len(part)) for f in range(factors)], 1)
            z = b[0] + np.bincount(r, w[t], len(part)) + 0.5 * ((sums * sums).sum(1) - np.bincount(r, (own * own).sum(1), len(part)))
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[part]) / len(part)
            on = g[r]
            dw = np.bincount(t, on, k)
            dv = np.stack([np.bincount(t, on * sums[r, f], k) for f in range(factors)], 1) - dw[:, None] * v
            for p, d, m, s in zip(params, (np.array([g.sum()]), dw, dv), first, second, strict=True):
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - pace * 0.2, 0))
            v *= np.maximum(0, 1 - pace * 0.1 / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-12))
    live = (params[1] != 0) | (params[2] != 0).any(1)
    return Model(float(params[0][0]), found[live].astype(np.int32), params[1][live].astype(float), params[2][live].astype(float))


def score(documents: DataFrame, model: Model, toxic_from: float = TOXIC_FROM) -> DataFrame:
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = np.full(1 << BITS, -1, np.int32)
        lookup[model.buckets] = np.arange(len(model.buckets))
        for batch in batches:
            for i, j, data, offsets in T.pieces(batch.column("text")):
                row, bucket = _terms(data, offsets)
                term = lookup[bucket]
                row, term = row[term >= 0], term[term >= 0]
                pair = np.unique(row.astype(np.int64) << 32 | term)
                p = model.score(pair >> 32, pair & 0xFFFFFFFF, j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(p), pa.array((p >= toxic_from).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int"), "scores")
