"""Quality rules: base counts and a hashed n-gram logistic regression.

The model sees hashed word unigrams and bigrams and hashed character 2- to 4-grams (of code points),
each group divided by its size, so long and short texts weigh alike.  It is
trained on a bounded sample of labelled rows (``max_rows``, by hash order),
calibrated by Platt scaling on a fifth of them, and scores whole texts in Arrow
batches against fixed thresholds.

Defined cases: a null or empty text has no words and fails the base rule;
repeated rows each get their own result; labels that are null are not learned;
with no label, or one class only, the verdict is to keep what the base rule
keeps.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import keep

BITS = 16
GRAMS = (2, 3, 4)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WIDTH = 8
#: Calibrated probability from which a text is kept.
KEEP_FROM = 0.3
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"


@dataclass
class Model:
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -60, 60)))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], T.Spans, np.ndarray]:
    """The base counts of each row, its words and their hashes."""
    words = T.runs(data, offsets, T.SPACED)
    sums = T.prefix_sums(data)
    word_hash = T.hashes(sums, words.starts, words.ends, data)
    chars = (T.SPACED[data]) & ((data & 0xC0) != 0x80)

    lines = T.lines(data, offsets)
    filled = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_row = lines.rows()[filled]
    line_hash = T.hashes(sums, lines.starts[filled], lines.ends[filled], data)
    order = np.lexsort((line_hash, line_row))
    h, r = line_hash[order], line_row[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])

    begin, rows = T.window_rows(words, REPEAT_WIDTH)
    key = T.shingles(word_hash, REPEAT_WIDTH)[begin] if len(begin) else np.zeros(0, np.uint64)
    key = T.mix(key + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order2 = np.argsort(key)
    same = key[order2][1:] == key[order2][:-1]
    twice = np.zeros(len(key), bool)
    twice[order2[1:][same]] = True
    twice[order2[:-1][same]] = True
    repeated = T.covered(len(word_hash), begin[twice], REPEAT_WIDTH)

    return (
        {
            "n_words": words.count,
            "word_chars": T.row_sums(chars, offsets),
            "n_symbols": T.row_sums(SYMBOLS[data], offsets),
            "n_dup_lines": np.bincount(r[again], minlength=len(offsets) - 1),
            "n_repeat_words": T.row_sums(repeated, words.row),
        },
        words,
        word_hash,
    )


def _features(data: np.ndarray, offsets: np.ndarray, words: T.Spans, word_hash: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group of n-grams: buckets in text order, and each row's range of them."""
    shift = np.uint64(64 - bits)
    yield (T.mix(word_hash) >> shift).astype(np.int32), words.row
    begin, _ = T.window_rows(words, 2)
    pairs = T.shingles(word_hash, 2)
    yield (pairs[begin] >> shift).astype(np.int32) if len(begin) else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(np.maximum(words.count - 1, 0))])
    # a character is its lead byte and what follows, so those of several bytes stay whole
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    char, length = data[lead].astype(np.uint32), np.diff(np.append(lead, len(data)))
    for k in (1, 2, 3):
        wide = np.flatnonzero(length > k)
        char[wide] = char[wide] << np.uint32(8) | data[lead[wide] + k]
    offsets = np.searchsorted(lead, offsets)
    for n in GRAMS:
        size = max(0, len(char) - n + 1)
        code = np.full(size, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ char[k : k + size]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        per = np.maximum(np.diff(offsets) - n + 1, 0)
        row = np.concatenate([[0], np.cumsum(per)])
        if len(per) > 1:
            inside = np.ones(size, bool)
            for k in range(1, n):
                cut = offsets[1:-1] - k
                inside[cut[(cut >= 0) & (cut < size)]] = False
            code = code[inside]
        yield code.astype(np.int32), row


def _margins(data, offsets, words, word_hash, model: Model, bits: int) -> np.ndarray:
    total = np.zeros(len(offsets) - 1)
    for buckets, row in _features(data, offsets, words, word_hash, bits):
        total += T.row_sums(model.weights[buckets].astype(np.float64), row) / np.maximum(np.diff(row), 1)
    return total


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 2000, bits: int = BITS, steps: int = 60) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those of least hash, one text (the least) an id."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.pieces(batch.column("text")):
                words = T.runs(data, offsets, T.SPACED)
                word_hash = T.hashes(T.prefix_sums(data), words.starts, words.ends, data)
                per_row: list[tuple[list, list]] = [([], []) for _ in range(j - i)]
                for buckets, row in _features(data, offsets, words, word_hash, bits):
                    for d in range(j - i):
                        if row[d + 1] > row[d]:
                            b, n = np.unique(buckets[row[d] : row[d + 1]], return_counts=True)
                            per_row[d][0].append(b)
                            per_row[d][1].append((n / (row[d + 1] - row[d])).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("label").slice(i, j - i),
                        pa.array([np.concatenate(b).astype(np.int32).tobytes() if b else b"" for b, _ in per_row], pa.binary()),
                        pa.array([np.concatenate(v).tobytes() if v else b"" for _, v in per_row], pa.binary()),
                    ],
                    names=["doc_id", "label", "buckets", "amounts"],
                )

    texts = T.one_text(documents, chosen, ["label"])
    rows = texts.select("doc_id", "label", "text").mapInArrow(featurise, "doc_id bigint, label int, buckets binary, amounts binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.label > 0 for r in rows], float)
    if len(rows) < 2 or y.min() == y.max():
        return Model(np.zeros(1 << bits, np.float32), bias=20.0)
    fold = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~fold)
    cols = np.concatenate([np.frombuffer(rows[i].buckets, np.int32) for i in fit])
    vals = np.concatenate([np.frombuffer(rows[i].amounts, np.float32) for i in fit])
    size = np.array([len(rows[i].buckets) // 4 for i in fit])
    row = np.concatenate([[0], np.cumsum(size)])
    w = np.zeros(1 << bits)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(y[fit] > 0, 0.5 / max(y[fit].sum(), 1), 0.5 / max((1 - y[fit]).sum(), 1))
    b = 0.0
    for step in range(1, steps + 1):
        z = T.row_sums(w[cols] * vals, row) + b
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[fit]) * share
        grad = np.bincount(cols, weights=np.repeat(g, size) * vals, minlength=len(w)) + 1e-7 * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= 0.5 * g.sum()
    model = Model(w.astype(np.float32), b)
    z = np.array([float(w[np.frombuffer(r.buckets, np.int32)] @ np.frombuffer(r.amounts, np.float32)) + b if r.buckets else b for r, f in zip(rows, fold, strict=True) if f])
    model.slope, model.shift = _platt(z, y[fold])
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-out margins, by Newton's method."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = z.std() or 1.0
    x, a, c = z / scale, 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -60, 60)))
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        q = p * (1 - p) + 1e-9
        hess = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, c = a - step[0], c - step[1]
    return max(a, 1e-3) / scale, c


def score(documents: DataFrame, model: Model, keep_from: float = KEEP_FROM, bits: int = BITS) -> DataFrame:
    """Base counts, calibrated probability and verdict of each row."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.pieces(batch.column("text")):
                base, words, word_hash = base_counts(data, offsets)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                p = shared.value.probability(_margins(data, offsets, words, word_hash, shared.value, bits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_from))],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return keep(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA), "verdicts")
