import math

import numpy as np

from cellweft.llm import hardneg
from cellweft.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, cell string, page string"


def brute(rows):
    """rows of (vec_id, embedding, label) as op11 reads them: its whole result."""
    kept = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            if vec_id is not None and vec_id % 7 == 0:
                label = (label + 1) % 10
            kept.append((vec_id, [min(max(math.floor(256 * x), -(1 << 63)), (1 << 63) - 1) for x in vector], label))
    out = []
    for k, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        score = [max(min(sum(x * y for x, y in zip(a, b)), (1 << 63) - 2), 2 - (1 << 63)) for _, b, _ in kept]
        order = sorted((j for j in range(len(kept)) if j != k), key=lambda j: (-score[j], kept[j][0] is None, kept[j][0] or 0))
        for i in [j for j in order if kept[j][2] == label][:5]:
            p = score[i]
            fits = [j for j in order if kept[j][2] != label and 50 * p <= 100 * score[j] <= 95 * p][:3]
            out += [(anchor, kept[i][0], r, kept[j][0], p, score[j]) for r, j in enumerate(fits, 1)]
    return sorted(out, key=str)


def run(spark, rows, tmp_path, name):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    table.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    got = QUERIES["op11_hard_negatives"](spark, f"{tmp_path}/{name}")
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def clustered(n, width=16, seed=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, width))
    which = rng.integers(0, 6, n)
    x = middles[which] + 0.7 * rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(k, v.tolist(), int(w)) for k, (v, w) in enumerate(zip(x, (which + (rng.random(n) < 0.3)) % 10, strict=True))]


def test_matches_brute_force(spark, tmp_path, monkeypatch):
    # small leaves, so that pruning has something to prune
    for name, value in {"CHUNK": 64, "LEAF": 8, "BLOCK": 8, "TWIG": 2, "TOGETHER": 200, "PAGE": 5}.items():
        monkeypatch.setattr(hardneg, name, value)
    rows = clustered(1500)
    rows += [(k, rows[50][1], 3) for k in range(2000, 2400)]  # one very common vector
    assert run(spark, rows, tmp_path, "many") == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = clustered(300)
    one = rows[100]
    rows += [(400, None, 1), (450, [0.5, None], 1), (500, [float("nan")] * 16, 1), (550, [float("inf")] * 16, 2), (600, one[1], None), (None, one[1], 2), (None, one[1], 5)]
    rows += [one, one, (650, [], 1), (700, [0.5], 1), (750, one[1][:5], 2), (800, [0.0] * 16, 2)]
    assert run(spark, rows, tmp_path, "odd") == brute(rows)
    for name, few in (("none", []), ("one", rows[:1]), ("no anchors", [r for r in rows[:300] if r[0] % 50])):
        assert run(spark, few, tmp_path, name) == brute(few)
    huge = [(k, [1e300 * (k % 3), -1e17, 3e18], k % 4) for k in range(120)]
    assert run(spark, huge, tmp_path, "huge") == brute(huge)


def test_intervals_hold_every_product():
    rng = np.random.default_rng(1)
    v = rng.integers(-256, 257, (600, 12))
    starts = np.arange(0, 600, 20)
    nodes = hardneg.Nodes.of(v, np.zeros(600, np.int64), np.arange(600), starts)
    low, high = nodes.interval(nodes)
    products = (v @ v.T).reshape(30, 20, 30, 20)
    assert (low <= products.min(axis=(1, 3))).all() and (high >= products.max(axis=(1, 3))).all()


def test_leaves_prune(spark):
    """Far groups of candidates are not scored."""
    rng = np.random.default_rng(2)
    middles = np.eye(8) * 200
    v = np.concatenate([m + rng.integers(-5, 6, (64, 8)) for m in middles]).astype(np.int64)
    labels = np.tile(np.arange(2), 256)
    kind = hardneg.Kind.of(8, 300)
    chunk = hardneg.Group(v, np.arange(512), np.arange(512), labels, np.arange(0, 512, 64))
    block = hardneg.Group(v[:8], np.arange(8), np.arange(8), labels[:8], np.zeros(1, np.int64))
    at = np.arange(8)
    windows = hardneg.Windows(at, at, np.full(8, 20_000), np.full(8, hardneg.MOST), np.full(8, hardneg.LEAST), np.full(8, hardneg.MOST))
    met = block.nodes().meet(chunk.nodes(), windows.needs(block.starts), True)
    assert met.tolist() == [[True] + [False] * 7]
    got = list(hardneg._leaf_pairs(block, windows, chunk, kind, True, 5))
    assert len(got) == 1 and (got[0][3] < 64).all()
