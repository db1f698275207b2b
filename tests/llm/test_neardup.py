import numpy as np
import pytest

import corpus_pipeline
from cellweft.llm import neardup, simhash

ROW = "doc_id bigint, text string"


def family(seed, n=40, words=200):
    """A text and copies of it with ever more words put in, and texts of their own."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10_000, words)]
    rows = []
    for k in range(n):
        copy = list(base)
        for at in rng.integers(0, words, k % 12):
            copy[at] = f"X{rng.integers(10_000)}"
        rows.append((k, " ".join(copy)))
    return [*rows, *((n + k, " ".join(f"v{x}" for x in rng.integers(0, 10_000, 60))) for k in range(10)), (n + 20, "too short"), (n + 21, "Too  SHORT"), (n + 22, None), (n + 23, " \n"), (None, "short too")]


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if same * 5 >= both * 4:
                x, y = part[a], part[b]
                part = [y if p == x else p for p in part]
    ids = [i for i, _ in rows]
    return sorted(((i, min((j for j, q in zip(ids, part, strict=True) if q == p and j is not None), default=None)) for i, p in zip(ids, part, strict=True)), key=str)


@pytest.mark.parametrize(("seed", "large"), [(0, 512), (0, 5), (1, 5)])
def test_components_are_those_of_all_pairs(spark, seed, large):
    rows = family(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, ROW).repartition(4), large=large).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(rows)


def test_meeting_in_columns_gives_what_all_pairs_give(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 4))])) for _ in range(30)]
    root = np.where(np.arange(30) < 4, 99, np.arange(30))
    one, two = neardup.stars(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), root, 80)
    want, got = np.arange(30), np.arange(30)
    similar = [(a, b) for a in range(30) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    for part, pairs in ((want, similar), (got, list(zip(one.tolist(), two.tolist(), strict=True)))):
        pairs += [(0, 1), (0, 2), (0, 3)]
        simhash._union(part, *np.array(pairs).T)
    assert (want == got).all() and len(one) < 30


def test_pipeline_drops_copies_at_similarity_0_8(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 10_000, 300)]
    near, far = list(words), list(words)
    near[20:290:60] = ["x"] * 5  # 25 of 296 shingles
    far[10:290:20] = ["y"] * 14  # 70 of 296
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(far), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) == 3
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
