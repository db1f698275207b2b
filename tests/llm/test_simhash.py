import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellweft.llm import simhash


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(ids, prints, distance=4):
    root = np.arange(len(prints))
    p = np.array(prints, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None]) <= distance, 1))
    simhash._union(root, a, b)
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return [least[r] for r in root]


TEXTS = ["A b\tC d", "a b c d", "é É x", None, "", " \n ", "one", "the cat sat on the mat " * 200, "the cat sat on the mat " * 200 + "today", "x" * 50_000, "a b c d e f g", "word " * 3]


def test_fingerprints_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert got == {k: fingerprint(t) for k, t in enumerate(TEXTS)}
    # the shingle hash is the engine's own, too
    one = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert one % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def clumps(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 6, dtype=np.uint64)
    out = list(rng.integers(0, 1 << 63, n // 4, dtype=np.uint64))
    while len(out) < n:
        v = centres[rng.integers(6)]
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            v ^= np.uint64(1) << np.uint64(b)
        out.append(v)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_all_components(seed):
    key = np.unique(clumps(seed) & np.uint64((1 << 40) - 1))
    a, b = simhash.trie_links(np.zeros(len(key), int), key, 40, 4)
    assert (np.bitwise_count(key[a] ^ key[b]) <= 40).all()
    root = np.arange(len(key))
    simhash._union(root, a, b)
    assert root.tolist() == classes(range(len(key)), key)


@pytest.mark.parametrize(("large", "blocks"), [(4096, None), (8, 5), (4096, 6), (16, 6)])
def test_links_connect_what_brute_force_connects(spark, large, blocks):
    key = clumps(11)
    distinct = spark.createDataFrame([(int(v),) for v in key.view(np.int64)], "fp bigint").repartition(3)
    roots = {r.node: r.root for r in simhash.components(simhash.links(distinct, large=large, blocks=blocks)).collect()}
    got = [roots.get(int(v), int(v)) for v in key.view(np.int64)]
    want = classes(range(len(key)), key)
    pairs = {}
    for g, w in zip(got, want, strict=True):
        assert pairs.setdefault(g, w) == w
    assert len(set(got)) == len(set(want))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}


def test_near_duplicates_with_odd_rows(spark):
    rows = [(10, TEXTS[7]), (3, TEXTS[8]), (4, None), (5, ""), (None, "unlike anything else here at all"), (7, "own words"), (7, "own words"), (8, "own words")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("x"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert len(got) == len(rows)
    assert by == {10: {3}, 3: {3}, 4: {4}, 5: {4}, None: {None}, 7: {7}, 8: {7}}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
