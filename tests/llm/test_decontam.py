import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    probes = {}
    for i, t in items:
        w = words(t)
        k = min(width, len(w))
        for a in range(len(w) - k + 1) if k else ():
            probes.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for k in {len(p) for p in probes}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in probes:
                    hit |= set(range(a, a + k))
                    names |= {n for n in probes[tuple(w[a : a + k])] if n is not None}
        out.append((d, len(w), len(hit), sorted(map(str, names))))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{c}{k}" for c in "aé" for k in range(12)]
    text = lambda k: " ".join(rng.choice(vocabulary, k))
    items = [(k, text(int(rng.integers(1, 40)) if k % 4 else 30)) for k in range(12)] + [(90, None), (91, " ,, "), (None, text(12)), (92, "Short Item")]
    docs = []
    for k in range(n):
        body = text(int(rng.integers(0, 60)))
        if k % 3 == 0:
            w = words(items[int(rng.integers(len(items) - 4))][1])
            a = int(rng.integers(0, max(1, len(w) - 5)))
            body = body + "\n" + ", ".join(w[a : a + 25]).upper() + "! " + body
        docs.append((k, body))
    return docs + [(100, None), (101, ""), (101, items[0][1]), (None, items[0][1]), (102, "x " * 30_000 + items[0][1])], items


@pytest.mark.parametrize(("seed", "block"), [(0, decontam.BLOCK_BYTES), (1, 300), (2, 60)])
def test_matches_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1)).repartition(3)
    got = decontam.search(d, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str) == brute(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_longest_matches_have_places(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = [(1, "lead in " + " ".join(f"q{k}" for k in range(5, 27)) + " out")]
    got = decontam.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")).first()
    assert [(m["item"], m.item_word, m.word, m.words) for m in got.longest] == [("7", 5, 2, 22)]
    assert got.n_hit == 22


def test_clean_keeps_columns_and_clean_rows(spark):
    docs, items = corpus(4)
    d = spark.createDataFrame([(i, t, f"s{i}") for i, t in docs], "doc_id bigint, text string, `odd name.` string")
    kept = decontam.clean(d, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == d.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([x for x in docs if not brute([x], items)[0][2]], key=str)


def test_empty_tables(spark):
    docs, items = corpus(5)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontam.search(d.limit(0), b).count() == 0
    got = decontam.search(d, b.limit(0)).collect()
    assert len(got) == len(docs) and not any(r.contaminated for r in got)


def test_repetitive_items_and_texts_stay_small(spark):
    items = [(k, "ha " * 300) for k in range(40)] + [(90, "ha " * 9), (91, "ho " * 30 + "ha " * 5)]
    docs = [(k, "ha " * 4000 + "x " * k) for k in range(12)] + [(50, "ho " * 2000), (51, "ha " * 8)]
    got = decontam.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str) == brute(docs, items)


def test_deep_repeats_are_ordered_by_doubled_ranks():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.tile(rng.integers(1, 4, 40), 20), rng.integers(1, 3, 300), np.tile([1], 200), [0]]).astype(np.int64)
    starts = np.arange(len(text) - 1)
    for longest, doubling in ((7, 8), (200, 0), (200, 1e9), (900, 8)):
        sa = decontam.suffix_array(text, starts, 6, longest, doubling)
        padded = np.concatenate([text, np.zeros(longest, np.int64)])
        keys = [tuple(padded[s : s + longest]) for s in sa]
        assert keys == sorted(keys) and sorted(sa) == starts.tolist()


def test_classes_of_windows_are_listed_in_bounded_steps(monkeypatch):
    docs, items = corpus(6)
    block = decontam.Block.of([(str(i), t) for i, t in items], 10)
    data, offsets = decontam.T.buffers(decontam.pa.array([t for _, t in docs], decontam.pa.large_string()))
    whole = decontam.search_shard(block, data, offsets)
    monkeypatch.setattr(decontam, "LISTED", 1)
    parts = decontam.search_shard(block, data, offsets)
    assert (whole.items == parts.items).all() and whole.items.shape[1] > 2


def test_clean_with_clashing_columns_nulls_and_copies(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, item, 1, 2, 3), (1, item, 1, 2, 3), (None, None, None, None, None), (2, "", 1, 1, 1), (3, "clean", 4, 5, 6), (3, "clean", 4, 5, 6)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, key1 int, own int, `row` int")
    got = decontam.clean(d, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[2:], key=str)
    assert decontam.clean(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 6
