import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweft.llm import _text as T
from cellweft.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#| 𝄞", max_size=80)), max_size=6))
def test_base_counts_match_brute_force(texts):
    got = []
    for _, _, data, offsets in T.pieces(pa.array(texts, pa.string())):
        base, _, _ = quality.base_counts(data, offsets)
        got += np.stack([base[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], 1).tolist()
    assert got == [brute(t) for t in texts]


def sample(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for k in range(240):
        body = " ".join(rng.choice(words, rng.integers(30, 90)))
        if k % 3 == 0:
            body = body.upper().replace(" ", "!! ")
        docs.append((k, body, "en", 0.5))
        labels.append((k, int(k % 3 != 0)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, label string, probability double"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_learns_and_keeps_clean_text(spark):
    docs, labels = sample(spark)
    model = quality.train(docs, labels, max_rows=150)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    right = sum(got[k].kept == (k % 3 != 0) for k in got)
    assert right / len(got) > 0.97
    assert all(0 <= r.probability <= 1 for r in got.values())


def test_odd_rows_have_defined_results(spark):
    docs, labels = sample(spark)
    model = quality.train(docs, labels, max_rows=60)
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word " * 50), (3, "x" * 200_000), (4, " ".join(f"w{i}" for i in range(60_000)))], "doc_id bigint, text string")
    got = quality.score(odd, model).orderBy("n_words").collect()
    assert len(got) == 6 and [r.base_failed for r in got] == [True] * 5 + [False]
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.score(docs.limit(0), model).count() == 0


def test_no_labels_keep_what_the_base_rule_keeps(spark):
    docs, labels = sample(spark)
    for table in (labels.limit(0), labels.where("quality = 1"), labels.selectExpr("doc_id", "cast(null as int) as quality")):
        got = quality.score(docs, quality.train(docs, table))
        assert got.where("kept = base_failed").count() == 0


def test_character_grams_are_of_code_points():
    texts = ["aé𝄞b", "", "é", "日本語です"]
    for _, _, data, offsets in T.pieces(pa.array(texts)):
        words = T.runs(data, offsets, T.SPACED)
        groups = list(quality._features(data, offsets, words, T.hashes(T.prefix_sums(data), words.starts, words.ends, data), 16))
    for n, (buckets, row) in zip(quality.GRAMS, groups[2:], strict=True):
        assert np.diff(row).tolist() == [max(0, len(t) - n + 1) for t in texts] and len(buckets) == row[-1]
    assert len(set(groups[2][0].tolist())) == 7
