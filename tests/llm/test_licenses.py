from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweft.llm import licenses


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) <= lcs(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == lcs(a, b)


MIT = licenses.TEMPLATES["MIT-text"]


def test_finds_licenses_in_whole_texts(spark):
    filler = " ".join(f"word{k}" for k in range(20_000))
    cut = MIT.split()
    edited = " ".join(w if k % 12 else "changed" for k, w in enumerate(cut))
    rows = [(1, MIT), (2, filler + "\n// " + MIT.upper() + "\n" + filler), (3, edited), (4, "the of and software " * 50), (5, None), (6, ""), (7, "Released under the MIT License.\n" * 3), (7, "Released under the MIT License.\n" * 3), (None, filler), (8, " ".join(cut[: len(cut) // 2])), (9, "This work is licensed under the GNU General Public License, version 3.\nx\nLicensed under CC BY-NC 4.0.")]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("licenses", F.lit(3))).collect():
        got[r.doc_id] = r.licenses
    assert [x["license"] for x in got[1]] == ["MIT-text"] and got[1][0]["coverage"] == 1
    assert got[2][0]["license"] == "MIT-text" and got[2][0]["first"] == 20_000 and got[2][0]["end"] == 20_000 + len(licenses.template_words({"x": MIT})["x"])
    assert got[3][0]["license"] == "MIT-text" and 0.8 <= got[3][0]["coverage"] < 1
    assert got[4] == got[5] == got[6] == got[None] == got[8] == []
    assert [x["license"] for x in got[7]] == ["MIT"]
    assert {x["license"] for x in got[9]} == {"GPL-3.0", "CC-BY-NC-4.0"}


def test_own_templates_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "keep this notice")], "doc_id bigint, text string")
    assert licenses.scan(docs, {"own": "Keep this notice", "void": "..."}).first().licenses[0]["license"] == "own"
    assert licenses.scan(docs, {}).first().licenses == []
    assert licenses.scan(docs.limit(0)).count() == 0


def test_a_stretched_notice_is_found_wherever_it_begins():
    template = list(range(40))
    kept = [w for w in template if w % 10 != 3]  # 0.9 of it, stretched to 1.7 lengths
    notice, extra = [], iter(range(10**6, 2 * 10**6))
    for k, w in enumerate(kept):
        notice += [w] + [next(extra) for _ in range(1 if k % 9 else 0)]
    assert 60 < len(notice) <= 70
    for before in range(90):
        text = [next(extra) for _ in range(before)] + notice + [next(extra) for _ in range(50)]
        assert licenses.find(text, {"t": template}) == [("t", 0.9, before, before + len(notice) - 1 + (notice[-1] < 40))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 14), max_size=80), st.integers(1, 10))
def test_finds_what_aligning_every_block_finds(words, n):
    template = list(range(n))
    found = licenses.find(words, {"t": template})
    every = [licenses.align(words[s : s + 2 * n], template) for s in range(0, len(words), max(1, n // licenses.STEPS))]
    best = max((len(p) for p in every), default=0)
    assert [f[1] for f in found] == ([best / n] if best >= licenses.COVERAGE * n and words else [])
    whole = [s for s in range(len(words) - n + 1) if words[s : s + n] == template]
    assert not whole or found[0][1] == 1 and found[0][3] - found[0][2] >= n
