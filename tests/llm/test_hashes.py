"""Words and lines that a polynomial modulo 2^64 cannot tell apart, whatever its base."""

import numpy as np
import pyarrow as pa
import pytest

from cellweft.llm import _text as T
from cellweft.llm import decontam, linededup, neardup, quality


def morse(n):
    """The Thue-Morse word of n letters and its complement."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


SIZES = [1 << k for k in range(10, 17)]


@pytest.mark.parametrize("n", SIZES)
def test_words_are_told_apart(n):
    one, other = morse(n)
    text = f"{one} {other} x{one} {one}"
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    words = T.runs(data, offsets, T.SPACED)
    a, b, c, d = T.hashes(T.prefix_sums(data), words.starts, words.ends, data)
    assert a == d and len({a, b, c}) == 3
    plain = T.mix((T.prefix_sums(data)[words.ends] - T.prefix_sums(data)[words.starts]) * T._powers.get(len(data) + 1)[1][words.starts])
    assert n < 4096 or plain[0] == plain[1]  # what the hash alone would say


@pytest.mark.parametrize("n", SIZES[::3])
def test_lines_and_windows(n):
    one, other = morse(n)
    texts = [f"{one}\n{other}\n", f"{one}\n{one}", " ".join([one, *"abcdefg", other, *"abcdefg"]), " ".join([one, *"abcdefg"] * 2)]
    got = []
    for _, _, data, offsets in T.pieces(pa.array(texts)):
        base, _, _ = quality.base_counts(data, offsets)
        got += list(zip(base["n_dup_lines"].tolist(), base["n_repeat_words"].tolist(), strict=True))
    assert got == [(0, 0), (1, 0), (0, 0), (0, 16)]


def test_benchmark_words(spark):
    one, other = morse(4096)
    docs = spark.createDataFrame([(1, f"so {other} it is"), (2, f"so {one} it is"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([("x", one)], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in decontam.search(docs, items).collect()} == {1: (0, False), 2: (1, True), 3: (0, False)}


def test_lines_of_templates(spark):
    one, other = morse(2048)
    rows = [(k, f"the {one} of all\nand on") for k in range(4)] + [(9, f"the {other} of all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.row.doc_id: r.row.text for r in linededup.dedup(docs).collect()}
    assert sum(one in t for t in kept.values()) == 1
    assert kept[9] == rows[-1][1]


def test_near_duplicates(spark):
    one, other = morse(4096)
    docs = spark.createDataFrame([(1, one), (2, other), (3, one + " ")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
