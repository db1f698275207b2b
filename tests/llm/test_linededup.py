import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cellweft.llm import _text as T
from cellweft.llm import linededup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def masked(line):
    words = SPACED.findall(line)
    out = tuple("<*>" if re.search("[0-9]", w) else w for w in words)
    if set(out) == {"<*>"}:
        return tuple(words) if len(words) >= linededup.MIN_VARIABLES else None
    return out or None


def leaves(words, similar=0.7):
    """Every leaf of a line, word by word, but for those that another one generalises."""
    n, head = len(words), words[: linededup.DEPTH]
    rest = words[linededup.DEPTH :]
    cut = [len(rest) * b // linededup.BLOCKS for b in range(linededup.BLOCKS + 1)]
    parts = [rest[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    free = n - int(np.ceil(similar * n - 1e-9))
    full = [b for b, p in enumerate(parts) if p]
    able = [set(c) for k in range(linededup.VARIABLE + 1) for c in combinations(full, k) if sum(len(parts[b]) for b in c) <= free]
    able = [c for c in able if not any(c < d for d in able)]
    return {(n, head, tuple("<any>" if b in c else p for b, p in enumerate(parts))) for c in able}


def brute(rows, min_docs=3, similar=0.7):
    lines, docs = {}, {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            m = masked(line)
            if m is not None:
                lines.setdefault(m, set()).add(-(1 << 63) if i is None else i)
    for m, ids in lines.items():
        for leaf in leaves(m, similar):
            docs.setdefault(leaf, set()).update(ids)

    def code(m, leaf):
        """The least hash decides between templates of equally many documents: found through the operator's own numbers."""
        return numbers[m][leaf]

    numbers = {}
    for m in lines:
        data, offsets = T.buffers(pa.array([" ".join("0" if w == "<*>" else w for w in m)]))
        p = linededup.Parsed(data, offsets)
        _, got = p.templates(np.arange(1), similar)
        own = sorted(leaves(m, similar), key=lambda x: [b for b, y in enumerate(x[2]) if y == "<any>"])
        assert len(own) == len(got)
        numbers[m] = dict(zip(own, got.view(np.int64).tolist(), strict=True))
    chosen, first = {}, {}
    for m, ids in lines.items():
        able = [x for x in numbers[m] if len(docs[x]) >= min_docs]
        if able:
            best = max(able, key=lambda x: (len(docs[x]), -code(m, x)))
            chosen[m] = best
            first[best] = min(first.get(best, min(ids)), min(ids))
    out = []
    for i, text in rows:
        kept, gone = [], []
        for k, line in enumerate((text or "").split("\n")):
            m = masked(line)
            drop = m in chosen and first[chosen[m]] != (-(1 << 63) if i is None else i)
            (gone if drop else kept).append(k if drop else line)
        out.append((i, None if text is None else "\n".join(kept), gone))
    return sorted(out, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    rows = []
    for k in range(60):
        lines = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(6)]
        if k % 2:
            lines.append(f"{k} 1{k} 2 {k}x" if k % 4 == 1 else "7 8 9 10 11 12 13")
            lines.insert(2, f"Copyright {1990 + k} by the makers of page {k}")
        if k % 3 == 0:
            lines.append(f"user {rng.choice(words)} has logged in from {rng.choice(words)} here today again please")
        if k % 5 == 0:
            lines.append("user wa has logged in from wb here today again please")
        rows.append((k, "\n".join(lines)))
    return [*rows, (None, "Copyright 5 by the makers of page 1"), (100, None), (101, ""), (102, "\n\n"), (103, "Copyright 1 by the makers of page 9\n" * 3), (104, "x " * 20_000 + "\nCopyright 1 by the makers of page 9")]


def result(docs, **options):
    return sorted([(r.row.doc_id, r.row.text, list(r.dropped)) for r in linededup.dedup(docs, **options).collect()], key=str)


@pytest.mark.parametrize(("seed", "bound"), [(0, 10**6), (0, 0), (3, 10**6), (3, 0)])
def test_matches_a_plain_tree_both_ways(spark, seed, bound):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, n_lines int").repartition(4)
    assert linededup.dedup(docs, broadcast_lines=bound).select("row.*").columns == docs.columns
    assert result(docs, broadcast_lines=bound) == brute(rows)


def test_most_general_leaves_by_length():
    for n in (1, 3, 4, 6, 7, 9, 10, 11, 12, 13, 40):
        data, offsets = T.buffers(pa.array([" ".join(f"w{chr(97 + k % 26)}{'x' * k}" for k in range(n))]))
        rows, got = linededup.Parsed(data, offsets).templates(np.arange(1))
        assert len(set(got.tolist())) == len(got) == len(leaves(tuple(range(n)))) and not rows.any()


def test_thousands_of_close_lines_in_one_leaf_whatever_the_layout(spark):
    rng = np.random.default_rng(8)
    words = [f"n{chr(97 + k)}{chr(97 + j)}" for k in range(26) for j in range(4)]
    rows = [(k, f"the same event: {' '.join(rng.choice(words[:4], 7))}\nthe same event: {rng.choice(words)} moved {rng.choice(words)} out of here ok") for k in range(3000)]
    want = brute(rows)
    assert sum(1 in d for _, _, d in want) == 2999 and 500 < sum(0 in d for _, _, d in want) < 2999
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts, bound, batch in ((1, 10**6, 10_000), (7, 10**6, 50), (31, 0, 10_000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert result(docs.repartition(parts), broadcast_lines=bound) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_other_lines_of_a_leaf_stay(spark):
    rng = np.random.default_rng(8)
    words = [f"n{chr(97 + k)}{chr(97 + j)}" for k in range(26) for j in range(4)]
    rows = [(k, f"the same event: {rng.choice(words)} moved {rng.choice(words)} out of here\n{' '.join(rng.choice(words, 9))}\nthe same event: {' '.join(rng.choice(words, 6))}") for k in range(80)]
    got = result(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert sum(0 in d for _, _, d in got) == 79 and not any(1 in d or 2 in d for _, _, d in got)


def test_lines_that_two_share_do_not_recur(spark):
    rows = []
    for k in range(60):
        a, b = (f"f{chr(97 + k % 26)}{chr(97 + k // 26)} b c d {rest}" for rest in ("e f g", "h i j"))
        rows += [(4 * k + i, f"{start} {end}") for i, (start, end) in enumerate([(a, "p q r"), (a, "s t u"), (b, "v w x"), (b, "y z o")])]
    assert not any(d for _, _, d in result(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))


def test_repeated_rows_and_null_ids(spark):
    line = "all rights of this are reserved"
    rows = [(None, line), (None, line), (1, line), (1, line), (2, line), (3, f"{line}\nown words stay here")]
    for bound in (10**6, 0):
        got = linededup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), broadcast_lines=bound).collect()
        assert sorted([(str(r.row.doc_id), r.row.text) for r in got]) == sorted([("None", line)] * 2 + [("1", "")] * 2 + [("2", ""), ("3", "own words stay here")])
    assert linededup.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_document_alone_never_recurs(spark):
    got = linededup.dedup(spark.createDataFrame([(1, "say it again now\n" * 50), (2, "say it again now")], "doc_id bigint, text string")).collect()
    assert all(not r.dropped for r in got)


def test_short_lines_recur_but_numbers_alone_do_not(spark):
    rows = [(k, f"Les.\nAnd ornd.\npage {k}\n{k}\n{k} 1{k}\nown{chr(97 + k)}") for k in range(4)]
    for bound in (10**6, 0):
        got = linededup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), broadcast_lines=bound).collect()
        assert sorted((r.row.doc_id, r.dropped) for r in got) == [(0, []), *((k, [0, 1, 2]) for k in (1, 2, 3))]


def test_rows_of_numbers_are_no_template(spark):
    rows = [(k, f"{k} {k + 1} {k + 2} {k + 3}\n904 905 906 907") for k in range(50)]
    got = result(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [d for _, _, d in got] == [[], *([[1]] * 49)]
