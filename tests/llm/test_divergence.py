import re
from collections import Counter

from cellweft.llm import divergence


def brute(rows, least=10, top=10):
    rows = [tuple("" if x is None else x for x in r) for r in rows]
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, n = Counter(), Counter()
    for lang, source, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in term.findall(text)]
        docs.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    out = []
    for lang in {r[0] for r in rows}:
        vocabulary = [w for (x, w), k in docs.items() if x == lang and k >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        count = {s: {w: n[lang, s, w] for w in vocabulary} for s in sources}
        whole = {w: sum(count[s][w] for s in sources) for w in vocabulary}

        def shares(c, v=len(vocabulary)):
            total = sum(c.values())
            return {w: 1 + 10**9 * (k + 2) // (total + 2 * v) for w, k in c.items()}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(count[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in vocabulary), o.encode()) for o in sources if o != s))
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in vocabulary if count[s][w] and p[s][w] > q[w])
            out += [(lang, s, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(pairs, 1)]
            out += [(lang, s, "term", i.decode(), -v, r) for r, (v, i) in enumerate(terms[:top], 1)]
    return sorted(out)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(k, *r, "clash", 1) for k, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string, term string, n int")
    return sorted(tuple(r) for r in divergence.audit(frame, **more).select("lang", "source", "part", "item", "value", "rank").collect())


WORDS = ["the", "The", "naïve", "straße", "é", "İi", "x1y", "don't", "日本", "zz", "common-word", "ſ", "q" * 3000]


def corpus():
    rows = []
    for k in range(240):
        text = " ".join(WORDS[(k * j * j + j) % len(WORDS)] for j in range(k % 17)) + "\n\x00tail" * (k % 3)
        rows.append((["en", "de", None, ""][k % 4], [None, "a", "A", "ä", "b\x7f", "z"][k * k % 11 % 6], text if k % 13 else None))
    # a language without kept terms, a lone source, a group without terms, repeated rows, a hot source
    rows += [("xx", "a", "one two"), ("xx", "b", "three"), ("yy", "a", "word " * 20)]
    rows += [("en", "empty", "12 34"), ("en", "empty", "")] + [("de", "a", "same words again")] * 100
    return rows


def test_matches_brute_force(spark):
    assert run(spark, corpus()) == brute(corpus())
    assert run(spark, corpus(), least=1, top=2) == brute(corpus(), 1, 2)
    assert run(spark, []) == []


def test_flushes_and_segments_do_not_matter(spark, monkeypatch):
    rows = corpus() + [("en", "long", "alpha beta " * 20_000 + "gamma" * 10)] * 11
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    monkeypatch.setattr(divergence, "SEGMENT", 100)
    assert run(spark, rows) == brute(rows)


def test_shares_of_large_counts_are_exact(spark):
    frame = spark.createDataFrame([(10**13 + 7, 3 * 10**14 + 1, 10**9)], "n bigint, total bigint, v bigint")
    got = frame.select(divergence._p(frame.n, frame.total, frame.v)).first()[0]
    assert got == 1 + 10**9 * (10**13 + 9) // (3 * 10**14 + 1 + 2 * 10**9)
