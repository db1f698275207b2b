"""Divergence of sources: how far the terms of each source of a language are from those of the others.

Each language keeps the terms that at least ``LEAST`` of its documents hold, V in
number.  Every (lang, source) group and each language as a whole gives each kept
term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), where N is its count of kept
terms; two of them differ at a term by f = floor((p - q)^2 / (p + q)).

Most terms are missing in most groups, so a pair's sum starts at V times f of zero
counts, and an inverted index of terms brings the corrections, none of which is
zero by rule: what a group's own terms change against a zero count of the other
depends on the count alone, so it is summed by distinct p and not by term; what
terms that both hold change beyond that comes from the postings of each term, which
meet in a self-join and are added up before the shuffle.  The terms that set a
group apart from its language are ranked by a window with a limit.

Counting is done in tasks, on bytes: each emits a row for a term and group with the
documents and occurrences that it has seen, and starts anew after ``ENTRIES`` rows,
so memory is bounded and no hot source or term travels row by row.  Sums are exact:
p is divided in decimals, all else fits 64 bits.

Defined cases: null text, lang and source are empty strings; rows alike in doc_id
are documents of their own; a text without a term counts as a document of its
group; a language without kept terms has pairs of value 0; a group alone in its
language has no pair; equal values rank by the UTF-8 bytes of the item; an empty
table gives no row; texts are taken in segments; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import bounded, keep

#: Documents of a language that must hold a term.
LEAST = 10
#: Terms that are returned for a group.
TOP = 10
#: Term and group rows that a task holds at once, and bytes of a text that are split at once.
ENTRIES = 200_000
SEGMENT = 1 << 20
SCALE = 1_000_000_000

# Bytes of terms once A-Z are lower-cased: letters and all beyond ASCII; others part them.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _segments(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, segment by segment."""
    at = 0
    while at < len(text):
        cut = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]").search(text, at + SEGMENT)
        last = cut.start() if cut else len(text)
        yield text[at:last].translate(_TERMS).split()
        at = last


def counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, docs (that hold it) and n (occurrences), to be summed; a row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (docs, n) in groups.items():
                size = len(n) + 1
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array([None, *n], pa.string()), pa.array([0, *(docs[t] for t in n)], pa.int64()), pa.array([0, *n.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "n"])

        held = 0
        for batch in batches:
            texts = batch.column("text")
            for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                docs, n = groups.setdefault(key, (Counter(), Counter()))
                before, own = len(n), set()
                for terms in _segments(texts[i].as_py()):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                held += len(n) - before
                if held > ENTRIES:
                    yield from emit()
                    groups, held = {}, 0
        yield from emit()

    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, docs bigint, n bigint")


def _p(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; total and terms are those of the group and language."""
    wide = "decimal(20,0)"
    return F.call_function("div", ((count + 2).cast(wide) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(30,0)"), (total + 2 * terms).cast("decimal(30,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    dealt = counts(documents).repartition("lang", "term")
    held = dealt.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    of_term = Window.partitionBy("lang", "term")
    known = {"seen": F.sum("docs").over(of_term), "every": F.sum("n").over(of_term), "first": F.col("source") == F.min("source").over(of_term)}
    held = keep(held.withColumns(known).where(F.col("term").isNull() | (F.col("seen") >= least)).select("lang", "term", "source", "n", "every", "first"), "index")

    names, index = held.where("term is null").select("lang", "source"), held.where("term is not null")
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = index.where("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("every").alias("whole"))
    groups = names.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "whole"])
    groups = keep(groups.withColumn("zero", F.when(F.col("terms") > 0, _p(F.lit(0), F.col("total"), F.col("terms")))), "groups")
    known = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "total", "terms", "whole", "zero")
    index = keep(index.join(bounded(known), (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))).select("lang", "term", "source", "zero", _p(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _p(F.col("every"), F.col("whole"), F.col("terms")).alias("q")), "shares")

    # a group's own terms against a zero count, by distinct p
    others = groups.select(F.col("lang").alias("l"), F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    by_p = keep(index.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("n")), "levels")
    own = by_p.join(bounded(others), (F.col("lang") == F.col("l")) & (F.col("source") != F.col("other")))
    own = own.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("n") * (_f(F.col("p"), F.col("other_zero")) - _f(F.col("zero"), F.col("other_zero")))).alias("value"))
    # terms that both hold, from the index
    one, two = (index.select(F.col("lang").alias(f"lang_{c}"), F.col("term").alias(f"term_{c}"), F.col("source").alias(c), F.col("p").alias(f"p_{c}"), F.col("zero").alias(f"zero_{c}")) for c in "ab")
    met = one.join(two, (F.col("lang_a") == F.col("lang_b")) & (F.col("term_a") == F.col("term_b")) & (F.col("a") < F.col("b")))
    both = met.select(F.col("lang_a").alias("lang"), "a", "b", (_f(F.col("p_a"), F.col("p_b")) - _f(F.col("p_a"), F.col("zero_b")) - _f(F.col("zero_a"), F.col("p_b")) + _f(F.col("zero_a"), F.col("zero_b"))).alias("value"))
    corrections = own.union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    left, right = (groups.select("lang", F.col("source").alias(c), F.col("zero").alias(f"zero_{c}"), *(["terms"] if c == "a" else [])) for c in "ab")
    pairs = left.join(right, "lang").where("a < b")
    base = F.when(F.col("terms") > 0, F.col("terms") * _f(F.col("zero_a"), F.col("zero_b"))).otherwise(F.lit(0))
    pairs = pairs.withColumn("base", base).join(corrections, ["lang", "a", "b"], "left").select("lang", "a", "b", (F.col("base") + F.coalesce("value", F.lit(0))).alias("value"))
    pairs = keep(pairs, "pairs")
    either = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    apart = index.where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    parts = [either.withColumn("rank", place).withColumn("part", F.lit("pair")), apart.withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term"))]
    return parts[0].union(parts[1]).select("lang", "source", "part", "item", "value", "rank")
