"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words by weight, but at most ``limit``
times its own words; what is over is shared again by weight among the others.
The targets are a water level: target = min(limit x size, level x weight).

A document of its source's rate r = target / size is taken floor(r) times and
once more with probability frac(r).  These probabilities are rounded in pairs:
mass, in words, moves at random from one document of a pair to the other until
one probability is 0 or 1.  Pairs keep the words a source yields.  Documents meet in leaves of
about ``LEAF`` documents of one source; each leaf leaves at most one document
undecided, and these meet again in a tree of ``FAN`` children a node, so no task
gets a whole source.  Each source has a tree of its own height.  Along with the
undecided document goes a bounded choice of decided ones, graded by size and
with as many words as it has.  At its root the source's last document is drawn, and
what that leaves of its target is balanced by the others there: the one change, or pair of
changes, that brings it nearest is made until none brings it nearer, first
among the copies that rounding allows, then among 0 to ``limit`` copies.

Equal rows (doc_id, source, size) are counted first and dealt out in runs of
``RUN``, so an id that many rows share, or none, is spread like others.  Draws are
hashes, leaves follow from hashes and counts, so reruns agree.

Defined cases: a null text has size 0 and is taken 0 words; null sources are one
source, last in order; an empty table gives an empty result; repeated rows are
separate documents; texts of any length are counted whole; ties follow hashes;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import keep

WEIGHTS = (1, 2, 3)
LIMIT = 3
LEAF = 4096
FAN = 64
#: Decided documents of each choice that a node passes up: so many of each power of two in size, and at most so many for their words.
GRADE = 4
FILL = 1024
#: Equal rows that are dealt out together.
RUN = 256
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, n, target of each source of ``sizes`` (source, size, and n rows of them)."""
    spark = sizes.sparkSession
    table = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    # places in code point order without one task for all: counts before each sorted partition
    table = keep(table.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sources")
    counts = {r.part: r.n for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    starts = spark.createDataFrame(before, "part int, before bigint")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int"))
    table = keep(table.join(F.broadcast(starts), "part").select("source", "source_size", "n", weight.cast("bigint").alias("weight")), "weights")
    words, share = (table.agg(F.sum("source_size"), F.sum("weight")).first()) or (0, 0)
    level, capped = (words or 0) / (share or 1), -1
    full = F.col("source_size") * limit <= F.col("weight") * F.lit(level)
    while True:
        full = F.col("source_size") * limit <= F.col("weight") * F.lit(level)
        n, used, left = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("source_size") * limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not left:
            break
        capped, level = n, (words - (used or 0)) / left
    target = F.when(full, (F.col("source_size") * limit).cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    return table.select("source", "source_size", "n", target.alias("target"))


def _draw(*parts) -> float:
    return xxhash.xxh64_intdigest(repr(parts).encode(), 11) / 2**64


def _round(ids: list, sizes: list[int], chance: list[float], last: bool) -> list[float]:
    """Pivotal rounding along a list; returns the chances, at most one not 0 or 1 (none if ``last``).

    Chances of 0 and 1 are choices made before.
    """
    out = list(chance)
    live = -1
    for k in range(len(out)):
        if not 0.0 < out[k] < 1.0:
            continue
        if live < 0:
            live = k
            continue
        i, j = live, k
        a, b = sizes[i], sizes[j]
        up, down = min((1 - out[i]) * a, out[j] * b), min(out[i] * a, (1 - out[j]) * b)
        if _draw(ids[i], ids[j], a, b, k) * (up + down) < down:
            move, forth = up, True
        else:
            move, forth = down, False
        if forth:
            i_done, j_done = (1 - out[i]) * a <= out[j] * b, out[j] * b <= (1 - out[i]) * a
            out[i], out[j] = (1.0 if i_done else out[i] + move / a), (0.0 if j_done else out[j] - move / b)
        else:
            i_done, j_done = out[i] * a <= (1 - out[j]) * b, (1 - out[j]) * b <= out[i] * a
            out[i], out[j] = (0.0 if i_done else out[i] - move / a), (1.0 if j_done else out[j] + move / b)
        live = j if 0.0 < out[j] < 1.0 else i if 0.0 < out[i] < 1.0 else -1
    if last and live >= 0:
        out[live] = 1.0 if _draw(ids[live], sizes[live], "last") < out[live] else 0.0
    return out


def _balance(sizes: np.ndarray, copies: np.ndarray, low: np.ndarray, high: np.ndarray, over: float) -> float:
    """Change ``copies`` by one here and there, between ``low`` and ``high``, while that brings the words ``over`` nearer to 0."""
    while True:
        up, down = np.flatnonzero((copies < high) & (sizes > 0)), np.flatnonzero((copies > low) & (sizes > 0))
        at, step = np.concatenate([[-1], up, down]), np.concatenate([[0], sizes[up], -sizes[down]])
        order = np.lexsort((at, step))
        at, step = at[order], step[order]
        # of each change, the change that fits it best: beside -over - step
        place = np.searchsorted(step, -over - step)
        best, pair = abs(over), None
        for other in (place - 1, place, place + 1):
            other = np.clip(other, 0, len(step) - 1)
            left = np.abs(over + step + step[other])
            left[(at == at[other]) & (at >= 0)] = np.inf
            k = int(np.argmin(left))
            if left[k] < best - 1e-6:
                best, pair = float(left[k]), (k, int(other[k]))
        if pair is None:
            return over
        for k in pair:
            if at[k] >= 0:
                copies[at[k]] += 1 if step[k] > 0 else -1
            over += float(step[k])


def _passed(sizes: list[int], chance: list[float]) -> list[bool]:
    """Whether each row, largest first, goes up: the undecided one, and of each choice what can balance it."""
    open_ = [k for k, c in enumerate(chance) if 0.0 < c < 1.0]
    out = [0.0 < c < 1.0 for c in chance]
    need = max((sizes[k] for k in open_), default=0)
    for choice in (0.0, 1.0):
        words, filled, grades = 0, 0, {}
        for k, c in enumerate(chance):
            if c != choice:
                continue
            grade = sizes[k].bit_length()
            fill = sizes[k] <= need and words < need and filled < FILL
            if fill:
                words, filled = words + sizes[k], filled + 1
            if fill or grades.get(grade, 0) < GRADE:
                out[k] = True
                grades[grade] = grades.get(grade, 0) + 1
    return out


_ROW = "node bigint, nodes bigint, source string, doc_id bigint, key bigint, size bigint, copies int, chance double, source_size bigint, target double, up boolean"


def _reduce(rows: DataFrame, limit: int) -> DataFrame:
    """Round within each (source, node), rows in order of size, largest first; ``up`` rows go to the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done(group: list[dict]) -> pa.RecordBatch:
            sizes, last = [r["size"] for r in group], group[0]["nodes"] <= 1
            got = _round([r["doc_id"] for r in group], sizes, [r["chance"] for r in group], last)
            for r, c, up in zip(group, got, [False] * len(got) if last else _passed(sizes, got), strict=True):
                r["was"], r["chance"], r["up"] = r["chance"], c, up
            if last:
                size, base = np.array(sizes, np.int64), np.array([r["copies"] for r in group], np.int64)
                copies = base + np.array(got).astype(np.int64)
                over = sum((r["chance"] - r["was"]) * r["size"] for r in group)
                # documents of a whole rate may not change by rounding
                over = _balance(size, copies, base, np.minimum(base + 1, limit), over)
                _balance(size, copies, np.zeros_like(base), np.full_like(base, limit), over)
                for r, c in zip(group, copies.tolist(), strict=True):
                    r["copies"], r["chance"] = c, 0.0
            for r in group:
                del r["was"]
            return pa.RecordBatch.from_pylist(group, schema=kind)

        kind = None
        for batch in batches:
            kind = kind or batch.schema
            for r in batch.to_pylist():
                if held and (held[0]["source"] != r["source"] or held[0]["node"] != r["node"]):
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "node", F.col("size").desc(), F.xxhash64("doc_id", "key"), "doc_id", "key", "chance"]
    return rows.repartition(n, "source", "node").sortWithinPartitions(*order).mapInArrow(run, _ROW)


def words(text: str) -> Column:
    """Words of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, key: Column | None = None) -> DataFrame:
    """doc_id, source, key, size, source_size, target, copies and taken (words) of each row.

    ``key`` (bigint, such as a hash of the text) tells rows apart that are alike in doc_id, source and size.
    """
    key = F.lit(0) if key is None else key
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), key.cast("bigint").alias("key"), words("text").alias("size"))
    return _decide(keep(rows.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n")), "sizes"), weights, limit)


def _decide(counted: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    targets = keep(source_targets(counted, weights, limit), "targets")
    # each row again, and the run of equal rows it is in
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))))
    rows = runs.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN).cast("int")))).drop("_", "n")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nodes = F.ceil(F.col("t.n") / LEAF)
    dealt = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        F.pmod(F.xxhash64("doc_id", "key", "run"), nodes).alias("node"), nodes.alias("nodes"), F.col("d.source").alias("source"), "doc_id", "key", "size",
        F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("int").alias("copies"), F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("chance"), "source_size", "target", F.lit(False).alias("up"),
    )
    open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
    settled = dealt.where(~open_)
    most = targets.agg(F.max("n")).first()[0] or 0
    nodes, out, level = math.ceil(most / LEAF), [settled], dealt.where(open_)
    while True:
        got = keep(_reduce(level, limit), "rounded")
        out.append(got.where(~F.col("up")))
        if nodes <= 1:
            break
        nodes = math.ceil(nodes / FAN)
        level = got.where("up").withColumns({"node": F.floor(F.col("node") / FAN).cast("bigint"), "nodes": F.ceil(F.col("nodes") / FAN).cast("bigint")})
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    copies = F.col("copies") + F.col("chance").cast("int")
    return whole.select("doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))
