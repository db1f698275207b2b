"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has 64 bits; two link at ``DISTANCE`` or fewer differing bits.

The join.  Cut the 64 bits into ``blocks`` blocks.  Two linked fingerprints
agree in at least ``blocks - DISTANCE`` of them, so for each choice of that many
blocks fingerprints are dealt out by those blocks' bits and only those that
agree there meet: no link is lost.  Where they meet, the other bits form a
binary trie; node pairs are traversed together, differing bits add up, and a
pair is left as soon as the budget is exceeded.  A pair of nodes whose leaves
are already one component is left too: its links cannot join anything new.
What comes out are stars, at most one link a fingerprint, not all pairs.

A meeting place with more than ``LARGE`` fingerprints is dealt out again, in
chunks by hash; every pair of chunks is one task's trie, so no task gets more
than two chunks and every pair still meets.  Copies with equal fingerprints are
one row before all this.  Components of the links are then found by alternating
large and small stars, each round checkpointed to the shared folder.

Defined cases: texts that are null or have no word have fingerprint zero, which
links like any other; repeated rows share fingerprint and component; a null
doc_id takes part and is never a component's id unless it has no other; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import keep, shared_dir

DISTANCE = 4
WIDTH = 4
SEED = 42
LARGE = 4096
#: Fingerprints that one traversal takes at once, unless one meeting place has more.
TOGETHER = 65536
#: Node pairs that are opened at once.
OPEN = 1 << 17
_BYTES = np.arange(256, dtype=np.uint8)[:, None] >> np.arange(7, -1, -1, dtype=np.uint8) & 1


def fingerprints(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and the fingerprint (bigint) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for _, _, data, offsets in T.pieces(batch.column("text")):
                out.append(_fingerprints(T.LOWER[data], offsets, width).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    words = T.runs(data, offsets, T.SPACED)
    # the words again, one space after each: a shingle is then a slice
    length = words.ends - words.starts
    at = np.concatenate([[0], np.cumsum(length + 1)])
    inside = T.SPACED[data]
    text = np.full(at[-1], 32, np.uint8)
    gap = np.ones(at[-1], bool)
    gap[at[1:] - 1] = False
    text[gap] = data[inside]
    view = text.tobytes()
    per = np.where(words.count >= width, words.count - width + 1, np.minimum(words.count, 1))
    row = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(words.row[:-1], per) + np.arange(row[-1]) - np.repeat(row[:-1], per)
    last = np.minimum(first + width, np.repeat(words.row[1:], per))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, len(first))
    return majority(h, row)


def majority(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of each row's hashes the bits that over half of them have; zero without a hash."""
    # bit counts byte by byte: one table of 256 counts a row and byte
    per = np.diff(row)
    out = np.zeros(len(per), np.uint64)
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for k in range(8 if len(h) else 0):
        ones = np.add.reduceat(_BYTES[octets[:, k]], row[:-1][per > 0], axis=0, dtype=np.int32)
        bits = np.packbits(2 * ones > per[per > 0][:, None], axis=1)[:, 0]
        out[per > 0] |= bits.astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _tables(blocks: int, distance: int) -> list[list[int]]:
    """For each choice of blocks: all bit positions (63 highest), chosen blocks first."""
    cut = [64 - 64 * k // blocks for k in range(blocks + 1)]
    parts = [list(range(cut[k] - 1, cut[k + 1] - 1, -1)) for k in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - distance):
        out.append(([b for k in chosen for b in parts[k]], [b for k in range(blocks) if k not in chosen for b in parts[k]]))
    return out


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, the first the highest."""
    out = np.zeros(len(fp), np.uint64)
    k = 0
    while k < len(bits):
        n = 1
        while k + n < len(bits) and bits[k + n] == bits[k] - n:
            n += 1
        out = out << np.uint64(n) | (fp >> np.uint64(bits[k] - n + 1)) & np.uint64((1 << n) - 1)
        k += n
    return out


def trie_links(unit: np.ndarray, key: np.ndarray, width: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each unit, all keys of ``width`` bits within ``distance`` of each other.

    ``unit`` and ``key`` are sorted by unit, then key, without repeats.  Returns
    positions (a, b), a star for each component.
    """
    n = len(key)
    root = np.arange(n)
    if n < 2:
        return root[:0], root[:0]
    ones = {}

    def cut(lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
        mid = hi.copy()
        for b in np.unique(bit).tolist():
            if b not in ones:
                ones[b] = np.concatenate([[0], np.cumsum(key >> np.uint64(b) & np.uint64(1))]).astype(np.int64)
            at = bit == b
            mid[at] -= ones[b][hi[at]] - ones[b][lo[at]]
        return mid

    border = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [n]])
    lo, hi = border[:-1], border[1:]
    large = hi - lo > 1
    lo, hi = lo[large], hi[large]
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int64), np.full(len(lo), width - 1, np.int64))]
    change = np.arange(n)  # change[j] - change[i]: borders between components among i..j
    while stack:
        alo, ahi, blo, bhi, diff, bit = stack.pop()
        if len(alo) > OPEN:
            stack.append(tuple(x[:-OPEN] for x in (alo, ahi, blo, bhi, diff, bit)))
            alo, ahi, blo, bhi, diff, bit = (x[-OPEN:] for x in (alo, ahi, blo, bhi, diff, bit))
        joined = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (root[alo] == root[blo])
        alo, ahi, blo, bhi, diff, bit = (x[~joined] for x in (alo, ahi, blo, bhi, diff, bit))
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(key[a] ^ key[b]) <= distance
            a, b = a[near], b[near]
            if len(a) and not (root[a] == root[b]).all():
                _union(root, a, b)
                change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            alo, ahi, blo, bhi, diff, bit = (x[~single] for x in (alo, ahi, blo, bhi, diff, bit))
        if not len(alo):
            continue
        amid, bmid = cut(alo, ahi, bit), cut(blo, bhi, bit)
        own = alo == blo
        parts = [(amid, ahi, bmid, bhi, diff), (alo, amid, blo, bmid, diff), (alo, amid, bmid, bhi, diff + 1), (amid[~own], ahi[~own], blo[~own], bmid[~own], diff[~own] + 1)]
        bits = [bit, bit, bit, bit[~own]]
        merged = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        bit = np.concatenate(bits) - 1
        ok = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= distance)
        ok &= ~((merged[0] == merged[2]) & (merged[1] - merged[0] == 1))
        stack.append(tuple(x[ok] for x in (*merged, bit)))
    other = np.flatnonzero(root != np.arange(n))
    return root[other], other


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[i] with b[i]; afterwards root[i] is the least member of i's component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def links(distinct: DataFrame, distance: int = DISTANCE, large: int = LARGE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) of bigint fingerprints, enough to connect what is within ``distance``.

    ``distinct`` has one row a fingerprint, column fp, and is read twice, so it
    should be a stored table.
    """
    if blocks is None:
        # about as many meeting places as fingerprints / 1000, by choosing more blocks; every choice is exact
        n = distinct.count()
        blocks = next((m for m in (distance + 1, distance + 2, distance + 3) if n >> sum(sorted(64 // m for _ in range(m - distance))) <= 1000), distance + 3)
    tables = _tables(blocks, distance)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for t, (head, _) in enumerate(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(_gather(fp, head).view(np.int64)), pa.array(fp.view(np.int64))], names=["t", "place", "fp"])

    dealt = distinct.select("fp").mapInArrow(places, "t int, place bigint, fp bigint")
    hot = dealt.groupBy("t", "place").count().where(F.col("count") > large).select("t", "place", F.ceil(F.col("count") / large).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    units = (
        dealt.join(keep(hot, "hot"), ["t", "place"], "left")
        .withColumn("own", F.coalesce(chunk, F.lit(0)))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
        .select("t", "place", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "fp")
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
            t, place, x, y, fp = cols
            fp = fp.view(np.uint64)
            change = np.zeros(len(t), bool)
            for c in (t, place, x, y):
                change[1:] |= c[1:] != c[:-1]
            unit = np.cumsum(change)
            found_a, found_b = [], []
            for k, (_, tail) in enumerate(tables):
                at = np.flatnonzero(t == k)
                key = _gather(fp[at], tail)
                order = np.lexsort((key, unit[at]))
                a, b = trie_links(unit[at][order], key[order], len(tail), distance)
                found_a.append(fp[at][order][a])
                found_b.append(fp[at][order][b])
            a, b = (np.concatenate(f).view(np.int64) for f in (found_a, found_b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        size = 0
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("t", "place", "x", "y", "fp")]
            held.append(cols)
            size += len(cols[0])
            if size >= TOGETHER:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                change = np.zeros(size, bool)
                for c in whole[:4]:
                    change[1:] |= c[1:] != c[:-1]
                last = int(np.flatnonzero(change)[-1]) if change.any() else 0
                if last:
                    yield emit([c[:last] for c in whole])
                held, size = [[c[last:] for c in whole]], len(whole[0]) - last
        if size:
            yield emit([np.concatenate(c) for c in zip(*held, strict=True)])

    return units.repartition(n, "t", "place", "x", "y").sortWithinPartitions("t", "place", "x", "y").mapInArrow(join, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node connected to it) of all nodes with an edge.

    Alternating large and small stars; minima are pre-aggregated, and the join
    that brings them back has one row a node on one side, so AQE can split a hub.
    """
    shared_dir(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = star.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE, large: int = LARGE, blocks: int | None = None) -> DataFrame:
    """doc_id, fp (bigint) and component_id (least doc_id of the component) of each row."""
    prints = keep(fingerprints(documents, width), "prints")
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = keep(components(links(distinct, distance, large, blocks)), "roots")
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(ids, "root").select("fp", "component_id")
    return prints.join(keep(by_print, "classes"), "fp").select("doc_id", "fp", "component_id")
