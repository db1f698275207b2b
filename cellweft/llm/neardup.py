"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links, and beyond their reach MinHash.

Two texts link at ``SIMILAR`` or more of the union of their sets of
``WIDTH``-word shingles.  Candidates come from two places.  The SimHash join
(``simhash.links``, the trie self-join over fingerprints of the same shingles) gives
texts within its error budget.  At 64 bits a pair of similarity 0.8 differs in ten
bits on average and some in sixteen, where no blocks of bits tell texts apart and
nearly all node pairs stay within the budget; so for those MinHash gives more:
``BANDS`` bands of ``ROWS`` minima each, and texts that agree in a band share its
bucket.  A pair of similarity 0.8 is missed by all bands with probability 7e-5 and
a closer one more rarely.

Every candidate pair is held against the shingle sets themselves before it
links, unless its texts are one component already.  First each bucket's texts
are held against its least and its greatest; buckets whose texts are then one
component are done, and in the others all texts meet in one task, which counts
what every two share and gives stars, not pairs.  A bucket with more than
``LARGE`` texts is dealt out in chunks by hash, and every two chunks meet.
Components are those of ``simhash``.

Defined cases: A-Z count as a-z; texts of fewer than ``WIDTH`` words have one
shingle; texts that are null or have no word are alike; equal texts are one row
before all this; a null doc_id takes part and is never a component's id unless
it has no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import simhash
from ._store import bounded, keep
from .simhash import _union, components

WIDTH = 5
#: Least similarity that links, in hundredths.
SIMILAR = 80
BANDS = 24
ROWS = 5
SEED = 42
#: Texts of a bucket from which it is dealt out in chunks, every two of which meet.
LARGE = 512
#: Rows that are held at once, unless a bucket has more, and shingles that are compared at once.
TOGETHER = 4096
COLUMNS = 4096


def text_key() -> Column:
    """Tells texts apart; never null."""
    return F.xxhash64(F.col("text").cast("string"))


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a piece, and where each row's begin."""
    data = T.LOWER[data]
    words = T.runs(data, offsets, T.SPACED)
    h = T.hashes(T.prefix_sums(data), words.starts, words.ends, data)
    count = words.count
    row = np.concatenate([[0], np.cumsum(np.where(count >= width, count - width + 1, np.minimum(count, 1)))])
    out = np.zeros(row[-1], np.uint64)
    first, rows = T.window_rows(words, width)
    out[row[:-1][rows] + first - words.row[:-1][rows]] = T.shingles(h, width)[first]
    for r in np.flatnonzero((count > 0) & (count < width)).tolist():
        own = h[words.row[r] : words.row[r + 1]]
        out[row[r]] = T.shingles(own, len(own))[0] ^ np.uint64(len(own))
    return out, row


def _buckets(shingles: np.ndarray, row: np.ndarray, bands: int, per: int) -> np.ndarray:
    """A bucket of each row with shingles and band."""
    start = row[:-1][np.diff(row) > 0]
    out = np.zeros((len(start), bands), np.uint64)
    if len(start):
        rng = np.random.default_rng(SEED)
        for b in range(bands):
            key = np.full(len(start), b, np.uint64)
            for _ in range(per):
                turn, times = rng.integers(0, 1 << 64, 2, np.uint64)
                least = np.minimum.reduceat((shingles ^ turn) * (times | np.uint64(1)), start)
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            out[:, b] = key
    return out


def sketches(documents: DataFrame, width: int = WIDTH, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """doc_id, text_key, fp (SimHash fingerprint) and buckets of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.pieces(batch.column("text")):
                shingles, row = _shingles(data, offsets, width)
                some = np.diff(row) > 0
                found = np.zeros((j - i, bands), np.uint64)
                found[some] = _buckets(shingles, row, bands, per)
                # rows without a shingle share one bucket
                size = np.where(some, bands, 1)
                flat = found[np.arange(bands)[None, :] < size[:, None]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), pa.array(simhash.majority(shingles, row).view(np.int64)), lists], names=["doc_id", "text_key", "fp", "buckets"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint, buckets array<bigint>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """text_key and the distinct shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.pieces(batch.column("text")):
                shingles, row = _shingles(data, offsets, width)
                rows = np.repeat(np.arange(j - i), np.diff(row))
                order = np.lexsort((shingles, rows))
                shingles, rows = shingles[order], rows[order]
                new = np.ones(len(rows), bool)
                new[1:] = (shingles[1:] != shingles[:-1]) | (rows[1:] != rows[:-1])
                cut = np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=j - i))])
                yield pa.RecordBatch.from_arrays([batch.column("text_key").slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(shingles[new].view(np.int64)))], names=["text_key", "shingles"])

    return texts.mapInArrow(run, "text_key bigint, shingles array<bigint>")


def _texts(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """text_key and text, once, of the keys in the one column of ``keys``."""
    texts = documents.select(text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    wanted = bounded(keep(keys.toDF("key").distinct(), "wanted"))
    return texts.join(wanted, F.col("text_key") == F.col("key"), "left_semi").dropDuplicates(["text_key"])


def _linked(documents: DataFrame, pairs: DataFrame, width: int, similar: int) -> DataFrame:
    """Those of the stored pairs (a, b) of text keys that are as similar as asked."""
    sets = keep(_sets(_texts(documents, pairs.select("a").union(pairs.select("b"))), width), "sets")
    one, two = (sets.select(F.col("text_key").alias(f"key_{c}"), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(one, F.col("a") == F.col("key_a")).join(two, F.col("b") == F.col("key_b"))
    shared, sizes = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return both.where(shared * 100 >= (sizes - shared) * similar).select("a", "b")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(documents: DataFrame, distinct: DataFrame, width: int = WIDTH, similar: int = SIMILAR, large: int = LARGE) -> DataFrame:
    """Links (a, b) of text keys, enough to connect all candidates that are similar.

    ``distinct`` is a stored table with one row a text: text_key, fp, buckets.
    """
    # within the trie's budget: of each fingerprint its texts with the least, and these along the join's stars
    own = keep(distinct.groupBy("fp").agg(F.min("text_key").alias("first")), "fingerprints")
    alike = distinct.join(own, "fp").where("text_key <> first").select(*_pair("text_key", "first"))
    one, two = (own.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    near = simhash.links(own.select("fp")).join(one, "a").join(two, "b").select(*_pair("first_a", "first_b"))
    dealt = distinct.select("text_key", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo < hi")
    members = keep(dealt.join(keep(shared, "shared"), "bucket"), "members")
    ends = members.where("text_key <> lo").select(*_pair("text_key", "lo")).union(members.where("text_key <> hi").select(*_pair("text_key", "hi")))
    found = keep(_linked(documents, keep(ends.union(alike).union(near).distinct(), "ends"), width, similar), "links")
    roots = keep(components(found), "parts")
    rooted = members.join(roots, F.col("text_key") == F.col("node"), "left").select("bucket", "text_key", F.coalesce("root", "text_key").alias("root"))
    mixed = keep(rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", F.ceil(F.col("n") / large).cast("int").alias("chunks")), "mixed")
    if mixed.isEmpty():
        return found
    rest = rooted.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("text_key"), "chunks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = keep(rest.select("bucket", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "text_key", "root"), "rest")
    sets = keep(_sets(_texts(documents, rest.select("text_key")), width), "rest-sets")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["bucket", "x", "y"]
    units = rest.join(sets, "text_key").select(*keys, "text_key", "root", "shingles").repartition(n, *keys).sortWithinPartitions(*keys)
    return found.union(keep(units.mapInArrow(lambda b: _meet(b, similar), "a bigint, b bigint"), "more"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 32768) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows that hold whole groups; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            border = np.flatnonzero(_change(whole, keys))
            if len(border):
                last = int(border[-1]) + 1
                yield whole.slice(0, last)
                held = [whole.slice(last)]
                size -= last
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _change(table: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row but the last differs from the next in a key."""
    out = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        v = table.column(k).to_numpy()
        out |= v[1:] != v[:-1]
    return out


def _meet(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, x and y: links that connect what is similar in each and not one root already."""
    keys = ["bucket", "x", "y"]
    for table in _groups(batches, keys, TOGETHER):
        start = np.flatnonzero(np.concatenate([[True], _change(table, keys)]))
        text, root, listed = table.column("text_key").to_numpy(), table.column("root").to_numpy(), table.column("shingles")
        flat, cut = listed.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(listed.offsets.to_numpy()))])
        out = [np.zeros((0, 2), np.int64)]
        for a, b in zip(start.tolist(), [*start[1:].tolist(), table.num_rows], strict=True):
            if (root[a:b] != root[a]).any():
                one, two = stars(flat[cut[a] : cut[b]], cut[a : b + 1] - cut[a], root[a:b], similar)
                out.append(np.stack([text[a + one], text[a + two]], axis=1))
        got = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(2)], names=["a", "b"])


def stars(shingles: np.ndarray, row: np.ndarray, root: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) that connect all sets (distinct shingles, where each begins) that are similar; equal roots are connected."""
    n, size = len(row) - 1, np.diff(row)
    owner = np.repeat(np.arange(n), size)
    _, column, count = np.unique(shingles, return_inverse=True, return_counts=True)
    # what one set alone has is shared with none
    some = count[column] > 1
    column, owner = np.unique(column[some], return_inverse=True)[1], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        shared += has @ has.T
    shared = shared.astype(np.int64)
    a, b = np.nonzero(np.triu(shared * 100 >= (size[:, None] + size[None, :] - shared) * similar, 1))
    _, joined = np.unique(root, return_inverse=True)
    known = np.zeros(joined.max() + 1, np.int64)
    known[joined[::-1]] = np.arange(n)[::-1]
    known = known[joined]
    part = np.arange(n)
    _union(part, np.concatenate([a, np.arange(n)]), np.concatenate([b, known]))
    other = np.flatnonzero((part != known) & (known == np.arange(n)))
    return part[other], other


def near_duplicates(documents: DataFrame, width: int = WIDTH, similar: int = SIMILAR, bands: int = BANDS, per: int = ROWS, large: int = LARGE) -> DataFrame:
    """doc_id, text_key, component_id (least doc_id of the component) and keeper (the text key that it has there) of each row."""
    rows = keep(sketches(documents, width, bands, per), "sketches")
    distinct = keep(rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "distinct")
    roots = keep(components(links(documents, distinct, width, similar, large)), "roots")
    labelled = distinct.join(roots, F.col("text_key") == F.col("node"), "left").select("text_key", "least", F.coalesce("root", "text_key").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "text_key"))
    ids = labelled.groupBy("root").agg(first.alias("first")).select("root", F.col("first.least").alias("component_id"), F.col("first.text_key").alias("keeper"))
    by_text = labelled.join(ids, "root").select("text_key", "component_id", "keeper")
    return rows.select("doc_id", "text_key").join(keep(by_text, "classes"), "text_key").select("doc_id", "text_key", "component_id", "keeper")
