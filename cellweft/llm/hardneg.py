"""Hard negatives by a dual-tree search over inner products of integer vectors.

For each anchor the ``positives`` best other rows of its label are found, and for
each of these the ``negatives`` best rows of other labels whose score lies between
``low`` and ``high`` hundredths of the positive's.

Both sides are trees.  Splits fitted on a bounded sample (``SAMPLE`` rows) send rows
to cells; rows are range-partitioned by label, cell and row, and tasks split them
further into leaves of near rows of one label, which lie in chunks (candidates) and
blocks (anchors).  A node's box and ball give an interval that holds every inner
product of two nodes.  Blocks first meet the chunks that promise most, which gives
every anchor a bound; then a block goes on with those chunks alone whose interval
reaches what an anchor of it still needs: at least its bound (at equal scores, a
smaller id), at most the greatest score allowed, a label of the right kind.  In such
a pair the leaves meet by the same rule, so whole groups of anchors are pruned at
once, and leaf pairs that are left are scored exactly.

Anchors are a stated query set against all rows.  Chunk summaries come in pages of
about ``PAGE``, every block meets every page, and what is left is joined as rows of
one block and one chunk each: no task holds more than a few of these, and identical
vectors, however many, are many leaves with the least id known of each.

Defined cases: rows with a null label or vector take no part; shorter vectors are
padded with zeros; ties go to the smaller id, null ids last; rows that share an id
are rows of their own, each of which is another row to the others; a null id is no
anchor; scores beyond 53 bits are computed with unbounded integers and end at the
limits of 64; an empty table or one without anchors gives no row; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import keep

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SAMPLE = 4096
DEPTH = 6
#: Rows of a chunk and of its leaves, anchors of a block and of its leaves, and rows that a task splits at once.
CHUNK, LEAF = 2048, 128
BLOCK, TWIG = 512, 32
TOGETHER = 8192
#: Chunk summaries of a page, and chunks of a page that a block meets first.
PAGE = 4096
FIRST = 2
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Kind:
    """What all vectors share: components, and the types in which they are stored and multiplied."""

    width: int
    stored: str
    product: str

    @staticmethod
    def of(width: int, largest: int) -> Kind:
        bound = width * largest * largest
        return Kind(width, "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8", "f4" if bound < 1 << 24 else "f8" if bound < 1 << 53 else "O")

    def matrix(self, vectors: pa.Array) -> np.ndarray:
        lengths = vectors.value_lengths().to_numpy()
        if (lengths == self.width).all():
            return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width)
        out = np.zeros((len(vectors), self.width), np.int64)
        for row, v in zip(out, vectors.to_pylist(), strict=True):
            row[: len(v)] = v
        return out

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = a.astype(self.product) @ b.astype(self.product).T
        return np.clip(got, LEAST + 1, MOST - 1).astype(np.int64) if self.product == "O" else got.astype(np.int64)


@dataclass
class Nodes:
    """Boxes, balls, labels and least ids of groups of rows."""

    middle: np.ndarray
    half: np.ndarray
    mean: np.ndarray
    radius: np.ndarray
    low_label: np.ndarray
    high_label: np.ndarray
    least_id: np.ndarray

    @staticmethod
    def of(v: np.ndarray, labels: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> Nodes:
        x = v.astype(float)
        size = np.diff(np.append(starts, len(x)))
        lo, hi = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        mean = np.add.reduceat(x, starts) / size[:, None]
        far = np.sqrt(((x - np.repeat(mean, size, axis=0)) ** 2).sum(axis=1))
        return Nodes((lo + hi) / 2, (hi - lo) / 2, mean, np.maximum.reduceat(far, starts), np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts), np.minimum.reduceat(ids, starts))

    def interval(self, other: Nodes) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner products of each node with each other one; a little wider, for rounding."""
        box = self.middle @ other.middle.T
        wide = np.abs(self.middle) @ other.half.T + self.half @ np.abs(other.middle).T + self.half @ other.half.T
        ball = self.mean @ other.mean.T
        one, two = (np.sqrt((n.mean**2).sum(axis=1)) for n in (self, other))
        round_ = self.radius[:, None] * two + one[:, None] * other.radius + self.radius[:, None] * other.radius
        slack = 1e-3 + 1e-9 * (np.abs(box) + wide + np.abs(ball) + round_)
        return np.maximum(box - wide, ball - round_) - slack, np.minimum(box + wide, ball + round_) + slack

    def meet(self, other: Nodes, need: Needs, same: bool) -> np.ndarray:
        """Which pairs of nodes may hold a pair of rows that is needed."""
        low, high = self.interval(other)
        apart = (self.low_label[:, None] > other.high_label) | (self.high_label[:, None] < other.low_label)
        pure = (self.low_label == self.high_label)[:, None] & (other.low_label == other.high_label) & (self.low_label[:, None] == other.low_label)
        tie = (high >= need.floor[:, None] + 1 - 1e-2) | (other.least_id < need.id[:, None])
        return ~(apart if same else pure) & (high >= need.floor[:, None]) & (low <= need.top[:, None]) & tie


@dataclass
class Needs:
    """For each group of anchors: the least and greatest score that one of them needs, and the ids below which a tie counts."""

    floor: np.ndarray
    top: np.ndarray
    id: np.ndarray


def _split(v: np.ndarray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in leaves of at most ``most``: first by label, then along the line between two far rows, equal ones by id."""
    if len(rows) <= most:
        return [rows]
    own = labels[rows]
    if own.min() != own.max():
        rows = rows[np.argsort(own, kind="stable")]
        border = np.flatnonzero(np.diff(labels[rows])) + 1
        cut = int(border[np.argmin(np.abs(border - len(rows) / 2))])
    else:
        x = v[rows].astype(float)
        one = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
        two = x[np.argmax(((x - one) ** 2).sum(axis=1))]
        rows = rows[np.lexsort((ids[rows], x @ (one - two)))]
        cut = len(rows) // 2
    return _split(v, labels, ids, rows[:cut], most) + _split(v, labels, ids, rows[cut:], most)


def _fit(sample: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, float]]:
    """A line and a border for each node of the tree's top, in heap order."""
    rows, out = [np.arange(len(sample))], []
    for k in range((1 << depth) - 1):
        own = sample[rows[k]].astype(float)
        line, border = np.zeros(sample.shape[1]), 0.0
        if len(own):
            one = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
            line = one - own[np.argmax(((own - one) ** 2).sum(axis=1))]
            border = float(np.median(own @ line))
        out.append((line, border))
        right = sample[rows[k]].astype(float) @ line > border
        rows += [rows[k][~right], rows[k][right]]
    return out


def _cells(rows: DataFrame, kind: Kind, tops: list[tuple[np.ndarray, float]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, borders = np.array([t[0] for t in tops]).reshape(-1, kind.width), np.array([t[1] for t in tops])
        for batch in batches:
            x = kind.matrix(batch.column("vector")).astype(float)
            right = x @ lines.T > borders
            at = np.zeros(len(x), np.int64)
            while len(tops) and len(at) and at[0] < len(tops):
                at = 2 * at + 1 + right[np.arange(len(at)), at]
            yield batch.append_column("cell", pa.array(at))

    return rows.mapInArrow(run, "uid bigint, id bigint, label bigint, vector array<bigint>, anchor boolean, cell bigint")


def _tree(rows: DataFrame, kind: Kind, size: int, leaf: int) -> DataFrame:
    """A row for each group of at most ``size`` rows in leaves: node, vectors, ids, uids, labels and where leaves begin."""

    def group(v: np.ndarray, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        node, held = (TaskContext.get().partitionId() << 32) + first, []
        leaves = _split(v, labels, ids, np.arange(len(v)), leaf)
        for k, own in enumerate(leaves):
            held.append(own)
            if k + 1 == len(leaves) or sum(map(len, held)) + len(leaves[k + 1]) > size:
                order, starts = np.concatenate(held), np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
                values = [v[order].astype(kind.stored).tobytes(), ids[order].tobytes(), uids[order], labels[order].tobytes(), starts.astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([node]), *(pa.array([x]) for x in values)], names=["node", "vectors", "ids", "uids", "labels", "starts"])
                node, held = node + 1, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made = 0
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= TOGETHER):
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
                columns = [whole.column(c).to_numpy() for c in ("uid", "id", "label")]
                for out in group(kind.matrix(whole.column("vector")), *columns, made):
                    made += 1
                    yield out

    dealt = rows.repartitionByRange("label", "cell", "uid").sortWithinPartitions("label", "cell", "uid")
    return dealt.mapInArrow(run, "node bigint, vectors binary, ids binary, uids array<bigint>, labels binary, starts binary")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


@dataclass
class Group:
    """A block or chunk, read from its row."""

    v: np.ndarray
    ids: np.ndarray
    uids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, row: int, kind: Kind, mark: str = "") -> Group:
        vectors, ids, labels, starts = (batch.column(mark + c)[row].as_buffer() for c in ("vectors", "ids", "labels", "starts"))
        uids = batch.column(mark + "uids")[row].values.to_numpy()
        return Group(np.frombuffer(vectors, kind.stored).reshape(-1, kind.width), np.frombuffer(ids, "<i8"), uids, np.frombuffer(labels, "<i8"), np.frombuffer(starts, "<i8"))

    def nodes(self, starts: np.ndarray | None = None) -> Nodes:
        return Nodes.of(self.v, self.labels, self.ids, self.starts if starts is None else starts)


@dataclass
class Windows:
    """What the anchors of a block still need, sorted by anchor: scores from ``low`` to ``high`` that are better than (score, id)."""

    at: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray
    score: np.ndarray
    id: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, row: int, block: Group) -> Windows:
        own = batch.column("windows")[row].values
        uid, key, low, high, score, id_ = (own.field(c).to_numpy() for c in ("uid", "key", "low", "high", "score", "id"))
        order = np.argsort(block.uids)
        at = order[np.searchsorted(block.uids, uid, sorter=order)]
        by = np.argsort(at, kind="stable")
        return Windows(at[by], key[by], low[by], high[by], score[by], id_[by])

    def needs(self, starts: np.ndarray) -> Needs:
        leaf = np.searchsorted(starts, self.at, "right") - 1
        floor, top, id_ = np.full(len(starts), np.inf), np.full(len(starts), -np.inf), np.full(len(starts), LEAST)
        least = np.maximum(self.low, self.score)
        np.minimum.at(floor, leaf, least)
        np.maximum.at(top, leaf, self.high)
        np.maximum.at(id_, leaf, np.where(self.score >= self.low, self.id, MOST))
        return Needs(floor, top, id_)


def _pages(chunks: DataFrame, kind: Kind) -> tuple[DataFrame, int]:
    """Chunk summaries in pages: page, and a list of node and bytes of its box, ball, labels and least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for row in range(batch.num_rows):
                n = Group.of(batch, row, kind).nodes(np.zeros(1, np.int64))
                said.append(np.concatenate([n.middle[0], n.half[0], n.mean[0], n.radius]).tobytes() + np.array([n.low_label[0], n.high_label[0], n.least_id[0]], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(said, pa.binary())], names=["node", "said"])

    stored = keep(chunks.mapInArrow(run, "node bigint, said binary"), "summaries")
    n = max(1, -(-stored.count() // PAGE))
    return keep(stored.groupBy(F.pmod(F.xxhash64("node"), F.lit(n)).alias("page")).agg(F.collect_list(F.struct("node", "said")).alias("nodes")), "pages"), n


def _plan(blocks: DataFrame, pages: tuple[DataFrame, int], kind: Kind, same: bool, first: bool) -> DataFrame:
    """block and chunk of the pairs that may give something; ``first``: those alone that promise most, else all but these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Group.of(batch, row, kind)
                windows = Windows.of(batch, row, block)
                listed = batch.column("nodes")[row].values
                names = listed.field("node").to_numpy()
                said = np.frombuffer(b"".join(listed.field("said").to_pylist()), np.uint8).reshape(len(names), -1)
                real, whole = said[:, :-24].copy().view("<f8"), said[:, -24:].copy().view("<i8")
                w = kind.width
                chunks = Nodes(real[:, :w], real[:, w : 2 * w], real[:, 2 * w : 3 * w], real[:, 3 * w], whole[:, 0], whole[:, 1], whole[:, 2])
                own = block.nodes()
                fits = own.meet(chunks, Needs(*(np.full(len(block.starts), x) for x in (-np.inf, np.inf, MOST))), same).any(axis=0)
                # nearness of means to the greatest score allowed, or the greatest inner product
                near = own.mean.mean(axis=0) @ chunks.mean.T
                goal = windows.high.astype(float).mean() if len(windows.high) and windows.high.max() < MOST else np.inf
                promise = -np.abs(near - goal) if np.isfinite(goal) else near
                best = np.lexsort((names, -np.where(fits, promise, -np.inf)))[:FIRST]
                best = best[fits[best]]
                if first:
                    chosen = best
                else:
                    wanted = own.meet(chunks, windows.needs(block.starts), same).any(axis=0)
                    wanted[best] = False
                    chosen = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), batch.column("node")[row].as_py(), np.int64)), pa.array(names[chosen])], names=["block", "chunk"])

    table, n = pages
    dealt = blocks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("page", F.col("page").cast("bigint"))
    return dealt.join(table, "page").mapInArrow(run, "block bigint, chunk bigint")


def _leaf_pairs(block: Group, windows: Windows, chunk: Group, kind: Kind, same: bool, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows (positions) and what they get from a chunk: score, id and uid, at most ``most`` a window."""
    meet = block.nodes().meet(chunk.nodes(), windows.needs(block.starts), same)
    ends, chunk_ends = np.append(block.starts[1:], len(block.ids)), np.append(chunk.starts[1:], len(chunk.ids))
    for leaf in np.flatnonzero(meet.any(axis=1)):
        a, b = np.searchsorted(windows.at, [block.starts[leaf], ends[leaf]])
        cols = np.concatenate([np.arange(chunk.starts[k], chunk_ends[k]) for k in np.flatnonzero(meet[leaf])])
        rows = windows.at[a:b] - block.starts[leaf]
        anchors = slice(block.starts[leaf], ends[leaf])
        score = kind.scores(block.v[anchors], chunk.v[cols])[rows]
        alike = block.labels[anchors][rows][:, None] == chunk.labels[cols]
        fits = (alike & (block.uids[anchors][rows][:, None] != chunk.uids[cols])) if same else ~alike
        fits &= (score >= windows.low[a:b, None]) & (score <= windows.high[a:b, None])
        fits &= (score > windows.score[a:b, None]) | ((score == windows.score[a:b, None]) & (chunk.ids[cols] < windows.id[a:b, None]))
        if len(cols) > most:
            enough = np.partition(np.where(fits, score, LEAST), -most, axis=1)[:, -most]
            fits &= score >= enough[:, None]
        w, c = np.nonzero(fits)
        if len(w):
            order = np.lexsort((chunk.uids[cols[c]], chunk.ids[cols[c]], -score[w, c], w))
            w, c = w[order], c[order]
            begin = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
            some = np.arange(len(w)) - np.repeat(begin, np.diff(np.append(begin, len(w)))) < most
            w, c = w[some], c[some]
            yield a + w, score[w, c], chunk.ids[cols[c]], chunk.uids[cols[c]]


def _score(pairs: DataFrame, blocks: DataFrame, chunks: DataFrame, kind: Kind, same: bool, most: int) -> DataFrame:
    """uid (of the anchor), key (of the window), score, id and other (uid): the best of each pair of block and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, chunk = Group.of(batch, row, kind), Group.of(batch, row, kind, "c_")
                windows = Windows.of(batch, row, block)
                for w, score, id_, other in _leaf_pairs(block, windows, chunk, kind, same, most):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.uids[windows.at[w]], windows.key[w], score, id_, other)], names=["uid", "key", "score", "id", "other"])

    other = chunks.select(*(F.col(c).alias(f"c_{c}") for c in chunks.columns))
    units = pairs.join(blocks, F.col("block") == F.col("node")).drop("node").join(other, F.col("chunk") == F.col("c_node"))
    return units.mapInArrow(run, "uid bigint, key bigint, score bigint, id bigint, other bigint")


def _best(found: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("uid", "key").orderBy(F.desc("score"), "id", "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= most)


def _search(windows: DataFrame, blocks: DataFrame, chunks: DataFrame, pages: tuple[DataFrame, int], kind: Kind, same: bool, most: int) -> DataFrame:
    """The best ``most`` rows of each window (uid, key, low, high): uid, key, score, id, other and rank."""
    lies = blocks.select(F.explode("uids").alias("uid"), "node")

    def dealt(bounds: DataFrame) -> DataFrame:
        listed = bounds.join(lies, "uid").groupBy("node").agg(F.collect_list(F.struct("uid", "key", "low", "high", "score", "id")).alias("windows"))
        return keep(blocks.join(listed, "node"), "windows")

    begin = dealt(windows.withColumn("score", F.lit(int(LEAST))).withColumn("id", F.lit(int(MOST))))
    found = keep(_best(_score(_plan(begin, pages, kind, same, True), begin, chunks, kind, same, most), most), "first")
    last = found.where(F.col("rank") == most).select("uid", "key", "score", "id")
    known = windows.join(last, ["uid", "key"], "left").na.fill({"score": int(LEAST), "id": int(MOST)})
    then = dealt(known)
    rest = _score(_plan(then, pages, kind, same, False), then, chunks, kind, same, most)
    return keep(_best(found.drop("rank").union(rest), most), "best")


def _hundredths(score: Column, hundredths: int, up: bool) -> Column:
    """A share of a score, rounded up or down."""
    share = score.cast("decimal(20,0)") * F.lit(hundredths).cast("decimal(3,0)")
    return F.call_function("div", share + F.pmod(-share, F.lit(100)) if up else share - F.pmod(share, F.lit(100)), F.lit(100))


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has vec_id, vector (of whole numbers) and label (a whole number); ``anchor`` says which rows are anchors.
    """
    chosen = rows.where("label is not null and vector is not null").select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"), (F.col("vec_id").isNotNull() & F.coalesce(anchor, F.lit(False))).alias("anchor"))
    stored = keep(chosen.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("id", F.lit(int(MOST))).alias("id"), "label", "vector", "anchor"), "vectors")
    size = F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x, F.bitwise_not(x)))
    width, largest = stored.agg(F.max(F.size("vector")), F.max(size)).first()
    kind = Kind.of(max(1, width or 0), (largest or 0) + 1)
    sample = stored.orderBy(F.xxhash64("uid")).limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    tops = _fit(kind.matrix(sample))
    celled = keep(_cells(stored, kind, tops), "cells")
    chunks = keep(_tree(celled, kind, CHUNK, LEAF), "chunks")
    blocks = keep(_tree(celled.where("anchor"), kind, BLOCK, TWIG), "blocks")
    pages = _pages(chunks, kind)

    every = blocks.select(F.explode("uids").alias("uid")).select("uid", F.lit(0).cast("bigint").alias("key"), F.lit(int(LEAST)).alias("low"), F.lit(int(MOST)).alias("high"))
    near = _search(every, blocks, chunks, pages, kind, True, positives)
    p = F.col("score")
    windows = near.select("uid", p.alias("key"), _hundredths(p, low, True).alias("low"), _hundredths(p, high, False).alias("high")).where("low <= high").distinct()
    far = _search(keep(windows, "wanted"), blocks, chunks, pages, kind, False, negatives)
    anchors = stored.where("anchor").select("uid", F.col("id").alias("anchor_id"))
    pairs = near.select("uid", F.col("score").alias("key"), F.col("id").alias("positive_id"))
    got = far.select("uid", "key", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["uid", "key"]).join(anchors, "uid")
    named = [F.when(F.col(c) < int(MOST), F.col(c)).alias(c) for c in ("positive_id", "negative_id")]
    return got.select("anchor_id", named[0], "rank", named[1], F.col("key").alias("positive_score"), "negative_score")
