"""Best-fit packing: tokenised documents into as few sequences of a fixed length as can be found.

``pieces`` tokenises whole texts, ends each with an id and cuts those that are
longer than a sequence.  How pieces are packed depends on their lengths alone, so
what is searched is the number of pieces of each length, at most ``CAPACITY``
numbers whatever the corpus; the pieces themselves are never gathered.

The search is bin completion.  Around the largest piece left, the undominated
fillings of the rest of its sequence are enumerated, least waste first (a filling
is dominated if its pieces fit into those of another); the chosen one is taken as
often as the counts allow, and the search goes on with what is left.  A branch
ends where its sequences and the least number that the rest needs (from the waste
that pieces above half a sequence must leave) reach the incumbent, which at first
is best-fit decreasing.  The search ends at a plan that meets the lower bound, or
after ``NODES`` fillings; either way every piece is placed.  ``FILLINGS`` bounds
the branches of a node.

Pieces are then dealt to the plan.  A piece's number among those of its length is
its number in its task plus the counts of the tasks before, from a table of a row
a task and length; the plan, a few rows a length, says where such a number lies.

Defined cases: null and empty texts are the end id alone; texts are taken in
segments cut at white space, so a long text needs memory for itself and a few
segments; rows alike in doc_id and text are each packed; null doc_ids are packed;
an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import bounded, keep

CAPACITY = 2048
END = 0
#: Fillings that one search takes, those of one node, and those that are looked at for each of these.
NODES = 6000
FILLINGS = 6
TRIED = 8
#: Bytes of a text that are split at once, and distinct stretches whose ids a generation of a worker's memory holds, unless a segment has more.
SEGMENT = 1 << 20
REMEMBERED = 800_000

Plan = list[tuple[tuple[int, ...], int]]


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers.

    For tokenizers that drop white space and case and treat runs of letters and of
    signs on their own, as that of ``word_bpe_49k.json``: ids of a stretch without
    white space are remembered, and a word with signs behind it is put together from
    both.  What has not come up for a generation of ``REMEMBERED`` is forgotten.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        for some in range(0, len(new), 4096):
            part = new[some : some + 4096]
            for w, e in zip(part, self.model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _add(self, words: set[bytes]) -> None:
        if len(self.known) + 2 * len(words) > REMEMBERED:
            self.known, self.before = {}, self.known
        before, known = self.before, self.known
        plain, need = [], set()
        for w in words:
            if w in before:
                known[w] = before[w]
            elif (stem := w.rstrip(_SIGNS)).isalpha():
                own, signs = stem.lower(), w[len(stem) :]
                plain.append((w, own, signs))
                need.add(own)
                need.add(signs)
            else:
                need.add(w)
        need = need.difference(known)
        old = [w for w in need if w in before]
        known.update(zip(old, map(before.__getitem__, old), strict=True))
        self._learn([w for w in need.difference(old) if w])
        for w, own, signs in plain:
            known[w] = known[own] + known[signs] if signs else known[own]

    def segments(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text, segment by segment."""
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + SEGMENT)
            last = cut.start() if cut else len(text)
            words = text[at:last].split()
            new = set(words).difference(self.known)
            if new:
                if len(self.known) + 2 * len(new) > REMEMBERED:
                    new = set(words)
                self._add(new)
            yield b"".join(map(self.known.__getitem__, words))
            at = last


_SPACE = re.compile(rb"[ \t-\r]")
#: Signs which no rule of the tokenizer joins with ASCII letters before them.
_SIGNS = b"!#$%&()*+,-./:;?@[]^_`{}~"
_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece (from 0), start, length and ids (little-endian unsigned 32-bit) of each piece; task and number tell equal lengths apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        last, width = int(end).to_bytes(4, "little"), 4 * capacity
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "task", "number"])

        for batch in batches:
            texts = batch.column("text")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                rest, piece = b"", 0
                text = texts[i].as_py()
                for ids in [*([] if text is None else [text]), None]:
                    for more in encoder.segments(ids) if ids is not None else [last]:
                        rest += more
                        while len(rest) > width or ids is None and rest:
                            own, rest = rest[:width], rest[width:]
                            n = len(own) // 4
                            rows.append((doc, piece, piece * capacity, n, own, task, int(seen[n])))
                            seen[n] += 1
                            piece += 1
                            held += len(own)
                        if held >= 4 * SEGMENT:
                            yield batch_of()
                            rows, held = [], 0
        if rows:
            yield batch_of()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary, task int, number bigint")


def bound(have: np.ndarray) -> int:
    """Sequences that the pieces need at least: for each a, those longer than all but a are alone, and what is from a to half a sequence fills up the rest."""
    capacity = len(have) - 1
    n, total = np.cumsum(have), np.cumsum(have * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(half + 1)
    alone, long = n[-1] - n[capacity - a], n[capacity - a] - n[half]
    below = np.maximum(a - 1, 0)
    fill = total[half] - total[below] - (long * capacity - (total[capacity - a] - total[half]))
    return int((alone + long + np.maximum(0, -(-fill // capacity))).max())


def best_fit(have: np.ndarray) -> Plan:
    """Best-fit decreasing: the incumbent.  Sequences filled alike are one entry with their number."""
    capacity = len(have) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: [((), int(have.sum()))]}
    for length in np.flatnonzero(have)[::-1].tolist():
        left = int(have[length])
        while left:
            room = min(r for r in open_ if r >= length)
            filled, m = open_[room].pop()
            if not open_[room]:
                del open_[room]
            k = min(room // length, left)
            some = min(m, left // k)
            if some < m:
                open_.setdefault(room, []).append((filled, m - some))
            open_.setdefault(room - k * length, []).append((filled + (length,) * k, some))
            left -= some * k
    return [(filled, m) for groups in open_.values() for filled, m in groups if filled]


def dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of ``other`` fit into those of ``one``."""
    if not other:
        return True
    first, rest = other[0], other[1:]
    return any(x >= first and dominates(tuple(sorted((*one[:k], *one[k + 1 :], x - first), reverse=True)), rest) for k, x in enumerate(one) if k == 0 or one[k - 1] != x)


def fillings(have: np.ndarray, room: int, most: int = FILLINGS) -> Iterator[tuple[int, ...]]:
    """At most ``most`` undominated fillings of ``room``, least waste first and then largest pieces first."""
    have = have[: room + 1].copy()
    lengths = np.flatnonzero(have)[::-1].tolist()
    if not lengths:
        yield ()
        return
    if lengths[0] == room:
        yield (room,)
        return
    pairs = [(a, room - a) for a in lengths if 2 * a >= room and have[room - a] > (2 * a == room)]
    if pairs:
        yield from pairs[:most]
        return
    # which sums the lengths from the k-th on reach, as bits
    reach, bits, every = [1], 1, (1 << (room + 1)) - 1
    for length in reversed(lengths):
        left, step = min(int(have[length]), room // length), 1
        while left:
            bits |= bits << (length * min(step, left)) & every
            left, step = left - min(step, left), step * 2
        reach.append(bits)
    reach.reverse()

    def walk(k: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        while left:
            length = lengths[k]
            for c in range(min(int(have[length]), left // length), 0, -1):
                if reach[k + 1] >> (left - c * length) & 1:
                    yield from walk(k + 1, left - c * length, chosen + (length,) * c)
            k += 1
            if not reach[k] >> left & 1:
                return
        yield chosen

    every_one = (f for total in range(room, 0, -1) if reach[0] >> total & 1 for f in walk(0, total, ()))
    out: list[tuple[int, ...]] = []
    for f in islice(every_one, TRIED * most):
        uses, waste = Counter(f), room - sum(f)
        fits = waste >= lengths[-1] and any(have[x] > uses[x] for x in lengths if x <= waste)
        if not fits and not (len(f) <= 8 and any(dominates(g, f) for g in out)):
            out.append(f)
            yield f
            if len(out) == most:
                return


def complete(have: np.ndarray, nodes: int = NODES, most: int = FILLINGS) -> Plan:
    """The best plan found for ``have`` pieces of each length (position = length): fillings and how often each is taken."""
    have = have.astype(np.int64).copy()
    best, lower = best_fit(have), bound(have)
    fewest = sum(m for _, m in best)

    def options() -> Iterator[tuple[int, ...]]:
        largest = int(np.flatnonzero(have)[-1])
        have[largest] -= 1
        rest = have.copy()
        have[largest] += 1
        return ((largest, *f) for f in fillings(rest, len(have) - 1 - largest, most))

    chosen: Plan = []
    used = 0

    def take(step: tuple[int, ...], m: int) -> None:
        for length in step:
            have[length] -= m

    frames = [options()] if have.any() and fewest > lower else []
    while frames and fewest > lower and nodes > 0:
        step = next(frames[-1], None)
        if step is not None:
            m = min(int(have[x]) // c for x, c in Counter(step).items())
            take(step, m)
            chosen.append((step, m))
            used += m
            nodes -= 1
            if have.any() and used + bound(have) < fewest:
                frames.append(options())
                continue
            if not have.any() and used < fewest:
                best, fewest = list(chosen), used
        else:
            frames.pop()
        if chosen:
            step, m = chosen.pop()
            take(step, -m)
            used -= m
    return best


def places(plan: Plan, capacity: int) -> np.ndarray:
    """Rows length, number (of its first piece among those of this length), sequence, offset, copies (of this length in a sequence), by the first two."""
    given, rows, sequence = [0] * (capacity + 1), [], 0
    for filled, m in plan:
        offset = 0
        for length, copies in sorted(Counter(filled).items(), reverse=True):
            rows.append((length, given[length], sequence, offset, copies))
            given[length] += copies * m
            offset += copies * length
        sequence += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, most: int = FILLINGS) -> DataFrame:
    """The rows of ``cut`` (from ``pieces``, with any columns besides) with sequence_id and offset."""
    cut = keep(cut, "pieces")
    each = keep(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    have = np.zeros(capacity + 1, np.int64)
    for length, n in each.groupBy("length").agg(F.sum("n").alias("n")).collect():
        have[length] = n
    table = places(complete(have, nodes, most), capacity)
    shift = np.int64(1) << np.int64(42)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(key, length * shift + rank, "right") - 1]
            after = rank - row[:, 1]
            found = [row[:, 2] + after // row[:, 4], row[:, 3] + after % row[:, 4] * length]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(each.select(F.col("task").alias("of"), F.col("length").alias("long"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    names = [c for c in cut.columns if c not in ("task", "number")]
    ranked = cut.join(bounded(starts), (F.col("task") == F.col("of")) & (F.col("length") == F.col("long"))).select(*names, (F.col("before") + F.col("number")).alias("rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, its ids and the doc_ids whose pieces it holds in order; ``packed`` still has ids."""
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = F.aggregate("own", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", joined.alias("ids"), F.col("own.doc_id").alias("doc_ids"))
