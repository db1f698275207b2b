"""Benchmark decontamination by suffix arrays over the training texts.

Every task turns its documents, in shards of ``SHARD_BYTES``, into words and
sorts the suffixes that begin with a word pair of the benchmark (any other
cannot match a window) into a suffix array.  Each distinct window of the
benchmark is binary-searched in each shard, which gives the range of suffixes
that begin with it, so every location; each found suffix of an item is searched
again at full length for its longest verbatim match and its place.  Documents
with a hit are then removed.

Words are ids in the benchmark's vocabulary; words outside it get one id that
matches nothing, so matches are verbatim word for word.

Memory.  Equal items are one class, equal windows one window, and what is found
stays ranges of the suffix array: a passage that repeats costs its places, never
places times windows.  The benchmark is met in blocks of at most ``block_bytes``
(an item longer than that is a block of its own), one after the other: a block is
sent out, met by all documents, its hits are written and it is withdrawn before
the next.  Hits are rows of hit texts only; they are named by two hashes of the
text and joined back, so documents do not travel with them.

Defined cases: null, empty and wordless texts and items have no windows and are
never hit; an item with fewer words than a window is one window; null item_ids
hit like others but are not named; repeated rows each get their result; items
with equal ids are one item; texts of any length are searched whole; extra
columns are ignored by ``search`` and kept by ``clean``, whatever their names; an
empty table of either kind means no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import keep, text_keys, without

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20
#: Rounds of refinement of all words that one doubling of their ranks costs, about.
DOUBLING = 8
#: Item classes of windows that are laid side by side at once.
LISTED = 1 << 20
#: The words of a text, A-Z counting as a-z (said by what is in them, as Java is slow at finding what is not).
WORDS = r"[0-9A-Za-z\x80-\x{10FFFF}]+"


def _ranks(words: np.ndarray, width: int) -> np.ndarray:
    """Equal numbers for equal runs of ``width`` symbols, in their order; the end is padded with -1."""
    held = {1: np.unique(words, return_inverse=True)[1].astype(np.int64) + 1}

    def joined(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros(len(a), np.int64)
        after[: max(0, len(a) - step)] = b[step:]
        return np.unique(a * (len(words) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1

    k = 1
    while 2 * k <= width:
        held[2 * k] = joined(held[k], held[k], k)
        k *= 2
    out, done = held[k], k
    while done < width:
        k = 1 << (width - done).bit_length() - 1
        out, done = joined(out, held[k], done), done + k
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run."""
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


@dataclass
class Block:
    """A block of benchmark items as word ids, with its vocabulary and its distinct windows."""

    vocabulary: np.ndarray  # sorted word hashes; id = position + 1
    words: np.ndarray  # ids of all classes of equal items, a 0 after each
    item: np.ndarray  # class of each word
    names: list[list[str]]  # of each class
    starts: np.ndarray  # a first word of each distinct window
    widths: np.ndarray
    cut: np.ndarray  # where each window's classes begin
    classes: np.ndarray
    pairs: np.ndarray  # sorted codes of leading word pairs
    singles: np.ndarray  # sorted ids of one-word windows

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int) -> Block:
        data, offsets = T.buffers(pa.array([t for _, t in rows], pa.large_string()))
        data, offsets = T.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
        spans = T.runs(data, offsets, T.PLAIN)
        vocabulary, ids = np.unique(T.hashes(T.prefix_sums(data), spans.starts, spans.ends, data), return_inverse=True)
        ids = ids.astype(np.int64) + 1
        same: dict[bytes, int] = {}
        names: list[set[str]] = []
        parts = [np.zeros(0, np.int64)]
        for k, (name, _) in enumerate(rows):
            own = ids[spans.row[k] : spans.row[k + 1]]
            if not len(own):
                continue
            place = same.setdefault(own.tobytes(), len(names))
            if place == len(names):
                names.append(set())
                parts.append(np.append(own, 0))
            if name is not None:
                names[place].add(name)
        words = np.concatenate(parts)
        length = np.array([len(p) - 1 for p in parts[1:]], np.int64)
        at = np.concatenate([[0], np.cumsum(length + 1)])
        item = np.repeat(np.arange(len(names)), length + 1)
        per = np.where(length >= window, length - window + 1, 1)
        first, width, owner = _spread(at[:-1], per), np.repeat(np.minimum(length, window), per), np.repeat(np.arange(len(names)), per)
        starts, widths, code, base = [], [], np.zeros(len(first), np.int64), 0
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            _, one, number = np.unique(_ranks(words, w)[first[of]], return_index=True, return_inverse=True)
            starts.append(first[of][one])
            widths.append(np.full(len(one), w, np.int64))
            code[of] = number + base
            base += len(one)
        starts, widths = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, widths))
        listed = np.unique(code * max(1, len(names)) + owner)
        classes, code = listed % max(1, len(names)), listed // max(1, len(names))
        two = widths > 1
        pairs = np.unique(words[starts[two]] * (len(vocabulary) + 1) + words[starts[two] + 1])
        return cls(vocabulary, words, item, [sorted(n) for n in names], starts, widths, np.searchsorted(code, np.arange(base + 1)), classes, pairs, np.unique(words[starts[~two]]))


def suffix_array(words: np.ndarray, starts: np.ndarray, base: int, longest: int, doubling: float = DOUBLING) -> np.ndarray:
    """``starts`` in the order of the suffixes there, as far as ``longest`` words (at least).

    Groups of equal suffixes so far are refined by their next three words; where
    so many are equal that this would cost more, by ranks of doubled length.
    """
    padded = np.concatenate([words, np.zeros(longest + 4, np.int64)])
    step = 3 if base**3 < 1 << 62 else 1

    def key(pos: np.ndarray, depth: int) -> np.ndarray:
        out = padded[pos + depth]
        for k in range(1, step):
            out = out * base + padded[pos + depth + k]
        return out

    first = key(starts, 0)
    order = np.argsort(first, kind="stable")
    sa, first = starts[order], first[order]
    group = np.cumsum(np.concatenate([[0], np.diff(first) != 0])) if len(sa) else np.zeros(0, np.int64)
    depth = step
    while depth < longest and len(sa):
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        deep = len(tied) * (longest - depth) / step > doubling * len(words)
        k = _ranks(padded, longest)[sa[tied]] if deep else key(sa[tied], depth)
        o = np.lexsort((k, group[tied]))
        sa[tied], k = sa[tied[o]], k[o]
        if deep:
            break
        new = np.zeros(len(sa), bool)
        new[1:] = group[1:] != group[:-1]
        new[tied[1:][(k[1:] != k[:-1]) & (group[tied[1:]] == group[tied[:-1]])]] = True
        group = np.cumsum(new)
        depth += step
    return sa


def _compare(text: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of text suffix against query prefix of ``width`` words, and the common length."""
    n = len(at)
    sign, common = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(width > 0)
    k = 0
    while len(live):
        a, b = text[at[live] + k], query[start[live] + k]
        differ = a != b
        sign[live[differ]] = np.where(a[differ] < b[differ], -1, 1)
        common[live[differ]] = k
        k += 1
        live = live[~differ]
        done = width[live] <= k
        common[live[done]] = k
        live = live[~done]
    return sign, common


def _search(text: np.ndarray, sa: np.ndarray, query: np.ndarray, start: np.ndarray, width: np.ndarray, after: bool) -> np.ndarray:
    """First place in ``sa`` whose suffix is not below (after: is above) the query prefix."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        sign, _ = _compare(text, sa[mid], query, start[open_], width[open_])
        right = sign <= 0 if after else sign < 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


@dataclass
class Found:
    """Hits of a shard: spans (row, first and one past the last word), (row, item class) pairs and longest matches."""

    rows: np.ndarray  # hit rows
    spans: np.ndarray
    items: np.ndarray
    longest: np.ndarray  # row, class, word of the item, word of the text, words


def search_shard(block: Block, data: np.ndarray, offsets: np.ndarray, detail: bool = True) -> Found:
    """The block's hits in one shard; without ``detail`` only ``rows``."""
    none = Found(np.zeros(0, np.int64), np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64), np.zeros((5, 0), np.int64))
    data = T.LOWER[data]
    spans = T.runs(data, offsets, T.PLAIN)
    if not len(block.starts) or not len(spans.starts):
        return none
    n = len(offsets) - 1
    h = T.hashes(T.prefix_sums(data), spans.starts, spans.ends, data)
    place = np.searchsorted(block.vocabulary, h)
    known = place < len(block.vocabulary)
    known[known] = block.vocabulary[place[known]] == h[known]
    base = len(block.vocabulary) + 2
    at = spans.row + np.arange(n + 1)
    text = np.zeros(at[-1] + 1, np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    text[:-1][inside] = np.where(known, place + 1, base - 1)
    begin, then = text[:-1], text[1:]
    able = np.zeros(len(begin), bool)
    if len(block.pairs):
        pair = begin * (base - 1) + then
        place = np.minimum(np.searchsorted(block.pairs, pair), len(block.pairs) - 1)
        able = (block.pairs[place] == pair) & (then > 0) & (begin > 0) & (then < base - 1) & (begin < base - 1)
    if len(block.singles):
        able |= np.isin(begin, block.singles)
    starts = np.flatnonzero(able)
    if not len(starts):
        return none
    length = np.bincount(block.item[block.words > 0], minlength=len(block.names))
    longest = int(length.max())
    sa = suffix_array(text, starts, base, longest if detail else int(block.widths.max()))
    # windows whose first two words the shard has
    two = block.widths > 1
    wanted = ~two
    code = block.words[block.starts] * (base - 1) + np.where(two, block.words[block.starts + 1], 0)
    wanted[two] = np.isin(code[two], np.unique(begin[starts] * (base - 1) + then[starts]))
    wanted = np.flatnonzero(wanted)
    text = np.concatenate([text, np.zeros(longest + 1, np.int64)])
    query = np.concatenate([block.words, np.full(longest + 1, -1)])
    # a query word 0 ends an item and -1 matches nothing: neither equals a text word in reach
    lo = _search(text, sa, query, block.starts[wanted], block.widths[wanted], False)
    hi = _search(text, sa, query, block.starts[wanted], block.widths[wanted], True)
    some = hi > lo
    got, lo, hi = wanted[some], lo[some], hi[some]
    if not len(got):
        return none
    row_of = np.searchsorted(at, sa, "right") - 1
    # words in reach: of each width, the ranges of its windows are apart
    step = np.zeros(at[-1] + 1, np.int64)
    for w in np.unique(block.widths[got]).tolist():
        of = block.widths[got] == w
        flag = np.zeros(len(sa) + 1, np.int64)
        np.add.at(flag, lo[of], 1)
        np.add.at(flag, hi[of], -1)
        where = sa[np.cumsum(flag[:-1]) > 0]
        np.add.at(step, where, 1)
        np.add.at(step, where + w, -1)
    hit = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    first, last = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    row = np.searchsorted(at, first, "right") - 1
    rows = np.unique(row)
    if not detail:
        return Found(rows, none.spans, none.items, none.longest)
    out = np.stack([row, first - at[row], last - at[row]])
    # (row, window) pairs, then the windows' classes, a bounded number at once
    pair = np.unique(row_of[_spread(lo, hi - lo)] * len(got) + np.repeat(np.arange(len(got)), hi - lo))
    row, window = pair // len(got), got[pair % len(got)]
    per = block.cut[window + 1] - block.cut[window]
    total, items, a = np.concatenate([[0], np.cumsum(per)]), np.zeros(0, np.int64), 0
    while a < len(pair):
        b = max(a + 1, int(np.searchsorted(total, total[a] + LISTED, "right")) - 1)
        listed = block.classes[_spread(block.cut[window[a:b]], per[a:b])]
        items = np.unique(np.concatenate([items, np.repeat(row[a:b], per[a:b]) * len(block.names) + listed]))
        a = b
    return Found(rows, out, np.stack([items // len(block.names), items % len(block.names)]), _longest(block, text, sa, at, query, length, got))


def _longest(block: Block, text: np.ndarray, sa: np.ndarray, at: np.ndarray, query: np.ndarray, length: np.ndarray, got: np.ndarray) -> np.ndarray:
    """Longest matches of the found windows' suffixes: beside their place among the text's suffixes."""
    start = np.sort(block.starts[got])
    own = block.item[start]
    begin = np.searchsorted(block.item, own)
    rest = length[own] - (start - begin)
    full = _search(text, sa, query, start, rest, False)
    best, best_at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for side in (full - 1, full):
        ok = np.flatnonzero((side >= 0) & (side < len(sa)))
        _, common = _compare(text, sa[side[ok]], query, start[ok], rest[ok])
        better = common > best[ok]
        best[ok[better]] = common[better]
        best_at[ok[better]] = sa[side[ok]][better]
    r = np.searchsorted(at, best_at, "right") - 1
    long = np.stack([r, own, start - begin, best_at - at[r], best])
    # a match that only goes on with the one before it says nothing new
    follows = np.zeros(long.shape[1], bool)
    follows[1:] = (long[:2, 1:] == long[:2, :-1]).all(0) & (long[2:4, 1:] == long[2:4, :-1] + 1).all(0) & (long[4, 1:] == long[4, :-1] - 1)
    return long[:, ~follows]


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's items, a block at a time (the driver holds one block)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        held, size = [], 0
        for r in items.where(part == k).toLocalIterator():
            more = len(r.text.encode())
            if held and size + more > block_bytes:
                yield Block.of(held, window)
                held, size = [], 0
            held.append((r.item_id, r.text))
            size += more
        if held:
            yield Block.of(held, window)


_LONGEST = "array<struct<item:string,item_word:int,word:int,words:int>>"
_HITS = f"key1 bigint, key2 bigint, spans array<struct<first:int,last:int>>, items array<string>, longest {_LONGEST}"


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, detail: bool = True) -> DataFrame:
    """A row for each hit text (and block): its keys, hit spans, items and longest matches (empty without ``detail``)."""
    spark = documents.sparkSession
    texts = documents.select(*text_keys(), F.col("text").cast("string").alias("text")).where("text is not null")
    lists = [pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("word", pa.int32()), ("words", pa.int32())]))]

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for i, _, data, offsets in T.pieces(batch.column("text"), SHARD_BYTES):
                    found = search_shard(block, data, offsets, detail)
                    if not len(found.rows):
                        continue
                    place = {r: k for k, r in enumerate(found.rows.tolist())}
                    spans, items, longest = ([[] for _ in place] for _ in range(3))
                    for r, a, b in found.spans.T.tolist():
                        spans[place[r]].append({"first": a, "last": b})
                    for r, k in found.items.T.tolist():
                        items[place[r]].extend(block.names[k])
                    for r, k, s, w, m in found.longest.T.tolist():
                        longest[place[r]].append({"item": min(block.names[k], default=None), "item_word": s, "word": w, "words": m})
                    own = pa.array(found.rows + i)
                    yield pa.RecordBatch.from_arrays([batch.column("key1").take(own), batch.column("key2").take(own), *(pa.array(x, t) for x, t in zip((spans, [sorted(set(x)) for x in items], longest), lists, strict=True))], names=["key1", "key2", "spans", "items", "longest"])

        return run

    out = spark.createDataFrame([], _HITS)
    for block in blocks(benchmark, window, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        got = texts.mapInArrow(finder(shared), _HITS)
        # copies of a text are one row
        out = out.unionByName(keep(got.groupBy("key1", "key2").agg(*(F.first(c).alias(c) for c in ("spans", "items", "longest"))), "hits"))
        shared.destroy()
    return out


def search(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted), longest (matches with places) and contaminated.

    Word positions count the document's words from 0.
    """

    def add(done: Column, span: Column) -> Column:
        return F.struct(F.greatest(done["last"], span["last"]).alias("last"), (done["n"] + F.greatest(F.lit(0), span["last"] - F.greatest(done["last"], span["first"]))).alias("n"))

    # a row a block, so the lists are as many as blocks
    merged = hits(documents, benchmark, window, block_bytes).groupBy("key1", "key2").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "longest")))
    n_hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("last"), F.lit(0).alias("n")), add)["n"]
    merged = merged.select("key1", "key2", n_hit.cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "longest")
    n_words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), n_words.alias("n_words"), *text_keys())
    none = (F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("items", "array<string>"), ("longest", _LONGEST)))
    return rows.join(merged, ["key1", "key2"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), *none, (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns as they are, without those that are hit."""
    found = hits(documents, benchmark, window, block_bytes, detail=False).select("key1", "key2").distinct()
    return without(documents, text_keys(), keep(found, "hit-texts"))
