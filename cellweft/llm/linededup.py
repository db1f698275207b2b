"""Line dedup with a log-template tree.

Each line is parsed by a tree of fixed depth: its token count, its first
``DEPTH`` tokens, then ``BLOCKS`` levels, one for each block of its other tokens
(of as equal lengths as can be).  A token with a digit is a variable at every
level, but in lines that have no other token.  At a block's level a line goes down the branch of the block's tokens and
the variable branch, the latter at ``VARIABLE`` blocks at most and as long as
``SIMILAR`` of all its positions are not in them.  A leaf is a template: lines
that share it differ in its variable fields alone.  Of a line's leaves only the
most general are kept, as a template of fewer fields is found wherever its lines
are.  A template found in ``MIN_DOCS`` or more documents recurs.  A line belongs to
that of its recurring templates which most documents have (of equal ones, the least
hash); it stays in the least document that has a line of that template and is
dropped elsewhere.

Leaves follow from the line alone, and counts are whole, so results do
not depend on order, layout or size, and no task gathers the lines of a leaf:
leaves are counted by document as any grouping is.  A pass that
changes costs only comes before: lines are counted by their leading levels, and what too
few rows share there isn't taken down the tree.  Equal lines of a batch are one
row with the documents that hold it.

Defined cases: a null text stays null and has no lines; lines without a word, and those
of fewer than ``MIN_VARIABLES`` tokens that all have digits, are never dropped; null doc_ids count as one
document, first of all; repeated rows of an id are one document, each of which
keeps or drops alike; lines of any length are parsed whole; extra columns are
kept as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text as T
from ._store import bound_batches, keep

DEPTH = 3
BLOCKS = 7
VARIABLE = 2
SIMILAR = 0.7
MIN_DOCS = 3
MIN_TOKENS = 1
#: Tokens from which a line may have no token but those with digits.
MIN_VARIABLES = 3
#: Recurring lines, or leading levels of the tree, that are sent to every task (16 bytes each); beyond it they are joined.
BROADCAST_LINES = 2_000_000
_NO_ID = -(1 << 63)
_WILD = 1
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))


class Parsed:
    """Lines of a piece: their spans, and of those in the tree row, place, hash, and leaf of the leading levels."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.lines = T.lines(data, offsets)
        words = T.runs(data, offsets, T.SPACED)
        h = T.hashes(T.prefix_sums(data), words.starts, words.ends, data)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        variable = digits[words.ends] > digits[words.starts]
        first = np.searchsorted(words.starts, self.lines.starts)
        last = np.searchsorted(words.starts, self.lines.ends)
        constant = np.concatenate([[0], np.cumsum(~variable)])
        n, some = last - first, constant[last] > constant[first]
        h[variable & np.repeat(some, n)] = _WILD
        self.at = np.flatnonzero((n >= MIN_TOKENS) & ((n >= MIN_VARIABLES) | some))
        self.first, self.last = first[self.at], last[self.at]
        n = self.last - self.first
        up, self.down = T._powers.get(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(T.mix(h) * up[: len(h)], out=self.sums[1:])
        self.hash = self._run(self.first, self.last)
        leaf = T.mix(n.astype(np.uint64))
        for k in range(DEPTH):
            leaf = T.mix(leaf * np.uint64(31) + np.where(n > k, h[np.minimum(self.first + k, len(h) - 1)], 0)) if len(h) else leaf
        self.leaf = leaf
        self.row = self.lines.rows()[self.at]

    def _run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the tokens from a to b."""
        return T.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def templates(self, of: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``of``, template) of each most general leaf of the lines ``of``."""
        first, last, leaf = self.first[of], self.last[of], self.leaf[of]
        n = last - first
        rest = np.minimum(first + DEPTH, last)
        budget = n - np.ceil(similar * n - 1e-9).astype(np.int64)
        cut = [rest + (last - rest) * b // BLOCKS for b in range(BLOCKS + 1)]
        size = [cut[b + 1] - cut[b] for b in range(BLOCKS)]
        block = [T.mix(self._run(cut[b], cut[b + 1]) + np.uint64(b)) for b in range(BLOCKS)]
        whole = leaf + sum(block, np.zeros(len(of), np.uint64))
        rows, out = [], []
        general = {}  # of each choice of blocks: where a larger one is possible
        for k in range(VARIABLE, -1, -1):
            for chosen in combinations(range(BLOCKS), k):
                able = sum((size[b] for b in chosen), np.zeros(len(of), np.int64)) <= budget
                for b in chosen:
                    able &= size[b] > 0
                covered = general.get(chosen, np.zeros(len(of), bool))
                for b in range(k):
                    less = chosen[:b] + chosen[b + 1 :]
                    general[less] = general.get(less, np.zeros(len(of), bool)) | able | covered
                at = np.flatnonzero(able & ~covered)
                code = whole[at]
                for b in chosen:
                    code = code - block[b][at] + T.mix(np.array([b + BLOCKS + 1], np.uint64))
                rows.append(at)
                out.append(T.mix(code))
        return np.concatenate(rows), np.concatenate(out)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, _NO_ID).to_numpy()


def _distinct(line: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct lines, offsets, and each line's distinct documents."""
    order = np.lexsort((doc, line))
    line, doc = line[order], doc[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    line, doc = line[new], doc[new]
    keys, start = np.unique(line, return_index=True)
    return keys, np.append(start, len(line)), doc


def _place(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where each value is in the sorted table, if it is there."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return at


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading levels and in how many documents of a piece they are."""
    for batch in batches:
        ids = _ids(batch.column("doc_id"))
        for i, _, data, offsets in T.pieces(batch.column("text")):
            p = Parsed(data, offsets)
            keys, cut, _ = _distinct(p.leaf, ids[i + p.row])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.diff(cut))], names=["leaf", "n"])


def _rows(batches: Iterator[pa.RecordBatch], similar: float, shared) -> Iterator[pa.RecordBatch]:
    """Distinct lines of a piece: leaf, line, documents and templates; of the ``shared`` leaves, or of all."""
    table = None if shared is None else shared.value
    for batch in batches:
        ids = _ids(batch.column("doc_id"))
        for i, _, data, offsets in T.pieces(batch.column("text")):
            p = Parsed(data, offsets)
            leaf = p.leaf.view(np.int64)
            of = np.arange(len(leaf)) if table is None else np.flatnonzero(table[_place(leaf, table)] == leaf) if len(table) else np.zeros(0, np.int64)
            keys, cut, docs = _distinct(p.hash[of], ids[i + p.row[of]])
            one = of[np.unique(p.hash[of], return_index=True)[1]]
            row, template = p.templates(one, similar)
            order = np.argsort(row, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(one)))])
            lists = (pa.ListArray.from_arrays(pa.array(c.astype(np.int32)), pa.array(v)) for c, v in ((cut, docs), (ends, template[order].view(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(p.leaf[one].view(np.int64)), pa.array(keys.view(np.int64)), *lists], names=["leaf", "line", "docs", "templates"])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def recurring(documents: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """line (hash), template (hash) and first_doc of the lines of recurring templates."""
    texts = _texts(documents)
    leads = texts.mapInArrow(_leads, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    leads = keep(leads, "leads")
    shared = None
    if leads.count() <= broadcast_lines:
        shared = documents.sparkSession.sparkContext.broadcast(np.sort(leads.toArrow().column("leaf").to_numpy()))
    rows = texts.mapInArrow(lambda b: _rows(b, similar, shared), "leaf bigint, line bigint, docs array<bigint>, templates array<bigint>")
    if shared is None:
        rows = rows.join(leads, "leaf", "left_semi")
    rows = keep(rows.drop("leaf"), "rows")
    if shared is not None:
        shared.destroy()
    places = rows.select("line", "docs", F.explode("templates").alias("template"))
    found = places.select("template", F.explode("docs").alias("doc")).distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    own = places.select("line", "template", F.array_min("docs").alias("least")).join(keep(found, "templates"), "template")
    best = F.min(F.struct((-F.col("n")).alias("fewer"), "template"))
    own = own.groupBy("line").agg(best.alias("best"), F.min("least").alias("least")).select("line", "best.template", "least")
    own = keep(own, "chosen")
    return keep(own.join(own.groupBy("template").agg(F.min("least").alias("first_doc")), "template").select("line", "template", "first_doc"), "lines")


def dedup(documents: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Struct ``row`` (the document, its text without dropped lines), n_lines and dropped (line numbers from 0)."""
    spark = documents.sparkSession
    bound_batches(spark)
    lines = recurring(documents, min_docs, similar, broadcast_lines)
    names = documents.columns
    # the row without its text, which would travel twice
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names if c != "text")).alias("row")
    whole = documents.select(rest, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if lines.count() <= broadcast_lines:
        table = lines.select("line", "first_doc").toArrow()
        line, first = (table.column(c).to_numpy() for c in ("line", "first_doc"))
        order = np.argsort(line)
        shared = spark.sparkContext.broadcast((line[order], first[order]))
        more = StructType.fromDDL("text string, n_lines int, dropped array<int>")
        got = whole.mapInArrow(lambda b: _drop(b, shared), StructType([whole.schema["row"], *more.fields]))
    else:
        key = F.xxhash64("text")
        spread = _texts(documents).select("doc_id", key.alias("key"), "text").distinct().mapInArrow(_places, "doc_id bigint, key bigint, place int, line bigint")
        gone = spread.join(lines.select("line", "first_doc"), "line").where(F.col("doc_id") != F.col("first_doc")).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("place")).alias("dropped"))
        gone = keep(gone.withColumnsRenamed({"doc_id": "id2", "key": "key2"}), "gone")
        got = whole.withColumn("key", key).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).join(gone, (F.col("id") == F.col("id2")) & (F.col("key") == F.col("key2")), "left")
        parts = F.split("text", "\n", -1)
        left = F.array_join(F.filter(parts, lambda x, k: ~F.array_contains("dropped", k)), "\n")
        got = got.select("row", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left).alias("text"), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
        got = got.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    row = F.struct(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names))
    return got.select(row.alias("row"), "n_lines", "dropped")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, key = _ids(batch.column("doc_id")), batch.column("key").to_numpy()
        for i, _, data, offsets in T.pieces(batch.column("text")):
            p = Parsed(data, offsets)
            place = p.at - p.lines.row[p.row]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i + p.row]), pa.array(key[i + p.row]), pa.array(place.astype(np.int32)), pa.array(p.hash.view(np.int64))], names=["doc_id", "key", "place", "line"])


def _drop(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    line, first = shared.value
    for batch in batches:
        ids, null = _ids(batch.column("doc_id")), batch.column("text").is_null().to_numpy(zero_copy_only=False)
        for i, j, data, offsets in T.pieces(batch.column("text")):
            p = Parsed(data, offsets)
            h = p.hash.view(np.int64)
            at = _place(h, line)
            gone = (line[at] == h) & (first[at] != ids[i + p.row]) if len(line) else np.zeros(len(h), bool)
            gone = p.at[gone]
            keep_line = np.ones(len(p.lines.starts), bool)
            keep_line[gone] = False
            view = data.tobytes()
            cut = np.searchsorted(gone, p.lines.row)
            texts, dropped = [], []
            for r in range(j - i):
                a, b = p.lines.row[r], p.lines.row[r + 1]
                if null[i + r]:
                    texts.append(None)
                elif cut[r] == cut[r + 1]:
                    texts.append(view[offsets[r] : offsets[r + 1]].decode())
                else:
                    texts.append(b"\n".join(view[p.lines.starts[k] : p.lines.ends[k]] for k in range(a, b) if keep_line[k]).decode())
                dropped.append((gone[cut[r] : cut[r + 1]] - a).tolist())
            count = np.where(null[i:j], 0, p.lines.count).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(texts, pa.string()), pa.array(count), pa.array(dropped, pa.list_(pa.int32()))], names=["row", "text", "n_lines", "dropped"])
