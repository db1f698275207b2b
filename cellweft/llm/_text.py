"""Vectorised text kernels over Arrow string columns.

All kernels work on the UTF-8 bytes of many texts at once.  Word classes are
ASCII tables, so splitting bytes and splitting code points agree.  Null texts
are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that one kernel call handles, unless one text alone is longer.
PIECE_BYTES = 1 << 20
#: Bytes of a span from which it is hashed on its own.
LONG = 128

_byte = np.arange(256)
#: Words of [^\x20\x09-\x0D]+ .
SPACED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
PLAIN = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.full(size, b, _U) for b in (_BASE, inverse))
            for a in (self.up, self.down):
                a[0] = 1
                np.cumprod(a, out=a)
        return self.up, self.down


_powers = _Powers()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes (or one row): first, last, bytes, offsets."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Spans:
    """Byte spans in a piece, and where each row's spans begin."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # offsets into starts, one more than rows

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.row)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), self.count)


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Spans:
    """Maximal runs of bytes in ``table``; runs end with their row."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return Spans(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Lines split at newlines, as ``text.split(chr(10))`` gives them."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return Spans(starts, ends, np.concatenate([[0], np.cumsum(per)]))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers.get(len(data) + 1)
    out = np.empty(len(data) + 1, _U)
    out[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for the same bytes wherever they are.

    A polynomial modulo 2^64 cannot tell some spans of a kilobyte apart, whatever its base, so
    those from ``LONG`` bytes on, of which there are few, are hashed by XXH64.
    """
    _, down = _powers.get(len(sums))
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9FB21C651E98DF25))
    long, view = np.flatnonzero(ends - starts >= LONG), memoryview(np.ascontiguousarray(data))
    if len(long):
        out[long] = [xxhash.xxh64_intdigest(view[i:j], 42) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (rows not regarded)."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, _U)
    for k in range(width):
        out *= _U(_BASE)
        out += words[k : k + n]
    return mix(out)


def window_rows(spans: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each whole window inside a row, and its row."""
    per = np.maximum(spans.count - width + 1, 0)
    rows = np.repeat(np.arange(len(per)), per)
    begin = np.repeat(spans.row[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    return np.arange(len(rows)) + begin, rows


def covered(n: int, starts: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Which of n words lie in one of the windows."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def row_sums(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sums of the values of each row."""
    if values.dtype == bool:
        values = values.astype(np.int64)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[row[1:]] - total[row[:-1]]


def one_text(documents: DataFrame, chosen: DataFrame, more: list[str]) -> DataFrame:
    """doc_id, ``more`` and one text (the least) of each of the chosen doc_ids, a bounded number."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *more).agg(F.min("text").alias("text"))
