"""MatrixMarket files as a planned source: a byte index of row spans, and filters on rows that skip spans.

``index`` reads a file once, in parallel: each task takes spans of bytes, whose lines are those that
begin in it, and says which rows they hold.  The index is a small table beside other scratch tables
and may be kept.  ``read`` plans one task for about ``TASK`` bytes of the spans that filters on
``row_idx`` (comparisons, equality, membership) leave; a span is skipped if its rows cannot match.  Files sorted
by row, as this library and most tools write them, so cost what the rows asked for take; any order is
right.  Filters are still applied to what is read.  ``planned_bytes`` says what a filter will read.

Defined cases: comments and blank lines are skipped wherever they are, values of pattern matrices are
one, a file without entries gives no row, an index outside the declared size is an error, compressed
files cannot be entered in the middle and are an error (``mtx.read`` takes them).  Tasks open the file
through an Arrow file system.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as dataset
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..recovery import scratch
from ..schema import SchemaError

SPAN = 1 << 20
TASK = 32 << 20
FORMAT = "matrixmarket_rows"
SCHEMA = "row_idx bigint, col_idx bigint, value double"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(f"file:{path}")


def _header(path: str) -> tuple[int, tuple[int, int, int], int]:
    """Where entries begin, the declared size, and the bytes of the file."""
    if path.endswith((".gz", ".bz2", ".zst")):
        raise SchemaError(f"{path} is compressed and cannot be read in spans")
    store, at = _open(path)
    with store.open_input_file(at) as source:
        place, whole = 0, source.size()
        held = b""
        while True:
            line, found, rest = held.partition(b"\n")
            if not found and place + len(held) < whole:
                held += source.read_at(1 << 16, place + len(held))
                continue
            place += len(line) + len(found)
            parts = line.split()
            if parts and not line.startswith(b"%"):
                if len(parts) != 3:
                    raise SchemaError(f"{path} has no size line")
                return place, (int(parts[0]), int(parts[1]), int(parts[2])), whole
            if place >= whole:
                raise SchemaError(f"{path} has no size line")
            held = rest


def _entries(path: str, begin: int, end: int, first: int, size: tuple[int, int, int]) -> np.ndarray:
    """Rows, columns (from 0) and values of the lines that begin in a span of bytes; ``first`` is where entries begin."""
    store, at = _open(path)
    begin = max(begin, first)
    with store.open_input_file(at) as source:
        whole = source.size()
        if begin >= min(end, whole):
            return np.zeros((0, 3))
        # from the byte before on, to see whether a line begins with the span
        data = source.read_at(end - begin + (begin > first), begin - (begin > first))
        tail = begin - (begin > first) + len(data)
        while tail < whole and not data.endswith(b"\n"):
            more = source.read_at(1 << 12, tail)
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
            tail += len(more)
    if begin > first:
        data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
    if b"%" in data:
        data = b"\n".join(x for x in data.split(b"\n") if not x.lstrip().startswith(b"%"))
    lines = data.strip()
    if not lines:
        return np.zeros((0, 3))
    width = len(lines.split(b"\n", 1)[0].split())
    got = np.array(lines.split(), dtype="S").astype(float).reshape(-1, width)
    out = np.ones((len(got), 3))
    out[:, : min(width, 3)] = got[:, :3]
    out[:, :2] -= 1
    if len(out) and ((out[:, :2] < 0).any() or out[:, 0].max() >= size[0] or out[:, 1].max() >= size[1]):
        raise SchemaError(f"{path}: an index is outside the matrix")
    return out


def index(spark: SparkSession, path: str, folder: str | None = None, span: int = SPAN) -> str:
    """Write the index of a file and return its folder."""
    first, size, whole = _header(path)
    folder = folder or scratch(spark, "mtx-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column("id").to_pylist():
                got = _entries(path, k * span, (k + 1) * span, first, size)
                if len(got):
                    rows.append((k * span, (k + 1) * span, int(got[:, 0].min()), int(got[:, 0].max()), len(got)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["begin", "end", "least", "most", "n"])

    spark.range(-(-whole // span)).mapInArrow(run, "begin bigint, end bigint, least bigint, most bigint, n bigint").write.mode("overwrite").parquet(folder)
    return folder


@dataclass
class Rows:
    """Which rows filters leave."""

    low: float = -np.inf
    high: float = np.inf
    some: tuple[int, ...] | None = None

    def add(self, f: Filter) -> None:
        if tuple(getattr(f, "attribute", ())) != ("row_idx",):
            return
        if isinstance(f, In):
            self.some = tuple(sorted(x for x in f.value if x is not None and (self.some is None or x in self.some)))
        elif getattr(f, "value", None) is None:
            return
        elif isinstance(f, EqualTo | EqualNullSafe):
            self.low, self.high = max(self.low, f.value), min(self.high, f.value)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.high = min(self.high, f.value - isinstance(f, LessThan))

    def spans(self, folder: str) -> np.ndarray:
        """(begin, end) of the spans that may hold such rows, in order."""
        store, at = _open(folder)
        table = dataset.dataset(at, filesystem=store, format="parquet").to_table(columns=["begin", "end", "least", "most"])
        begin, end, least, most = (table.column(c).to_numpy() for c in ("begin", "end", "least", "most"))
        fits = (most >= self.low) & (least <= self.high)
        if self.some is not None:
            some = np.array(self.some, np.int64)
            fits &= np.searchsorted(some, most, "right") > np.searchsorted(some, least, "left")
        order = np.argsort(begin[fits])
        return np.stack([begin[fits][order], end[fits][order]], axis=1) if fits.any() else np.zeros((0, 2), np.int64)


class Spans(InputPartition):
    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans = spans


class Reader(DataSourceReader):
    def __init__(self, path: str, folder: str) -> None:
        self.path, self.folder, self.rows = path, folder, Rows()
        self.first, self.size, self.whole = _header(path)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.rows.add(f)
            yield f  # spans hold other rows, too

    def partitions(self) -> Sequence[InputPartition]:
        out: list[list[tuple[int, int]]] = []
        held = TASK
        for begin, end in self.rows.spans(self.folder).tolist():
            if held >= TASK:
                out.append([])
                held = 0
            out[-1].append((begin, end))
            held += end - begin
        return [Spans(s) for s in out] or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        for begin, end in partition.spans:
            got = _entries(self.path, begin, end, self.first, self.size)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].astype(np.int64)), pa.array(got[:, 1].astype(np.int64)), pa.array(got[:, 2])], names=["row_idx", "col_idx", "value"])


class MatrixMarketRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options["index"])


def read(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """row_idx, col_idx (from 0) and value, by the index in ``folder``.  Turns the session's filter push-down to Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixMarketRows)
    return spark.read.format(FORMAT).option("index", folder).load(path)


def planned_bytes(folder: str, low: float = -np.inf, high: float = np.inf, some: Sequence[int] | None = None) -> int:
    """Bytes that a read of these rows takes."""
    spans = Rows(low, high, None if some is None else tuple(sorted(some))).spans(folder)
    return int((spans[:, 1] - spans[:, 0]).sum())
