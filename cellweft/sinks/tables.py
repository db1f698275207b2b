"""TSV, BED, MatrixMarket, GraphML, JSON and Markdown sinks.

Writers of one file order rows in Spark, whose tasks write them as parts below the
shared folder; the parts are then laid end to end, by tasks where the file itself lies
in the shared folder and it is mounted, else by the driver as a copy of bytes.  No row goes
to the driver.  Folder writers leave the files to Spark's committer.
"""

from __future__ import annotations

import gzip
import json
import math
import os
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..functions import intervals
from ..operators.places import numbered
from ..recovery import scratch, shared_dir

#: Bytes that are copied at once.
COPIED = 1 << 22


def _parts(df: DataFrame, line: Callable[[Row], str], compressed: bool) -> tuple[list[tuple[str, int]], int]:
    """Part files (path and bytes) with the line of each row, in the order of ``df``, and the number of rows."""
    spark = df.sparkSession
    folder, seen = scratch(spark, "lines"), Observation()
    lines = spark.createDataFrame(df.rdd.map(lambda row: (line(row),)), "value string", verifySchema=False)
    lines.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "gzip" if compressed else "none").text(folder)
    store, at = fs.FileSystem.from_uri(folder)
    found = [(int(n[1]), f.path, f.size) for f in store.get_file_info(fs.FileSelector(at)) if f.size and (n := re.match(r"part-(\d+)", f.base_name))]
    return [(f"{folder}/{path.rsplit('/', 1)[1]}", size) for _, path, size in sorted(found)], seen.get["n"]


def _copy(part: str, path: str, begin: int) -> None:
    """Lay a part into a file from a byte on."""
    store, at = fs.FileSystem.from_uri(part)
    with store.open_input_stream(at, compression=None) as source, open(path, "r+b") as out:
        out.seek(begin)
        while some := source.read(COPIED):
            out.write(some)


def _write(path: str | Path, *sections: str | tuple[DataFrame, Callable[[Row], str]]) -> int:
    """One file of texts and of lines of rows, one section after the other; returns the number of rows."""
    path, compressed, rows, begin, spark = str(path), str(path).endswith(".gz"), 0, 0, None
    copies: list[tuple[str, str, int]] = []
    with open(path, "wb") as out:
        for section in sections:
            if isinstance(section, str):
                text = section.encode()
                text = gzip.compress(text) if compressed else text
                out.seek(begin)
                out.write(text)
                begin += len(text)
                continue
            spark = section[0].sparkSession
            parts, n = _parts(*section, compressed)
            rows += n
            for part, size in parts:
                copies.append((part, path, begin))
                begin += size
        out.truncate(begin)
    shared = shared_dir(spark).removeprefix("file://") if copies else ""
    if shared.startswith("/") and Path(path).resolve().is_relative_to(Path(shared).resolve()):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in batch.to_pylist():
                    _copy(c["part"], c["path"], c["begin"])
                yield batch.select(["begin"])

        todo = spark.createDataFrame(copies, "part string, path string, begin bigint").repartition(len(copies))  # a row a part
        todo.mapInArrow(run, "begin bigint").count()
    else:
        for c in copies:
            _copy(*c)
    return rows


def _text(x: object) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return str(x)


def write_tsv(df: DataFrame, path: str | Path, order: list[str | Column] | None = None, header: bool = True) -> int:
    """One TSV file with stable columns and order; returns the rows written."""
    df = df.orderBy(*order) if order else df
    return _write(path, "\t".join(df.columns) + "\n" if header else "", (df, lambda row: "\t".join(map(_text, row))))


def write_tsv_folder(df: DataFrame, path: str, compression: str | None = None, header: bool = True) -> None:
    """A folder of TSV parts, written by the executors; blanks stay and empty text is an empty field, as in ``write_tsv``."""
    writer = df.write.options(sep="\t", header=header, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_counts(counts: DataFrame, path: str | Path) -> int:
    return write_tsv(counts.select("barcode", F.col("n").alias("n_fragments")), path, ["barcode"])


def write_fragment_lines(lines: DataFrame, path: str) -> None:
    """Verbatim lines, gzipped."""
    lines.select("value").write.option("compression", "gzip").text(path)


def bed4(df: DataFrame) -> DataFrame:
    return df.select("chrom", "start", "end", "name")


def bed6(df: DataFrame) -> DataFrame:
    strand = F.coalesce(F.col("strand"), F.lit(".")) if "strand" in df.columns else F.lit(".")
    return df.select("chrom", "start", "end", "name", F.lit(0).alias("score"), strand.alias("strand"))


def bins_bed(features: DataFrame) -> DataFrame:
    """BED rows of the feature names that are intervals."""
    got = features.select("feature", intervals.parse(F.col("feature")).alias("at")).where("at is not null")
    return got.select("at.chrom", "at.start", "at.end", F.col("feature").alias("name"))


def index_names(df: DataFrame, name: str) -> DataFrame:
    """(idx, name) with 0-based places in order of name."""
    return numbered(df.select(F.col(name).alias("name")).distinct(), ["name"]).select("idx", "name")


def write_mtx(entries: DataFrame, cells: DataFrame, features: DataFrame, prefix: str | Path) -> tuple[int, int, int]:
    """PREFIX.mtx with PREFIX_barcodes.tsv and PREFIX_features.tsv; entries are (row_idx, col_idx, value)."""
    shape = (cells.count(), features.count(), entries.count())
    whole = entries.where(F.col("value") != F.floor("value")).isEmpty()
    placed = entries.select("row_idx", "col_idx", "value").orderBy("row_idx", "col_idx")
    head = f"%%MatrixMarket matrix coordinate {'integer' if whole else 'real'} general\n%\n{shape[0]} {shape[1]} {shape[2]}\n"
    _write(f"{prefix}.mtx", head, (placed, lambda r: f"{r.row_idx + 1} {r.col_idx + 1} {int(r.value) if whole else r.value}"))
    _names(cells, "barcode", f"{prefix}_barcodes.tsv")
    _names(features, "feature", f"{prefix}_features.tsv")
    return shape


def _names(df: DataFrame, title: str, path: str) -> None:
    _write(path, title + "\n", (df.orderBy("idx"), lambda r: f"{r[1]}"))


def write_wide_matrix(long: DataFrame, path: str | Path, label: str = "feature", sep: str = "\t") -> None:
    """Feature by cell text in the order of col_pos and row_pos; values as they were read.

    The cells are the header, so they are collected; rows are written by tasks.
    """
    cells = [r.barcode for r in long.select("col_pos", "barcode").distinct().orderBy("col_pos").collect()]
    body = long.groupBy("row_pos", "feature").agg(F.array_sort(F.collect_list(F.struct("col_pos", "value"))).alias("v"))
    _write(path, sep.join([label, *cells]) + "\n", (body.orderBy("row_pos"), lambda r: sep.join([r.feature, *(x.value for x in r.v)])))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str | Path) -> None:
    """A directed multigraph with all columns as attributes."""

    def keys(df: DataFrame, kind: str, skip: set[str]) -> Iterator[str]:
        for c, t in df.dtypes:
            if c not in skip:
                yield f'<key id="{kind}_{c}" for="{kind}" attr.name={quoteattr(c)} attr.type="{ {"double": "double", "int": "int", "bigint": "long", "boolean": "boolean"}.get(t, "string")}"/>'

    def data(row, kind: str, skip: set[str]) -> str:
        return "".join(f'<data key="{kind}_{c}">{escape(_text(v))}</data>' for c, v in row.asDict().items() if c not in skip and v is not None)

    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    head += "".join(k + "\n" for k in (*keys(nodes, "node", {"node"}), *keys(edges, "edge", {"source", "target"}))) + '<graph edgedefault="directed">\n'
    _write(
        path,
        head,
        (nodes.orderBy("node"), lambda r: f"<node id={quoteattr(r.node)}>{data(r, 'node', {'node'})}</node>"),
        (edges.orderBy(*edges.columns), lambda r: f"<edge source={quoteattr(r.source)} target={quoteattr(r.target)}>{data(r, 'edge', {'source', 'target'})}</edge>"),
        "</graph>\n</graphml>\n",
    )


def write_json(summary: dict, path: str | Path) -> None:
    """A run's summary; numpy scalars and arrays, sets and paths are turned into plain values."""

    def plain(x):
        if hasattr(x, "tolist"):
            return x.tolist()
        if isinstance(x, set):
            return sorted(x)
        return str(x)

    Path(path).write_text(json.dumps(summary, indent=2, sort_keys=True, default=plain) + "\n")


def markdown_table(columns: Iterable[str], rows: Iterable[Iterable]) -> str:
    columns = list(columns)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(f"{x:.4g}" if isinstance(x, float) else _text(x).replace("|", "\\|") for x in row) + " |" for row in rows]
    return "\n".join(lines) + "\n"


def markdown_report(title: str, sections: dict[str, DataFrame], limit: int = 200) -> str:
    """A report of small tables, each cut at ``limit`` rows."""
    parts = [f"# {title}\n"]
    for name, df in sections.items():
        parts.append(f"## {name}\n\n" + markdown_table(df.columns, df.limit(limit).collect()))
    return "\n".join(parts)
