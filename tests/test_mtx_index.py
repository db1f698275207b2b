import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.schema import SchemaError
from cellweft.sources import mtx, mtx_index


def write(path, rows, shape, extra=()):
    body = [" ".join(map(str, r)) for r in rows]
    for place, line in extra:
        body.insert(place, line)
    path.write_text("%%MatrixMarket matrix coordinate real general\n% made here\n\n" + f"{shape[0]}  {shape[1]} {len(rows)}\n" + "\n".join(body) + ("\n" if body else ""))
    return str(path)


def triples(df):
    return sorted((r.row_idx, r.col_idx, r.value) for r in df.collect())


def made(seed=1, n=3000, rows=400):
    rng = np.random.default_rng(seed)
    return sorted({(int(a), int(b)): round(float(v), 3) for a, b, v in zip(rng.integers(1, rows + 1, n), rng.integers(1, 90, n), rng.random(n) * 9, strict=True)}.items())


@pytest.mark.parametrize("span", [7, 64, 1000, 1 << 20])
def test_reads_what_the_plain_scan_reads(spark, tmp_path, span):
    rows = [(a, b, v) for (a, b), v in made(n=300)]
    path = write(tmp_path / "m.mtx", rows, (400, 90), [(5, ""), (40, "% a comment"), (200, "  ")])
    folder = mtx_index.index(spark, path, str(tmp_path / "index"), span)
    assert triples(mtx_index.read(spark, path, folder)) == sorted((a - 1, b - 1, v) for a, b, v in rows) == triples(mtx.read(spark, path))


def test_filters_skip_spans(spark, tmp_path):
    rows = [(a, b, v) for (a, b), v in made()]
    path = write(tmp_path / "m.mtx", rows, (400, 90))
    folder = mtx_index.index(spark, path, span=512)
    got = mtx_index.read(spark, path, folder)
    for asked, want in (
        (F.col("row_idx") == 7, lambda r: r == 7),
        ((F.col("row_idx") > 100) & (F.col("row_idx") <= 120), lambda r: 100 < r <= 120),
        (F.col("row_idx").isin(3, 200, 399, 5000), lambda r: r in (3, 200, 399)),
        ((F.col("row_idx") >= 390) & (F.col("col_idx") < 5), lambda r: r >= 390),
        (F.col("row_idx") < 0, lambda r: False),
    ):
        want_rows = sorted((a - 1, b - 1, v) for a, b, v in rows if want(a - 1))
        if "col_idx" in str(asked._jc.toString()):
            want_rows = [r for r in want_rows if r[1] < 5]
        assert triples(got.where(asked)) == want_rows
    whole = mtx_index.planned_bytes(folder)
    assert mtx_index.planned_bytes(folder, 7, 7) <= 2 * 512 and mtx_index.planned_bytes(folder, some=[3, 399]) <= 4 * 512 < whole / 10
    # the reader plans by the filters that Spark gives it
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    def planned(*filters):
        reader = mtx_index.Reader(path, folder)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sum(e - b for p in reader.partitions() for b, e in p.spans)

    assert planned(EqualTo(("row_idx",), 7)) == mtx_index.planned_bytes(folder, 7, 7)
    assert planned(GreaterThan(("row_idx",), 100), LessThan(("row_idx",), 110)) == mtx_index.planned_bytes(folder, 101, 109) < whole / 10
    assert planned(In(("row_idx",), (3, 399, None))) == mtx_index.planned_bytes(folder, some=[3, 399])
    assert planned(EqualTo(("col_idx",), 7)) == whole


def test_unsorted_pattern_and_odd_files(spark, tmp_path):
    rows = [(5, 1), (1, 2), (3, 3), (5, 2), (1, 1)] * 3
    path = write(tmp_path / "p.mtx", rows, (5, 3))
    folder = mtx_index.index(spark, path, span=9)
    assert triples(mtx_index.read(spark, path, folder).where("row_idx = 4")) == sorted((a - 1, b - 1, 1.0) for a, b in rows if a == 5)
    empty = write(tmp_path / "e.mtx", [], (4, 4))
    assert triples(mtx_index.read(spark, empty, mtx_index.index(spark, empty))) == []
    beyond = write(tmp_path / "b.mtx", [(6, 1, 1.0)], (5, 3))
    with pytest.raises(Exception, match="outside the matrix"):
        mtx_index.index(spark, beyond)
    with pytest.raises(SchemaError, match="compressed"):
        mtx_index.index(spark, str(tmp_path / "m.mtx.gz"))
    (tmp_path / "n.mtx").write_text("% nothing\n")
    with pytest.raises(SchemaError, match="size line"):
        mtx_index.index(spark, str(tmp_path / "n.mtx"))


def test_single_files_need_a_mounted_folder(spark, monkeypatch):
    from cellweft import file_queries

    monkeypatch.setattr(file_queries, "scratch", lambda s, name: f"s3://bucket/{name}")
    with pytest.raises(ValueError, match="mounted"):
        file_queries._file(spark, "x")
