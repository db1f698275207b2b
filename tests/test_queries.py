"""Every query with an oracle against DuckDB, on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

from cellweft import file_queries, operator_queries  # noqa: F401 - they register their queries
from cellweft import queries as Q

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SMALL)
    rows = got.collect()
    if name not in Q.ORACLES:
        assert isinstance(rows, list)
        return
    duck.execute(Q.ORACLES[name])
    names = [c[0] for c in duck.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(map(plain, r)) for r in duck.fetchall())
