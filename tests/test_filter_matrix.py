import numpy as np
import pytest

from cellweft.operators import qc


def expected(rows, min_cells, min_features):
    cells = {f: len({c for c, g, v in rows if g == f and c is not None and v is not None and v > 0}) for f in {r[1] for r in rows}}
    rows = [r for r in rows if r[1] is not None and cells[r[1]] >= min_cells]
    features = {c: len({g for d, g, v in rows if d == c and v is not None and v > 0}) for c in {r[0] for r in rows}}
    return sorted(r for r in rows if r[0] is not None and features[r[0]] >= min_features)


@pytest.mark.parametrize("unique", (True, False))
def test_entries_run_once_and_filters_hold(spark, unique):
    rng = np.random.default_rng(3)
    pairs = {(int(c), int(f)) for c, f in zip(rng.integers(0, 40, 400), rng.integers(0, 25, 400) ** 2 % 25)}
    rows = [(c, f, float(rng.integers(0, 3))) for c, f in sorted(pairs)] + [(None, 1, 2.0), (1, None, 2.0), (None, None, 1.0)]
    if not unique:
        rows += [(c, f, 1.0) for c, f, _ in rows[:30]] + [(77, 1, 1.0), (77, 1, 2.0), (77, 1, 3.0)]
    runs = spark.sparkContext.accumulator(0)
    seen = spark.sparkContext.parallelize(rows, 1).map(lambda r: (runs.add(1), r)[1]).toDF("cell bigint, feature bigint, value double")
    got = qc.filter_matrix(seen, 12, 3, unique=unique)
    assert got.columns == ["cell", "feature", "value"]
    want = expected(rows, 12, 3)
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < len(rows)
    assert runs.value == len(rows)
