import math

import pytest

from cellweft.operators import counting, matrix


@pytest.mark.parametrize("task_entries", (4, 1 << 20))
def test_products_in_many_tasks_with_common_features(spark, task_entries):
    entries = [(c, f"peak_{f}", float(c % 5 + f + 1)) for c in range(60) for f in range(12) if f == 0 or (c + f) % 9 == 0] + [(1, None, 5.0), (2, "unlinked", 1.0)]
    links = [(f"peak_{f}", f"gene_{g}", (-1.0) ** g * (f + g + 1) / 8) for f in range(12) for g in range(f % 3 + 1)] + [(None, "gene_9", 1.0)]
    want = {}
    for c, f, v in entries:
        for x, g, w in links:
            if f is not None and f == x:
                want[c, g] = want.get((c, g), 0) + v * w
    seen = spark.createDataFrame(entries, "cell bigint, feature string, value double")
    got = matrix.gene_scores(seen, spark.createDataFrame(links, "feature string, gene string, weight double"), task_entries)
    assert {(r.cell, r.gene): r.value for r in got.collect()} == pytest.approx({k: v for k, v in want.items() if v})
    # with few entries a task they meet in 40 tasks and more
    assert ("REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()) == (task_entries == 4)


def test_region_scores_are_ready_before_pairs_are_made(spark, monkeypatch):
    """A page's rows look up a finished score by place: no name is compared and no logarithm taken for a pair of cell and region."""
    monkeypatch.setattr(counting, "REGION_PAGE", 5)
    entries = spark.range(30).selectExpr("id as cell", "concat('b', id % 7) as feature", "cast(id + 1 as double) as value")
    pairs = spark.range(14).selectExpr("concat('r', id % 9) as region", "concat('b', id % 7) as feature")
    got = counting.region_scores(entries, pairs, spark.range(20).selectExpr("concat('r', id) as region"), entries.select("cell"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")].lower()
    assert "log1p" not in above and "element_at(scores" in above
    on = {}
    for k in range(14):
        on.setdefault(f"r{k % 9}", []).append(f"b{k % 7}")
    rows = {(r.cell, r.region): r.score for r in got.collect()}
    assert len(rows) == 600
    for (c, r), score in rows.items():
        hits = on.get(r, []).count(f"b{c % 7}")
        assert score == (pytest.approx(math.log1p(hits * (c + 1) / len(on[r]) * 1e4 / (c + 1))) if r in on else None)
