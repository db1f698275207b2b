"""Places, stored tables, dense arrays and q-values against plain versions."""

from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellweft.operators import latent, matrix, peaks, support, transforms
from cellweft.operators.places import numbered, numbered_within, weighed


def test_numbered_over_many_partitions(spark):
    n = 20000
    df = spark.range(n).select(F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("idx"), F.lit("x").alias("part"), F.lit(1).alias("at")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = numbered(df, ["key"], "place", 1).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.place for r in sorted(rows, key=lambda r: r.key)] == list(range(1, n + 1))
    assert rows[0].asDict().keys() == {"key", "idx", "part", "at", "place"}


def test_numbered_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k string")
    assert [(r.k, r.idx) for r in numbered(df, ["k"]).orderBy("idx").collect()] == [(None, 0), ("a", 1), ("b", 2), ("b", 3)]
    assert [(r.k, r.idx) for r in numbered(df, [F.desc("k")]).orderBy("idx").collect()][-1] == (None, 3)
    assert numbered(df.where("false"), ["k"]).collect() == []


def test_dense(spark):
    df = spark.createDataFrame([([(1, 5.0), (3, 7.0)],), ([],), ([(0, 1.0)],)], "e array<struct<idx:int,v:double>>")
    assert [r[0] for r in df.select(latent.dense(F.col("e"), 5, F.lit(0.0))).collect()] == [[0, 5, 0, 7, 0], [0] * 5, [1, 0, 0, 0, 0]]
    twice = spark.createDataFrame([([(1, 5.0), (1, 7.0)],)], "e array<struct<idx:int,v:double>>")
    with pytest.raises(PySparkException, match="two values"):
        twice.select(latent.dense(F.col("e"), 5, F.lit(0.0))).collect()


def test_q_values(spark):
    rng = np.random.default_rng(0)
    p = np.unique(np.round(rng.exponential(1.0, 400), 5))[::-1]
    length = rng.integers(1, 50, len(p))
    raw = p - (np.log10(length.sum()) - np.log10(np.cumsum(length)))
    want = np.maximum(np.maximum.accumulate(raw[::-1])[::-1], 0)
    got = peaks.q_values(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, length)], "p double, length bigint")).orderBy(F.desc("p")).collect()
    assert np.array([r.q for r in got]) == pytest.approx(want)
    assert peaks.q_values(spark.createDataFrame([], "p double, length bigint")).collect() == []


def test_weighed_and_numbered_within(spark):
    rows = [(g, v, n) for n, (g, v) in enumerate([("b", 3), (None, 1), ("a", 2), ("b", 1), (None, 5), ("a", 9)], 1)]
    df = spark.createDataFrame(rows, "g string, v int, n int").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    got = {(r.g, r.v): r.w for r in weighed(df, ["g", "v"], "n", "w").collect()}
    assert [got[r[:2]] for r in order] == np.cumsum([0, *(r[2] for r in order)])[:-1].tolist()
    placed = {(r.g, r.v): r.k for r in numbered_within(df, "g", ["v"], "k").collect()}
    assert placed == {(None, 1): 1, (None, 5): 2, ("a", 2): 1, ("a", 9): 2, ("b", 1): 1, ("b", 3): 2}
    assert weighed(df.where("false"), ["g"], "n", "w").collect() == numbered_within(df.where("false"), "g", ["v"], "k").collect() == []


def test_average_rank_with_a_hot_key_nulls_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["x", "y"]), float(rng.integers(0, 30))) for _ in range(3000)]
    frame = pd.DataFrame(rows, columns=["k", "v"])
    want = Counter((k, v, r) for (k, v), r in zip(rows, frame.groupby("k").v.rank()))
    got = matrix.average_rank(spark.createDataFrame([(str(k), v) for k, v in rows], "k string, v double").repartition(6), "k", "v").collect()
    assert Counter((r.k, r.v, r["rank"]) for r in got) == want
    odd = spark.createDataFrame([(None, 1.0), (None, None), (None, None), ("a", float("nan")), ("a", 2.0)], "k string, v double")
    assert sorted((r.k or "", str(r.v), r["rank"]) for r in matrix.average_rank(odd, "k", "v").collect()) == [("", "1.0", 3.0), ("", "None", 1.5), ("", "None", 1.5), ("a", "2.0", 1.0), ("a", "nan", 2.0)]


def test_normal_quantile(spark):
    p = [1e-300, 1e-12, 1e-6, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.93, 0.99, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").coalesce(1).select(transforms.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-12, abs=1e-15)


def test_permuted_pairs_keep_each_group(spark):
    df = spark.createDataFrame([(f"s{k}", k % 50, "hot" if k % 3 else None) for k in range(900)], "sample_id string, cell int, type string")
    got = support.permuted_pairs(df, "cell", "type", 5)
    assert got.columns == df.columns
    assert Counter((r.type, r.cell) for r in got.collect()) == Counter((r.type, r.cell) for r in df.collect())
    assert {r.sample_id: r.cell for r in got.collect()} != {r.sample_id: r.cell for r in df.collect()}
    assert sorted(map(str, got.collect())) == sorted(map(str, support.permuted_pairs(df, "cell", "type", 5).collect()))


def test_few_large_keys_do_not_gather_rows(spark):
    """Statistics of a key come to its rows, whatever Spark would choose by size."""
    df = spark.range(600).select((F.col("id") % 2).cast("string").alias("variable"), (F.col("id") % 50).cast("double").alias("value")).repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got in (matrix.zscore(df, "variable", "value"), transforms.centre_and_scale(df)):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning(variable" not in plan
            assert got.count() == 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
