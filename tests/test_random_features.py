import numpy as np
import pytest

from cellweft.operators.causal import pc, runner
from cellweft.operators.causal import random_features as R
from cellweft.operators.causal.tests import FisherZ


def in_one_process(x, tests, seed=0):
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    fitted = R.Fitted(R.products(x, tests, seed), tests, R.FEW, R.MANY)
    return R.p_values(fitted, R.residual_products(x, fitted, tests, seed), tests)


def planted(n, pairs, seed, linked):
    """z, and pairs that both follow it by curves; linked ones share a hidden sign besides."""
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 1))
    x = np.tanh(2 * z) + 0.5 * rng.normal(size=(n, pairs))
    y = z**2 + 0.5 * rng.normal(size=(n, pairs))
    if linked:
        y = y + 0.8 * (x - np.tanh(2 * z)) ** 2 / 0.25
    return np.concatenate([z, x, y], axis=1)


def test_level_and_power():
    tests = [(1 + k, 1 + 20 + k, (0,)) for k in range(20)]
    for n in (800, 2000):
        false = np.mean([np.array(in_one_process(planted(n, 20, s, False), tests, s)) < 0.05 for s in range(25)])
        assert abs(false - 0.05) <= 0.02, (n, false)
    power = np.mean([np.array(in_one_process(planted(2000, 20, 90 + s, True), tests, s)) < 0.05 for s in range(5)])
    assert power >= 0.85, power
    # without the condition all of them depend
    assert np.mean(np.array(in_one_process(planted(800, 20, 5, False), [(a, b, ()) for a, b, _ in tests])) < 0.05) >= 0.9


def test_sums_by_spark_equal_one_process(spark, monkeypatch):
    x = planted(700, 3, 1, True)
    names = [f"v{k}" for k in range(x.shape[1])]
    wide = spark.createDataFrame([tuple(map(float, r)) for r in x], names).repartition(5)
    monkeypatch.setattr(R, "TOGETHER", 4)
    monkeypatch.setattr(R, "ROWS", 37)
    tests = sorted([(1, 4, (0,)), (1, 4, ()), (2, 5, (0, 1)), (0, 6, (1, 2, 3)), (3, 4, (0,)), (0, 1, ())], key=lambda t: (len(t[2]), t[2], t))
    got = R.RandomFeatureTest(wide, names)
    got.ahead(tests)
    for t in tests:
        want = in_one_process(x, [t])[0]
        assert got(*t) == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert got(t[1], t[0], t[2][::-1]) == got(*t)
    assert got(2, 3) == pytest.approx(in_one_process(x, [(2, 3, ())])[0], rel=1e-6)


def test_search_finds_what_correlation_cannot(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=900)
    b = a**2 + 0.3 * rng.normal(size=900)
    c = np.cos(2 * b) + 0.3 * rng.normal(size=900)
    x = np.stack([a, b, c, np.ones(900)], axis=1)
    wide = spark.createDataFrame([tuple(map(float, r)) for r in x], ["a", "b", "c", "one"]).cache()
    test = R.RandomFeatureTest(wide, ["a", "b", "c", "one"])
    adj, _ = pc.skeleton(4, test, 0.01)
    assert adj[0, 1] and adj[1, 2] and not adj[0, 2] and not adj[3].any()
    assert not pc.skeleton(3, FisherZ(np.corrcoef(x[:, :3].T), 900), 0.01)[0][0, 1]
    long = spark.createDataFrame([(k, n, float(v)) for k, r in enumerate(x[:300]) for n, v in zip(("a", "b", "c"), r, strict=False)], "row int, variable string, value double")
    edges, said = runner.run(long, runner.Spec(test="rcit", alpha=0.01), columns=["a", "b", "c"])
    assert said["rows"] == 300 and {frozenset((e.node1, e.node2)) for e in edges.collect()} == {frozenset("ab"), frozenset("bc")}


def test_rows_that_do_not_fit_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(runner, "MOST_KERNEL_ROWS", 10)
    long = spark.createDataFrame([(k, n, float(k * 7 % 11 + j * (k % 3))) for k in range(30) for j, n in enumerate("ab")], "row int, variable string, value double")
    with pytest.raises(ValueError, match="more than 10 rows"):
        runner.run(long, runner.Spec(test="kci"), columns=["a", "b"])
    empty = R.RandomFeatureTest(spark.createDataFrame([], "a double, b double"), ["a", "b"])
    assert empty(0, 1) == 1.0
