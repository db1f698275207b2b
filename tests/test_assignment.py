import numpy as np
import pytest

from cellweft.operators import assignment
from cellweft.schema import SchemaError


def frames(spark, x, marks):
    anchors = spark.createDataFrame([(f"S{i:04d}", i, v.tolist()) for i, v in enumerate(x)], "sample_id string, id bigint, emb array<double>")
    cells = spark.createDataFrame([(m, 10_000 * (k + 1) + i, v.tolist()) for k, (m, y) in enumerate(marks.items()) for i, v in enumerate(y)], "mark string, id bigint, emb array<double>")
    return anchors, cells.repartition(3)


def dense(x, y):
    cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    return cost[np.arange(len(x)), assignment.solve(cost)].sum()


def test_sparse_solver_equals_the_dense_one():
    rng = np.random.default_rng(1)
    for n, m, k in ((1, 1, 1), (5, 9, 9), (40, 60, 60), (60, 60, 60), (50, 200, 50)):
        cost = rng.random((n, m)) if m < 60 else np.round(rng.random((n, m)), 1)  # ties too
        order = np.argsort(cost, axis=1, kind="stable")[:, :k]
        own, price = assignment.solve_sparse(np.arange(0, n * k + 1, k), order.ravel(), np.take_along_axis(cost, order, axis=1).ravel())
        assert len(set(own.tolist())) == n
        total = cost[np.arange(n), own].sum()
        assert total == pytest.approx(cost[np.arange(n), assignment.solve(cost)].sum())
        assert total <= price.sum() + 1e-9
    # two rows that want one column
    assert assignment.solve_sparse(np.array([0, 1, 2]), np.array([3, 3]), np.array([1.0, 2.0])) is None


def test_few_candidates_are_doubled_until_the_best_is_certain(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) * 0.1
    marks = {"even": rng.normal(size=(90, 3)), "crowd": np.concatenate([rng.normal(size=(12, 3)) * 0.1, rng.normal(size=(60, 3)) + 5]), "same": np.ones((40, 3))}
    anchors, cells = frames(spark, x, marks)
    asked = []
    search = assignment.knn
    monkeypatch.setattr(assignment, "knn", lambda q, r, k, **more: asked.append(k) or search(q, r, k, **more))
    got = assignment.match(anchors, cells, k=2).collect()
    for m, y in marks.items():
        own = [r for r in got if r.mark == m]
        assert len({r.sample_id for r in own}) == len({r.matched_cell for r in own}) == 40
        assert sum(r.match_distance for r in own) == pytest.approx(dense(x, y))
        for r in own:
            k = r.matched_cell % 10_000
            assert r.match_distance == pytest.approx(np.linalg.norm(x[int(r.sample_id[1:])] - y[k]))
    assert asked == [2, 4, 8, 16, 32, 40]


def test_odd_inputs(spark):
    rng = np.random.default_rng(3)
    anchors, cells = frames(spark, rng.normal(size=(5, 2)), {"a": rng.normal(size=(5, 2))})
    assert assignment.match(anchors.limit(0), cells).collect() == []
    assert assignment.match(anchors, cells.limit(0)).collect() == []
    with pytest.raises(SchemaError, match="fewer cells"):
        assignment.match(anchors, cells.where("id <> 10000"))
    with pytest.raises(SchemaError, match="choose fewer"):
        assignment.match(anchors, cells, most=4)


def test_points_are_solved_without_a_matrix():
    rng = np.random.default_rng(6)
    for n, m, kind in ((1, 1, 0), (30, 30, 0), (40, 90, 0), (60, 60, 1), (50, 50, 2), (20, 21, 3)):
        x, y = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        if kind == 1:  # ties
            x, y = np.round(x), np.round(y)
        elif kind == 2:  # all want the same few
            y = np.concatenate([y[:10] * 0.1, y[10:] + 9])
        elif kind == 3:
            y[:] = 1.0
        cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        best = cost[np.arange(n), assignment.solve(cost)].sum()
        for held in (10**9, n * 2):
            own, proved = assignment.solve_points(x, y, 2, held)
            assert len(set(own.tolist())) == n
            assert cost[np.arange(n), own].sum() == pytest.approx(best, abs=1e-9) == proved


def test_marks_that_need_more_candidates_than_are_doubled_are_solved_whole(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(assignment, "DOUBLED", 100)
    x = rng.normal(size=(40, 3)) * 0.1
    marks = {"even": rng.normal(size=(40, 3)), "crowd": np.concatenate([rng.normal(size=(12, 3)) * 0.1, rng.normal(size=(60, 3)) + 5]), "near": np.concatenate([x, x + 9])}
    anchors, cells = frames(spark, x, marks)
    got = assignment.match(anchors, cells, k=2, most=100).collect()
    for m, y in marks.items():
        own = [r for r in got if r.mark == m]
        assert len({r.sample_id for r in own}) == len({r.matched_cell for r in own}) == 40
        assert sum(r.match_distance for r in own) == pytest.approx(dense(x, y))
        assert all(r.match_distance == pytest.approx(np.linalg.norm(x[int(r.sample_id[1:])] - y[r.matched_cell % 10_000])) for r in own)
