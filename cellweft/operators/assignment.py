"""Optimal one-to-one matching of anchors with cells of each mark."""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..recovery import keep
from ..schema import SchemaError
from .neighbours import knn

#: Anchors times candidates that the first search may give, and up to which candidates are doubled by new searches.
MOST_CANDIDATES, DOUBLED = 4_000_000, 200_000
#: Candidates that one task holds, and those of a row that it looks at in one go.
HELD, LOOK = 50_000_000, 8


def solve(cost: np.ndarray) -> np.ndarray:
    """Column of each row at least total cost (rows at most columns), by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of, col_of = np.full(m, -1), np.full(n, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        came = np.full(m, -1)
        done = np.zeros(m, bool)
        row, path, end = start, 0.0, -1
        while end < 0:
            slack = path + cost[row] - row_price[row] - col_price
            better = ~done & (slack < reach)
            reach[better], came[better] = slack[better], row
            open_ = np.where(done, np.inf, reach)
            col = int(open_.argmin())
            path = open_[col]
            done[col] = True
            if row_of[col] < 0:
                end = col
            else:
                row = row_of[col]
        settled = done & (reach < np.inf)
        settled[end] = False
        row_price[start] += path
        inner = np.flatnonzero(settled)
        row_price[row_of[inner]] += path - reach[inner]
        col_price[inner] -= path - reach[inner]
        col = end
        while col >= 0:
            row = came[col]
            row_of[col], col_of[row], col = row, col, col_of[row]
            if row == start:
                break
    return col_of


def solve_sparse(starts: np.ndarray, cols: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Column of each row at least total cost, and the rows' prices, where row i may take ``cols[starts[i]:starts[i + 1]]`` (cheapest first); None if not all rows can have one.

    Shortest augmenting paths over a heap: a path visits the candidates that it passes, not all.  A column that no
    row holds has price zero and others less, so a column that is not listed for row i is no better for it if it costs the row's price or more.
    """
    n = len(starts) - 1
    price, row_of = dict.fromkeys(cols.tolist(), 0.0), {}
    rows = [list(zip(cols[i:j].tolist(), costs[i:j].tolist(), strict=True)) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    own, at = np.full(n, -1), [r[0][1] if r else 0.0 for r in rows]
    for start in range(n):
        reach: dict[int, float] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, path, end = start, 0.0, -1
        while end < 0:
            base = path - at[row]
            for col, cost in rows[row]:
                far = base + cost - price[col]
                if col not in done and far < reach.get(col, np.inf):
                    reach[col], came[col] = far, row
                    heappush(heap, (far, col))
            while heap and (heap[0][1] in done or heap[0][0] > reach[heap[0][1]]):
                heappop(heap)
            if not heap:
                return None
            path, col = heappop(heap)
            done.add(col)
            if col in row_of:
                row = row_of[col]
            else:
                end = col
        at[start] += path
        for col in done - {end}:
            at[row_of[col]] += path - reach[col]
            price[col] -= path - reach[col]
        col = end
        while True:
            row = came[col]
            row_of[col], own[row], col = row, col, int(own[row])
            if row == start:
                break
    return own, np.array(at)


def solve_points(x: np.ndarray, y: np.ndarray, k: int = 16, held: int = HELD) -> tuple[np.ndarray, float]:
    """Row of ``y`` for each row of ``x`` at least total distance (rows of x at most those of y), and what the prices prove to be the least.

    Each row has a list of its nearest, cheapest first, that is made anew at twice the length where a path comes to its end; so
    no matrix is made, and the answer is that of all pairs.  When the lists have more than ``held`` numbers in all they begin
    again from ``k``.  At first free rows bid for their best, up to what the second best leaves them, which keeps prices of
    columns that nobody holds at zero; those left go by shortest augmenting paths, as in ``solve_sparse``.
    """
    n, m = len(x), len(y)
    if n > m:
        raise ValueError("more rows than columns")
    middle, k = y.mean(axis=0) if m else 0.0, max(1, min(k, m))
    a, b = x - middle, y - middle
    aa, bb = (a**2).sum(axis=1), (b**2).sum(axis=1)

    def nearest(i: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        d = aa[i] + bb - 2 * (b @ a[i])
        near = np.flatnonzero(d <= 1e-5 * (aa[i] + bb))
        d[near] = ((b[near] - a[i]) ** 2).sum(axis=1)
        d = np.sqrt(d)
        among = np.flatnonzero(d <= np.partition(d, size - 1)[size - 1])
        # ties by place, so a longer list begins with the shorter one
        order = among[np.argsort(d[among], kind="stable")][:size]
        return order.astype(np.int32), d[order]

    lists, total = [nearest(i, k) for i in range(n)], n * k

    def seen(i: int, p: int) -> tuple[list, list, bool]:
        """Columns and costs of the row from the p-th on, and whether more follow."""
        nonlocal total
        if p + LOOK >= len(lists[i][0]) < m:
            size = min(m, 2 * (p + LOOK))
            total += size - len(lists[i][0])
            lists[i] = nearest(i, size)
            if total > held:
                for r, (c, d) in enumerate(lists):
                    if r != i and len(c) > k:
                        lists[r] = c[:k].copy(), d[:k].copy()
                total = size + (n - 1) * k
        c, d = lists[i]
        return c[p : p + LOOK].tolist(), d[p : p + LOOK].tolist(), p + LOOK < len(c)

    def best_two(i: int) -> tuple[float, int, float]:
        first, col, second, p = np.inf, -1, np.inf, 0
        while True:
            cols, costs, goes_on = seen(i, p)
            for c, cost in zip(cols, costs, strict=True):
                # prices are never above zero, so those that follow are no better
                if cost >= second:
                    return first, col, second
                worth = cost - price[c]
                if worth < first:
                    first, col, second = worth, c, first
                elif worth < second:
                    second = worth
            if not goes_on:
                return first, col, first if second == np.inf else second
            p += LOOK

    price, row_of, own, at = [0.0] * m, [-1] * m, [-1] * n, [0.0] * n
    free, left, bids = deque(range(n)), [], 0
    while free:
        i = free.popleft()
        if bids == 10 * n:
            left.append(i)
            continue
        bids += 1
        first, col, second = best_two(i)
        before = row_of[col]
        if before >= 0 and second <= first:
            left.append(i)
            continue
        at[i], row_of[col], own[i] = second, i, col
        price[col] -= second - first
        if before >= 0:
            own[before] = -1
            free.append(before)
    for start in left:
        at[start] = best_two(start)[0]
        reach: dict[int, float] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        bases, heap, least = {start: -at[start]}, [(0.0, -1 - start, 0)], np.inf
        while True:
            far, col, p = heappop(heap)
            if col < 0:
                row = -1 - col
            elif col in done or far > reach[col]:
                continue
            else:
                done.add(col)
                row = row_of[col]
                if row < 0:
                    break
                bases[row] = far - at[row]
            base = bases[row]
            cols, costs, goes_on = seen(row, p)
            for c, cost in zip(cols, costs, strict=True):
                if base + cost >= least:
                    break
                then = base + cost - price[c]
                if then < least and then < reach.get(c, np.inf) and c not in done:
                    reach[c], came[c] = then, row
                    heappush(heap, (then, c, 0))
                    if row_of[c] < 0:
                        least = then
            else:
                # what follows costs at least as much as the last one
                if goes_on and base + costs[-1] < least:
                    heappush(heap, (base + costs[-1], -1 - row, p + LOOK))
        at[start] += far
        for c in done - {col}:
            at[row_of[c]] += far - reach[c]
            price[c] -= far - reach[c]
        while True:
            row = came[col]
            row_of[col], own[row], col = row, col, own[row]
            if row == start:
                break
    return np.array(own, int), float(sum(at) + sum(price))


def match(anchors: DataFrame, cells: DataFrame, mark: str = "mark", k: int = 16, most: int = MOST_CANDIDATES) -> DataFrame:
    """sample_id, mark, matched_cell, match_distance: each mark alone, least total Euclidean distance.

    ``anchors`` is (sample_id, id, emb), ``cells`` (mark, id, emb).  Distances are found by the neighbour
    search, which leaves each anchor its ``k`` nearest cells of a mark; the assignment is solved over these alone,
    by one task a mark.  It is the best of all cells if no anchor's price is beyond its farthest candidate, as prices of
    cells are never above zero; else the mark's candidates are doubled, at most to the number of anchors, which always
    is enough.  Beyond ``DOUBLED`` candidates a mark that is still open is solved over its points, each anchor's
    candidates growing as paths ask for them (``solve_points``): its task holds vectors and ``HELD`` candidates, no matrix.
    More than ``most`` candidates in the first search are an error.
    """
    points = anchors.select(F.col("sample_id").alias("id"), "emb").where("emb is not null")
    n = points.count()
    sizes = {r[0]: r[1] for r in cells.where("emb is not null").groupBy(F.col(mark).cast("string")).count().collect()}
    few = [m for m, size in sizes.items() if size < n]
    if few:
        raise SchemaError("fewer cells than anchors in " + ", ".join(map(str, few)))
    kind = cells.schema["id"].dataType.simpleString()
    schema = f"sample_id string, mark string, matched_cell {kind}, match_distance double, settled boolean"

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["query", "distance", "neighbour"], kind="stable")
        names, row = np.unique(df["query"].to_numpy(), return_inverse=True)
        ids, col = np.unique(df["neighbour"].to_numpy(), return_inverse=True)
        starts = np.searchsorted(row, np.arange(len(names) + 1))
        cost = df["distance"].to_numpy()
        found = solve_sparse(starts, col, cost)
        if found is None:
            return pd.DataFrame({"sample_id": names[:1], "mark": key[0], "matched_cell": ids[:1], "match_distance": np.nan, "settled": False})
        own, price = found
        pair = {(r, c): d for r, c, d in zip(row.tolist(), col.tolist(), cost.tolist(), strict=True)}
        whole = np.diff(starts) >= min(n, sizes[key[0]])
        settled = bool((whole | (price <= cost[starts[1:] - 1] + 1e-9)).all())
        return pd.DataFrame({"sample_id": names, "mark": key[0], "matched_cell": ids[own], "match_distance": [pair[i, c] for i, c in enumerate(own.tolist())], "settled": settled})

    open_, done = cells.select(F.col(mark).cast("string").alias("mark"), "id", "emb"), None
    k = min(k, max(n, 1))
    if n * k > most:
        raise SchemaError(f"{n} anchors with {k} candidates each are more than {most}: choose fewer pairs")
    while True:
        near = knn(points, open_, k, group="mark").select("query", "neighbour", "distance", "mark")
        got = keep(near.groupBy("mark").applyInPandas(run, schema), "assignment")
        settled = got.where("settled").drop("settled")
        done = settled if done is None else done.union(settled)
        left = [r[0] for r in got.where("not settled").select("mark").distinct().collect()]
        if not left:
            return done
        open_, k = open_.where(F.col("mark").isin(left)), min(2 * k, n)
        if n * k > DOUBLED:
            return done.union(_over_points(points, open_, left, schema).drop("settled"))


def _over_points(points: DataFrame, cells: DataFrame, marks: list[str], schema: str) -> DataFrame:
    """The matches of whole marks, a task each that has the anchors' vectors and the mark's."""

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        asked, found = asked.sort_by("id"), found.sort_by("id")
        x, y = (np.array(t.column("emb").combine_chunks().flatten()).reshape(len(t), -1) for t in (asked, found))
        own, _ = solve_points(x, y)
        distance = np.sqrt(((x - y[own]) ** 2).sum(axis=1))
        return pa.table({"sample_id": asked.column("id"), "mark": asked.column("mark"), "matched_cell": found.column("id").take(pa.array(own)), "match_distance": distance, "settled": pa.array([True] * len(own))})

    vectors = F.col("emb").cast("array<double>").alias("emb")
    each = points.select("id", vectors, F.explode(F.array(*map(F.lit, marks))).alias("mark"))
    mine = cells.where("emb is not null").select("id", vectors, "mark")
    return keep(each.groupBy("mark").cogroup(mine.groupBy("mark")).applyInArrow(run, schema), "assignment")


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy("mark").agg(F.count("*").alias("n"), F.avg("match_distance").alias("mean_distance"), F.median("match_distance").alias("median_distance"), F.max("match_distance").alias("max_distance"))


def row_distances(matches: DataFrame) -> DataFrame:
    """Mean and largest match distance of each sample."""
    return matches.groupBy("sample_id").agg(F.avg("match_distance").alias("mean_match_distance"), F.max("match_distance").alias("max_match_distance"))


def wide_matches(matches: DataFrame, marks: list[str]) -> DataFrame:
    """cell_MARK and distance_MARK of each sample."""
    cols = [F.max(F.when(F.col("mark") == m, F.col(c))).alias(f"{p}_{m}") for m in marks for p, c in (("cell", "matched_cell"), ("distance", "match_distance"))]
    return matches.groupBy("sample_id").agg(*cols).join(row_distances(matches), "sample_id")
