"""PC and FCI over an independence test.

The skeleton's levels are stable: all tests of a depth use the graph before it,
so they may run in any order, on the driver or in parallel over executors.  A test
that has ``ahead`` is given all tests of a depth at once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np

Test = Callable[[int, int, tuple[int, ...]], float]
TAIL, ARROW, CIRCLE = "TAIL", "ARROW", "CIRCLE"


def skeleton(d: int, test: Test, alpha: float = 0.05, max_depth: int = -1, forbidden: set[tuple[int, int]] = frozenset(), stable: bool = True) -> tuple[np.ndarray, dict[tuple[int, int], set[int]]]:
    """Adjacency and separating sets; pairs forbidden both ways are no edges; a negative depth has no limit."""
    adj = ~np.eye(d, dtype=bool)
    seps: dict[tuple[int, int], set[int]] = {}
    depth = 0
    while depth <= max_depth or max_depth < 0:
        if adj.sum(1).max(initial=0) - 1 < depth:
            break
        before = adj.copy()
        if stable and hasattr(test, "ahead"):
            test.ahead([(x, y, given) for x in range(d) for y in np.flatnonzero(before[x]).tolist() if not ((x, y) in forbidden and (y, x) in forbidden) for given in combinations([z for z in np.flatnonzero(before[x]).tolist() if z != y], depth)])
        gone: set[tuple[int, int]] = set()
        for x in range(d):
            for y in np.flatnonzero(before[x] if stable else adj[x]).tolist():
                if not stable and not adj[x, y]:
                    continue
                if (x, y) in forbidden and (y, x) in forbidden:
                    gone |= {(x, y), (y, x)}
                    seps.setdefault((min(x, y), max(x, y)), set())
                    if not stable:
                        adj[x, y] = adj[y, x] = False
                    continue
                others = [z for z in np.flatnonzero(before[x] if stable else adj[x]).tolist() if z != y]
                for given in combinations(others, depth):
                    if test(x, y, given) > alpha:
                        gone |= {(x, y), (y, x)}
                        seps.setdefault((min(x, y), max(x, y)), set()).update(given)
                        if not stable:
                            adj[x, y] = adj[y, x] = False
                            break
        for x, y in gone:
            adj[x, y] = False
        depth += 1
    return adj, seps


def _sep(seps: dict, x: int, y: int) -> set[int]:
    return seps.get((min(x, y), max(x, y)), set())


def orient(adj: np.ndarray, seps: dict[tuple[int, int], set[int]], forbidden: set[tuple[int, int]] = frozenset()) -> np.ndarray:
    """Directions: m[x, y] and not m[y, x] is x -> y, both is undirected.

    Background rules come first and stay; of clashing colliders the first holds;
    then Meek's rules as long as they add something.
    """
    m = adj.copy()
    d = len(m)
    for x, y in sorted(forbidden):
        if m[x, y] and m[y, x]:
            m[x, y] = False
    for z in range(d):
        near = np.flatnonzero(adj[z]).tolist()
        for x, y in combinations(near, 2):
            if adj[x, y] or z in _sep(seps, x, y):
                continue
            if m[x, z] and m[y, z]:  # neither edge already points away from z's parents
                m[z, x] = m[z, y] = False
    changed = True
    while changed:
        changed = False
        for x in range(d):
            for y in range(d):
                if not (m[x, y] and m[y, x]) or (x, y) in forbidden:
                    continue
                into = [z for z in range(d) if m[z, x] and not m[x, z] and not adj[z, y]]
                chain = [z for z in range(d) if m[x, z] and not m[z, x] and m[z, y] and not m[y, z]]
                kites = [z for z in range(d) if m[x, z] and m[z, x] and m[z, y] and not m[y, z]]
                third = any(not adj[a, b] for a, b in combinations(kites, 2))
                fourth = any(m[x, z] and m[z, x] and any(m[z, w] and not m[w, z] and m[w, y] and not m[y, w] and adj[x, w] for w in range(d)) and not adj[z, y] for z in range(d))
                if into or chain or third or fourth:
                    m[y, x] = False
                    changed = True
    return m


def pc(d: int, test: Test, alpha: float = 0.05, max_depth: int = -1, forbidden: set[tuple[int, int]] = frozenset(), stable: bool = True) -> list[tuple[int, str, int, str]]:
    """Edges (x, endpoint at x, y, endpoint at y)."""
    adj, seps = skeleton(d, test, alpha, max_depth, forbidden, stable)
    m = orient(adj, seps, forbidden)
    return [(x, ARROW if m[y, x] and not m[x, y] else TAIL, y, ARROW if m[x, y] and not m[y, x] else TAIL) for x in range(d) for y in range(x + 1, d) if m[x, y] or m[y, x]]


def _possible_dsep(x: int, ends: np.ndarray, adj: np.ndarray) -> set[int]:
    """Nodes reachable from x by triples that are colliders or triangles."""
    seen: set[tuple[int, int]] = set()
    work = [(x, int(v)) for v in np.flatnonzero(adj[x])]
    out: set[int] = set()
    while work:
        a, b = work.pop()
        if (a, b) in seen:
            continue
        seen.add((a, b))
        out.add(b)
        for c in np.flatnonzero(adj[b]).tolist():
            if c != a and c != x and (ends[a, b] == 2 and ends[c, b] == 2 or adj[a, c]):
                work.append((b, c))
    return out - {x}


def fci(d: int, test: Test, alpha: float = 0.05, max_depth: int = -1, forbidden: set[tuple[int, int]] = frozenset()) -> list[tuple[int, str, int, str]]:
    """Partial ancestral graph by FCI: skeleton, possible-d-sep, colliders, then rules 1 to 4 and 8 to 10.

    ends[x, y] is the mark at y of edge x - y: 1 circle, 2 arrow, 3 tail.  Selection
    bias rules (5 to 7) are not applied.
    """
    adj, seps = skeleton(d, test, alpha, max_depth, forbidden)

    def colliders() -> np.ndarray:
        ends = np.where(adj, 1, 0)
        for x, y in forbidden:
            if adj[x, y]:
                ends[y, x] = 2  # x is no cause of y, so y's edge ends in an arrow at x
        for z in range(d):
            for x, y in combinations(np.flatnonzero(adj[z]).tolist(), 2):
                if not adj[x, y] and z not in _sep(seps, x, y):
                    ends[x, z] = ends[y, z] = 2
        return ends

    ends = colliders()
    for x in range(d):
        reach = _possible_dsep(x, ends, adj)
        for y in np.flatnonzero(adj[x]).tolist():
            others = sorted(reach - {y})
            most = len(others) if max_depth < 0 else min(max_depth, len(others))
            for k in range(1, most + 1):
                found = next((g for g in combinations(others, k) if test(x, y, g) > alpha), None)
                if found is not None:
                    adj[x, y] = adj[y, x] = False
                    seps[(min(x, y), max(x, y))] = set(found)
                    break
    ends = colliders()
    changed = True
    while changed:
        changed = False

        def put(x: int, y: int, mark: int) -> None:
            nonlocal changed
            if ends[x, y] == 1:
                ends[x, y] = mark
                changed = True

        for b in range(d):
            for a in np.flatnonzero(adj[b]).tolist():
                for c in np.flatnonzero(adj[b]).tolist():
                    if a == c:
                        continue
                    if ends[a, b] == 2 and ends[c, b] == 1 and not adj[a, c]:  # 1
                        put(c, b, 3)
                        put(b, c, 2)
                    if adj[a, c] and ends[a, c] == 1 and (ends[a, b] == 2 and ends[b, a] == 3 and ends[b, c] == 2 or ends[a, b] == 2 and ends[b, c] == 2 and ends[c, b] == 3):  # 2
                        put(a, c, 2)
                    if ends[a, b] == 2 and ends[c, b] == 2 and not adj[a, c]:  # 3
                        for e in np.flatnonzero(adj[b]).tolist():
                            if e not in (a, c) and adj[a, e] and adj[c, e] and ends[a, e] == 1 and ends[c, e] == 1 and ends[e, b] == 1:
                                put(e, b, 2)
                    if adj[a, c] and ends[a, c] == 2 and ends[c, a] == 1 and (ends[a, b] == 2 and ends[b, a] == 3 or ends[a, b] == 1 and ends[b, a] == 3) and ends[b, c] == 2 and ends[c, b] == 3:  # 8
                        put(c, a, 3)
        for a in range(d):  # 9: an uncovered potentially directed path from a to c
            for c in np.flatnonzero(adj[a]).tolist():
                if ends[a, c] == 2 and ends[c, a] == 1:
                    starts = [b for b in np.flatnonzero(adj[a]).tolist() if b != c and not adj[b, c] and ends[b, a] != 2 and ends[a, b] != 3]
                    if any(_uncovered(a, b, c, ends, adj) for b in starts):
                        put(c, a, 3)
        for c in range(d):  # 4: discriminating paths
            for b in np.flatnonzero(adj[c]).tolist():
                if ends[c, b] == 1:
                    _discriminate(b, c, ends, adj, seps, put)
    names = {1: CIRCLE, 2: ARROW, 3: TAIL}
    return [(x, names[ends[y, x]], y, names[ends[x, y]]) for x in range(d) for y in range(x + 1, d) if adj[x, y]]


def _uncovered(a: int, b: int, c: int, ends: np.ndarray, adj: np.ndarray) -> bool:
    """A path a, b, ..., c whose consecutive triples are not triangles and whose edges may point onwards."""
    work = [(a, b, frozenset((a, b)))]
    while work:
        u, v, seen = work.pop()
        for w in np.flatnonzero(adj[v]).tolist():
            if w in seen or adj[u, w] or ends[w, v] == 2 or ends[v, w] == 3:
                continue
            if w == c:
                return True
            if len(seen) < 12:
                work.append((v, w, seen | {w}))
    return False


def _discriminate(b: int, c: int, ends: np.ndarray, adj: np.ndarray, seps: dict, put: Callable[[int, int, int], None]) -> None:
    """Orient b - c at the end of a discriminating path for b."""
    parents = {v for v in np.flatnonzero(adj[:, c]).tolist() if ends[v, c] == 2 and ends[c, v] == 3}
    work = [(b, a, frozenset((a, b))) for a in np.flatnonzero(adj[b]).tolist() if a in parents and ends[b, a] == 2]
    while work:
        prev, a, seen = work.pop()
        for v in np.flatnonzero(adj[a]).tolist():
            if v in seen or v == c or ends[v, a] != 2:
                continue
            if not adj[v, c]:
                if b in _sep(seps, v, c):
                    put(c, b, 3)
                    put(b, c, 2)
                else:
                    put(a, b, 2)
                    put(c, b, 2)
                    put(b, c, 2)
                return
            if v in parents and ends[a, v] == 2:
                work.append((a, v, seen | {v}))
