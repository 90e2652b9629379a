"""Maximum-weight assignment of predictions to gold, ties broken by the smallest partners.

Solved per connected component of the overlap graph, on its edges alone.  Dual
prices are lowered row by row until a heaviest assignment is proved; the edges that
cost nothing under these prices carry exactly the heaviest assignments, so the
first partner that a row can have in any of them is found by re-matching along
free edges, without weighing anything again.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

Edges = dict[int, dict[int, int]]


class _Prices:
    """A heaviest matching of ``edges`` (row -> column -> positive weight) with the prices that prove it."""

    def __init__(self, edges: Edges):
        self.edges = edges
        self.row = {i: max(w.values()) for i, w in edges.items()}
        self.col = {j: 0 for w in edges.values() for j in w}
        self.of_row: dict[int, int] = {}
        self.of_col: dict[int, int] = {}
        for i in edges:
            self._serve(i)

    def _serve(self, start: int) -> None:
        """Find a column for a row, or a row on the way whose price is nil and may do without."""
        inside, came = {start}, {}  # rows of the tree; column -> row it is reached from
        gap: dict[int, tuple[int, int]] = {}
        fresh = start
        while True:
            for j, w in self.edges[fresh].items():
                g = self.row[fresh] + self.col[j] - w
                if j not in came and (j not in gap or g < gap[j][0]):
                    gap[j] = (g, fresh)
            idle = min(inside, key=lambda i: (self.row[i], i))
            step, j = min(((g, j) for j, (g, _) in gap.items()), default=(self.row[idle], None))
            if self.row[idle] <= step:
                step, j = self.row[idle], None
            for i in inside:
                self.row[i] -= step
            for c in came:
                self.col[c] += step
            gap = {c: (g - step, i) for c, (g, i) in gap.items()}
            if j is None:  # ``idle`` gives up its column, if it has one
                if idle != start:
                    self._shift(self.of_row.pop(idle), came)
                return
            came[j] = gap.pop(j)[1]
            if j not in self.of_col:
                self._shift(j, came)
                return
            fresh = self.of_col[j]
            inside.add(fresh)

    def _shift(self, j: int | None, came: dict[int, int]) -> None:
        while j is not None:
            i = came[j]
            self.of_col[j], self.of_row[i], j = i, j, self.of_row.get(i)


def _reroute(lost: int, links: dict[int, list[int]], mine: dict[int, int], theirs: dict[int, int], needed: set[int], fixed: set[int]) -> bool:
    """Match ``lost`` again along ``links``; ends at a free partner or at a peer that needn't be matched."""
    came: dict[int, int] = {}
    queue = [lost]
    for at in queue:
        for other in links[at]:
            if other in came or other in fixed:
                continue
            came[other] = at
            peer = theirs.get(other)
            if peer is None or peer not in needed:
                if peer is not None:
                    del mine[peer]
                now: int | None = other
                while now is not None:
                    owner = came[now]
                    theirs[now], mine[owner], now = owner, now, mine.get(owner)
                return True
            queue.append(peer)
    return False


def heaviest(edges: Edges) -> dict[int, int]:
    """row -> column of the heaviest matching whose rows, in order, have the first columns that any heaviest one allows."""
    edges = {i: {j: w for j, w in sorted(ws.items()) if w > 0} for i, ws in sorted(edges.items())}
    edges = {i: ws for i, ws in edges.items() if ws}
    solved = _Prices(edges)
    rows, cols = dict(solved.of_row), dict(solved.of_col)
    ahead = {i: [j for j, w in ws.items() if solved.row[i] + solved.col[j] == w] for i, ws in edges.items()}
    back: dict[int, list[int]] = defaultdict(list)
    for i, js in ahead.items():
        for j in js:
            back[j].append(i)
    must_row, must_col = {i for i, p in solved.row.items() if p}, {j for j, p in solved.col.items() if p}
    done_row: set[int] = set()
    done_col: set[int] = set()
    for i in ahead:
        done_row.add(i)
        for j in ahead[i]:
            if j in done_col:
                continue
            if rows.get(i) == j:
                done_col.add(j)
                break
            r, c = dict(rows), dict(cols)
            old_row, old_col = c.pop(j, None), r.pop(i, None)
            if old_row is not None:
                del r[old_row]
            if old_col is not None:
                del c[old_col]
            r[i], c[j] = j, i
            kept = old_row is None or old_row not in must_row or _reroute(old_row, ahead, r, c, must_row, done_col | {j})
            if kept and old_col is not None and old_col in must_col and old_col not in c:
                kept = _reroute(old_col, back, c, r, must_col, done_row)
            if kept:
                rows, cols = r, c
                done_col.add(j)
                break
    return rows


def assign(weights: list[list[int]]) -> list[int | None]:
    """For each row its column in a heaviest assignment, or None; pairs of weight 0 are left apart."""
    found = heaviest({i: dict(enumerate(row)) for i, row in enumerate(weights)})
    return [found.get(i) for i in range(len(weights))]


def _parts(edges: Edges) -> list[Edges]:
    """Connected components: what doesn't share a partner is solved on its own."""
    up: dict[tuple[str, int], tuple[str, int]] = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, ws in edges.items():
        for j in ws:
            up[root(("c", j))] = root(("r", i))
    parts: dict[tuple[str, int], Edges] = defaultdict(dict)
    for i, ws in edges.items():
        parts[root(("r", i))][i] = ws
    return list(parts.values())


def best(weights: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
    """(gold, predicted) pairs of the best alignment of one scope, by the weights of the pairs that have something in common."""
    gold, pred = sorted({g for g, _ in weights}), sorted({p for _, p in weights})
    at_gold, at_pred = {g: i for i, g in enumerate(gold)}, {p: j for j, p in enumerate(pred)}
    edges: Edges = defaultdict(dict)
    for (g, p), w in weights.items():
        edges[at_gold[g]][at_pred[p]] = int(w)
    return [(gold[i], pred[j]) for part in _parts(edges) for i, j in heaviest(part).items()]


def align(overlaps: DataFrame) -> DataFrame:
    """(scope, gold, predicted, weight) of each scope's best alignment; overlaps has the pairs with common bindings."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = {(g, p): int(w) for g, p, w in zip(pdf["gold"], pdf["predicted"], pdf["weight"], strict=True)}
        scope = pdf["scope"].iloc[0]
        return pd.DataFrame([(scope, g, p, weights[g, p]) for g, p in best(weights)], columns=["scope", "gold", "predicted", "weight"])

    return overlaps.groupBy("scope").applyInPandas(one, "scope string, gold string, predicted string, weight long")
