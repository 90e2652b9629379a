"""Acyclicity classes and widths of a schema hypergraph: relation -> set of roles.

Schemas are small, so these run on the driver over a dictionary; only the
statistics that come from data are DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

Edges = dict[str, frozenset[str]]


def hypergraph(usage: DataFrame) -> DataFrame:
    """(relation, roles) from (relation, role) rows."""
    return usage.groupBy("relation").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def edges_of(rows: DataFrame) -> Edges:
    return {r["relation"]: frozenset(r["roles"]) for r in rows.collect()}


def statistics(usage: DataFrame) -> DataFrame:
    """(relations, roles, rank, degree, intersection): sizes, largest relation, most used role, largest common part."""
    rows = usage.select("relation", "role").distinct()
    rank = rows.groupBy("relation").agg(F.count("*").alias("n")).agg(F.max("n").alias("rank"), F.count("*").alias("relations"))
    degree = rows.groupBy("role").agg(F.count("*").alias("n")).agg(F.max("n").alias("degree"), F.count("*").alias("roles"))
    a, b = rows.alias("a"), rows.alias("b")
    shared = a.join(b, (F.col("a.role") == F.col("b.role")) & (F.col("a.relation") < F.col("b.relation"))).groupBy("a.relation", "b.relation").agg(F.count("*").alias("n"))
    return rank.crossJoin(degree).crossJoin(shared.agg(F.coalesce(F.max("n"), F.lit(0)).alias("intersection")))


def components(usage: DataFrame) -> DataFrame:
    """(role, component): roles that relations connect share the least of their names.

    A round passes each role's least known name through its relations, and then
    the name of that name, so long chains close in few rounds.
    """
    rows = usage.select("relation", "role").distinct()
    now, many = rows.select("role", F.col("role").alias("component")).distinct(), None
    while True:
        least = rows.join(now, "role").groupBy("relation").agg(F.min("component").alias("component"))
        step = rows.join(least, "relation").groupBy("role").agg(F.min("component").alias("component"))
        named = step.select(F.col("role").alias("component"), F.col("component").alias("further"))
        now = cut(step.join(named, "component").select("role", F.col("further").alias("component")))
        left = now.select("component").distinct().count(), now.agg(F.sum(F.crc32(F.col("component")))).first()[0]
        if left == many:
            return now
        many = left


def gyo(edges: Edges) -> Edges:
    """What is left after removing roles of one relation and relations inside others; nothing if alpha-acyclic."""
    left = dict(edges)
    changed = True
    while changed:
        changed = False
        uses: dict[str, list[str]] = {}
        for name, roles in left.items():
            for r in roles:
                uses.setdefault(r, []).append(name)
        for name in sorted(left):
            kept = frozenset(r for r in left[name] if len(uses[r]) > 1)
            if kept != left[name]:
                left[name], changed = kept, True
        for name in sorted(left):
            if not left[name] or any(left[name] <= left[o] and (left[name] != left[o] or o < name) for o in left if o != name):
                del left[name]
                changed = True
    return left


def join_tree(edges: Edges) -> list[tuple[str, str]] | None:
    """A spanning tree in which each role's relations are connected, if there is one (heaviest by common roles)."""
    if gyo(edges):
        return None
    names, inside, tree = sorted(edges), set(), []
    while len(inside) < len(names):
        if not inside:
            inside.add(names[0])
            continue
        pairs = [(-len(edges[a] & edges[b]), a, b) for a in inside for b in names if b not in inside]
        _, a, b = min(pairs)
        tree.append((a, b))
        inside.add(b)
    return tree


def is_beta(edges: Edges) -> bool:
    """Roles whose relations form a chain can go, one by one, until none is left."""
    left = {k: set(v) for k, v in edges.items()}
    while any(left.values()):
        for role in sorted(set().union(*left.values())):
            own = sorted((e for e in left.values() if role in e), key=len)
            if all(a <= b for a, b in zip(own, own[1:], strict=False)):
                for e in own:
                    e.discard(role)
                break
        else:
            return False
    return True


def is_gamma(edges: Edges) -> bool:
    """Roles of one relation, relations of one role, twins of either kind: removed until nothing moves."""
    left = {frozenset(v) for v in edges.values() if v}
    while left:
        roles = sorted(set().union(*left))
        where = {r: frozenset(e for e in left if r in e) for r in roles}
        gone = next((r for r in roles if len(where[r]) == 1), None)
        gone = gone or next((r for i, r in enumerate(roles) if any(where[r] == where[q] for q in roles[:i])), None)
        if gone is not None:
            left = {e - {gone} for e in left} - {frozenset()}
        elif any(len(e) == 1 for e in left):
            left = {e for e in left if len(e) > 1}
        else:
            return False
    return True


def is_berge(edges: Edges) -> bool:
    """The graph of relations and roles has no cycle."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for name, roles in edges.items():
        for r in roles:
            a, b = root("e:" + name), root("r:" + r)
            if a == b:
                return False
            up[a] = b
    return True


def classify(edges: Edges) -> str:
    """The smallest class the schema is in: berge, gamma, beta, alpha or cyclic."""
    if gyo(edges):
        return "cyclic"
    tests: list[tuple[str, Callable[[Edges], bool]]] = [("alpha", is_beta), ("beta", is_gamma), ("gamma", is_berge)]
    for name, narrower in tests:
        if not narrower(edges):
            return name
    return "berge"


# ------------------------------------------------------------------- widths


def cover(bag: frozenset[str], edges: Iterable[frozenset[str]]) -> int:
    """Fewest relations that cover a bag of roles."""
    useful = sorted({e & bag for e in edges if e & bag}, key=len, reverse=True)
    for n in range(0, len(bag) + 1):
        if any(frozenset().union(*chosen) >= bag for chosen in combinations(useful, n)):
            return n
    raise ValueError("a role is in no relation")


def fractional_cover(bag: frozenset[str], edges: Iterable[frozenset[str]]) -> Fraction:
    """The cover's exact linear relaxation, by its dual: the most weight on roles with at most 1 per relation."""
    sets = sorted({e & bag for e in edges if e & bag}, key=sorted)
    roles = sorted(bag)
    m, n = len(sets), len(roles)
    rows = [[Fraction(r in s) for r in roles] + [Fraction(i == j) for j in range(m)] + [Fraction(1)] for i, s in enumerate(sets)]
    goal = [Fraction(-1)] * n + [Fraction(0)] * (m + 1)
    basis = list(range(n, n + m))
    while (enter := next((j for j, g in enumerate(goal[:-1]) if g < 0), None)) is not None:
        ratios = [(row[-1] / row[enter], basis[i], i) for i, row in enumerate(rows) if row[enter] > 0]
        if not ratios:
            raise ValueError("a role is in no relation")
        _, _, i = min(ratios)
        rows[i] = [x / rows[i][enter] for x in rows[i]]
        for k, row in enumerate(rows):
            if k != i and row[enter]:
                rows[k] = [x - row[enter] * y for x, y in zip(row, rows[i], strict=True)]
        goal = [x - goal[enter] * y for x, y in zip(goal, rows[i], strict=True)]
        basis[i] = enter
    return goal[-1]


def widths(edges: Edges, most: int = 16) -> dict[str, Fraction | int]:
    """Exact treewidth, generalised and fractional hypertree width, by dynamic programming over role subsets."""
    roles = sorted(set().union(*edges.values())) if edges else []
    if len(roles) > most:
        raise ValueError(f"exact widths are for up to {most} roles")
    sets = list(edges.values())
    near = {r: set().union(*(e for e in sets if r in e)) - {r} for r in roles}

    def bag(gone: frozenset[str], role: str) -> frozenset[str]:
        """The role with all that it reaches through eliminated ones."""
        seen, stack, out = {role}, [role], {role}
        while stack:
            for q in near[stack.pop()]:
                if q not in seen:
                    seen.add(q)
                    if q in gone:
                        stack.append(q)
                    else:
                        out.add(q)
        return frozenset(out)

    def best(measure: Callable[[frozenset[str]], Fraction | int]):
        measure = lru_cache(None)(measure)

        @lru_cache(None)
        def least(gone: frozenset[str]):
            if not gone:
                return 0
            return min(max(least(gone - {r}), measure(bag(gone - {r}, r))) for r in gone)

        return least(frozenset(roles))

    return {"tw": best(len) - 1, "ghw": best(lambda b: cover(b, sets)), "fhw": best(lambda b: fractional_cover(b, sets))}
