"""Reads: axis filters, versions at a time, incidence, pattern and key lookups, walks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import holds
from ..storage import cut, sized

AXES = {
    "status": {"candidate", "asserted", "disputed", "superseded", "retracted", "quoted", "goal"},
    "rank": {"preferred", "normal", "deprecated"},
    "visibility": {"visible", "hidden"},
}


@dataclass(frozen=True)
class Where:
    """Axis sets, valid time and transaction time of a read; an empty set passes nothing."""

    status: frozenset[str] = frozenset({"asserted"})
    rank: frozenset[str] = frozenset({"preferred", "normal"})
    visibility: frozenset[str] = frozenset({"visible"})
    as_of: int | None = None
    valid_mode: str = "definite"
    as_at: int | None = None

    def __post_init__(self) -> None:
        for axis, known in AXES.items():
            if odd := set(getattr(self, axis)) - known:
                raise ValueError(f"unknown {axis}: {sorted(odd)}")
        if self.valid_mode not in ("definite", "possible"):
            raise ValueError(f"unknown valid_mode: {self.valid_mode}")

    def apply(self, facts: DataFrame) -> DataFrame:
        """Versions first, then the axes, then validity."""
        rows = at(facts, self.as_at) if "tx_to" in facts.columns else facts
        for axis in AXES:
            allowed = sorted(getattr(self, axis))
            rows = rows.where(F.col(axis).isin(allowed) if allowed else F.lit(False))
        return rows if self.as_of is None else rows.where(holds(self.as_of, self.valid_mode))


def versioned(rows: DataFrame, key: str = "id", order: Sequence[str] = ("version",)) -> DataFrame:
    """Adds tx_to, the moment the next version starts: append-only in place of updates."""
    return rows.withColumn("tx_to", F.lead("tx_from").over(Window.partitionBy(key).orderBy(*order)))


def at(rows: DataFrame, tx: int | None = None) -> DataFrame:
    """The version of each id that was current at a transaction time, or is now."""
    if tx is None:
        return rows.where(F.col("tx_to").isNull())
    return rows.where((F.col("tx_from") <= tx) & (F.col("tx_to").isNull() | (F.col("tx_to") > tx)))


def latest(rows: DataFrame, key: str = "id") -> DataFrame:
    """The highest version of each id, by partial aggregation and without a sort."""
    others = [c for c in rows.columns if c != key]
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("row"))
    return kept.select(key, *(F.col(f"row.{c}").alias(c) for c in others)).select(*rows.columns)


def get_many(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def page(rows: DataFrame, limit: int, after: str | None = None, key: str = "id") -> DataFrame:
    """Keyset pagination in code-point order; ``after`` is exclusive."""
    if limit < 0:
        raise ValueError("limit is negative")
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def incident(facts: DataFrame, bindings: DataFrame, node: str, role: str | None = None, relation: str | None = None) -> DataFrame:
    """Facts that bind a node, each once however often it is bound; literals aren't nodes."""
    hit = (F.col("ident") == node) & F.col("value_kind").isin("entity", "fact")
    if role is not None:
        hit &= F.col("role") == role
    if relation is not None:
        hit &= F.col("relation") == relation
    return facts.join(sized(bindings.where(hit).select(F.col("fact_id").alias("id")).distinct()), "id", "left_semi")


def degree(bindings: DataFrame) -> DataFrame:
    """(ident, degree): how many facts bind each node; stored bindings know which of a fact's is the first."""
    nodes = bindings.where(F.col("value_kind").isin("entity", "fact"))
    many = F.count_if("first") if "first" in bindings.columns else F.count_distinct("fact_id")
    return nodes.groupBy("ident").agg(many.alias("degree"))


def bound_by(bindings: DataFrame, relation: str, role: str, idents: Iterable[str]) -> DataFrame:
    """(ident, ids): for each wanted value the facts that bind it in a role."""
    hit = bindings.where((F.col("relation") == relation) & (F.col("role") == role) & F.col("ident").isin(*idents))
    return hit.groupBy("ident").agg(F.array_sort(F.collect_set("fact_id")).alias("ids"))


def find(bindings: DataFrame, relation: str, pattern: Sequence[tuple[str, str | None]], exact: bool = False, by_fact: DataFrame | None = None) -> DataFrame:
    """(fact_id) of facts whose bindings match the pattern injectively; a value of None matches any.

    A set of (role, value) requirements is met injectively when, for every
    role, each value occurs as often as asked and the wildcards still find
    bindings left over: counts, whatever the pattern's length.  The asked values are
    looked up first, so only the rows with them are read; what has them all is
    checked for wildcards and size by its own bindings (``by_fact``, the same rows
    in the order of facts, if there is such a table).
    """
    rows, every = bindings.where(F.col("relation") == relation), (by_fact if by_fact is not None else bindings).where(F.col("relation") == relation)
    per_role = Counter(r for r, _ in pattern)
    valued = Counter((r, v) for r, v in pattern if v is not None)
    is_ = lambda role, value: (F.col("role") == role) & (F.col("ident") == value)
    met = None
    if valued:
        some = rows.where(reduce(lambda a, b: a | b, (is_(r, v) for r, v in valued)))
        asked = [(F.count_if(is_(r, v)), n) for (r, v), n in valued.items()]
        counted = some.groupBy("fact_id").agg(*(c.alias(f"n{i}") for i, (c, _) in enumerate(asked)))
        met = counted.where(reduce(lambda a, b: a & b, (F.col(f"n{i}") >= n for i, (_, n) in enumerate(asked)))).select("fact_id")
        if not exact and all(v is not None for _, v in pattern):
            return met
    rest = every if met is None else every.join(met, "fact_id", "left_semi")
    if not exact and per_role:
        rest = rest.where(F.col("role").isin(*sorted(per_role)))
    checks = [(F.count_if(F.col("role") == r), n) for r, n in sorted(per_role.items())]
    counted = rest.groupBy("fact_id").agg(F.count("*").alias("all"), *(c.alias(f"n{i}") for i, (c, _) in enumerate(checks)))
    fits = reduce(lambda a, b: a & b, (F.col(f"n{i}") >= n for i, (_, n) in enumerate(checks)), F.lit(True))
    return counted.where(fits & (F.col("all") == len(pattern)) if exact else fits).select("fact_id")


def two_hop(by_value: DataFrame, node: str, by_fact: DataFrame | None = None) -> DataFrame:
    """(ident): other nodes in a fact together with a neighbour of ``node``."""
    by_fact = by_value if by_fact is None else by_fact
    node_rows = F.col("value_kind") == "entity"
    values, facts = by_value.where(node_rows).select("fact_id", "ident"), by_fact.where(node_rows).select("fact_id", "ident")
    first = facts.join(values.where(F.col("ident") == node).select("fact_id").distinct(), "fact_id", "left_semi").select("ident").distinct()
    second = facts.join(values.join(first, "ident", "left_semi").select("fact_id").distinct(), "fact_id", "left_semi")
    return second.select("ident").distinct().where(F.col("ident") != node)


def two_hop_of_rows(rows: DataFrame, roles: Sequence[str], node: str) -> DataFrame:
    """two_hop() of facts that are still one wide row each, with a column for each of their roles: only the first neighbours are stored."""
    held = rows.select(F.array_compact(F.array(*map(F.col, roles))).alias("held"))
    first = sized(held.where(F.array_contains("held", node)).select(F.explode("held").alias("ident")).distinct())
    met = held.select("held", F.explode(F.array_distinct("held")).alias("ident")).join(first, "ident", "left_semi")
    return met.select(F.explode("held").alias("ident")).distinct().where(F.col("ident") != node)


def walk(links: DataFrame, starts: DataFrame, hops: int = 8) -> DataFrame:
    """(start, node, depth) reached over (src, dst) links, breadth first, each node once at its least depth.

    A round takes ``hops`` steps in one plan before it looks what is new, until nothing is.
    """
    level = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    reached = level
    for turn in count(1):
        ahead, found = level, None
        for _ in range(hops):
            ahead = ahead.join(links, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
            found = ahead if found is None else found.union(ahead)
        fresh = found.groupBy("start", "node").agg(F.min("depth").alias("depth")).join(reached.select("start", "node"), ["start", "node"], "left_anti")
        fresh = cut(fresh)
        level = fresh.where(F.col("depth") == turn * hops)
        reached = reached.unionByName(fresh)
        if level.isEmpty():
            return reached
        if turn % 4 == 0:
            reached = cut(reached)
