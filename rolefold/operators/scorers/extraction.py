"""Extraction scores: what of the gold facts is found, at several grains.

Bindings are (scope, relation, fact, role, ident); a scope is a run's document.
Each grain gives both sides distinct keys, counted by ``matched`` of the module ``core``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.running import grouped
from .assign import best


def _cell():
    return F.concat_ws("=", "role", "ident")


def core_keys(rows: DataFrame, beside: tuple[str, ...] = ("flag",)) -> DataFrame:
    """Facts' core signatures: relation and sorted bindings without those of roles ``beside`` the core."""
    some = rows.where(~F.col("role").isin(*beside)) if beside else rows
    return some.groupBy("scope", "relation", "fact").agg(F.array_join(F.array_sort(F.collect_list(_cell())), "|").alias("key"))


def pooled_keys(rows: DataFrame) -> DataFrame:
    """Distinct bindings of a relation, whatever fact has them."""
    return rows.select("scope", "relation", _cell().alias("key")).distinct()


def pairwise_keys(rows: DataFrame) -> DataFrame:
    """Distinct pairs of bindings that one fact has."""
    order = Window.partitionBy("scope", "fact").orderBy("cell")
    cells = rows.select("scope", "relation", "fact", _cell().alias("cell")).withColumn("i", F.row_number().over(order))
    a, b = cells.alias("a"), cells.select("scope", "fact", "cell", "i").alias("b")
    met = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.fact") == F.col("b.fact")) & (F.col("a.i") < F.col("b.i")))
    return met.select(F.col("a.scope").alias("scope"), F.col("a.relation").alias("relation"), F.concat_ws("|", "a.cell", "b.cell").alias("key")).distinct()


def participant_keys(rows: DataFrame) -> DataFrame:
    """Facts' values as bags, roles and relation left aside."""
    return rows.groupBy("scope", "fact").agg(F.array_join(F.array_sort(F.collect_list("ident")), "|").alias("key"))


def _common(gold: dict, pred: dict) -> dict[tuple[str, str], int]:
    """(gold, predicted) -> how many equal items two facts have, each counted once; both sides: item -> fact -> times."""
    met: dict[tuple[str, str], int] = {}
    for item, held in gold.items():
        for g, n in held.items():
            for p, m in pred.get(item, {}).items():
                met[g, p] = met.get((g, p), 0) + min(n, m)
    return met


def _align_scope(scope: str, sides: tuple[list, list]):
    """(scope, gold, predicted, values, cells) of a scope; sides: lists of (relation, fact, role, ident).

    A value in common outweighs all bindings that an alignment of the scope could have in common.
    """
    by_value, by_cell = ({}, {}), ({}, {})
    for side, rows in enumerate(sides):
        for relation, fact, role, ident in rows:
            if relation is None or fact is None or ident is None:
                continue
            held = by_value[side].setdefault((relation, ident), {})
            held[fact] = held.get(fact, 0) + 1
            if role is not None:
                held = by_cell[side].setdefault((relation, role, ident), {})
                held[fact] = held.get(fact, 0) + 1
    values, cells = _common(*by_value), _common(*by_cell)
    big = min(map(len, sides)) + 1
    for g, p in best({pair: big * n + cells.get(pair, 0) for pair, n in values.items()}):
        yield scope, g, p, values[g, p], cells.get((g, p), 0)


def aligned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(scope, gold, predicted, values, cells): each scope's heaviest alignment.

    Bindings move once, to their scope, whose pairs are weighed where they are solved
    and never stored; scopes stream through a task one after another.
    """
    import pyarrow as pa

    names = ["scope", "gold", "predicted", "values", "cells"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    text = lambda c: F.col(c).cast("string").alias(c)
    side = lambda rows, n: rows.select(text("scope"), F.lit(n).alias("side"), text("relation"), text("fact"), text("role"), text("ident"))
    rows = side(gold, 0).union(side(pred, 1)).where("scope IS NOT NULL")

    def run(batches):
        at, sides = None, ([], [])
        for b in batches:
            out = []
            for scope, n, *cell in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if scope != at:
                    if at is not None:
                        out += _align_scope(at, sides)
                    at, sides = scope, ([], [])
                sides[n].append(cell)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out = list(_align_scope(at, sides)) if at is not None else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return grouped(rows, "scope").mapInArrow(run, "scope string, gold string, predicted string, values long, cells long")


def arguments(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(identified, classified, predicted, gold, role_accuracy and f1 of both) over all scopes."""
    sums = aligned(gold, pred).agg(F.coalesce(F.sum("values"), F.lit(0)).alias("identified"), F.coalesce(F.sum("cells"), F.lit(0)).alias("classified"))
    rows = sums.crossJoin(F.broadcast(pred.agg(F.count("*").alias("predicted")))).crossJoin(F.broadcast(gold.agg(F.count("*").alias("gold"))))  # one row each
    both = F.col("predicted") + F.col("gold")
    score = lambda n: F.when(both == 0, 1.0).otherwise(2 * F.col(n) / both).alias(f"{n}_f1")
    return rows.select("*", F.when(F.col("identified") > 0, F.col("classified") / F.col("identified")).alias("role_accuracy"), score("identified"), score("classified"))
