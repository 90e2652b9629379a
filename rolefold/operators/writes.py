"""Writes as tables: what a batch creates, changes or may not do, and the rows that lifecycle events append.

Stores are append-only: a write yields new version rows, never updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reads import latest


def put(store: DataFrame, batch: DataFrame, content: str = "content_key") -> DataFrame:
    """(id, version, outcome, columns of batch): create, no_op or new_version for each incoming record.

    An ``expect`` column, where given, must be the stored version (0: none yet);
    if one record's isn't, all outcomes are ``conflict``: a batch is written whole or not.
    """
    have = latest(store).select("id", F.col("version").alias("_v"), F.col(content).alias("_c"))
    rows = batch.join(have, "id", "left")
    known = F.coalesce("_v", F.lit(0))
    outcome = F.when(F.col("_v").isNull(), "create").when(F.col("_c") == F.col(content), "no_op").otherwise("new_version")
    rows = rows.withColumn("outcome", outcome).withColumn("_at", known)
    if "expect" in batch.columns:
        wrong = rows.where(F.col("expect").isNotNull() & (F.col("expect") != F.col("_at"))).limit(1).select(F.lit(True).alias("_wrong"))
        rows = rows.join(F.broadcast(wrong), F.lit(True), "left")
        rows = rows.withColumn("outcome", F.when(F.col("_wrong"), "conflict").otherwise(F.col("outcome"))).drop("_wrong")
    version = F.when(F.col("outcome").isin("create", "new_version"), F.col("_at") + 1).otherwise(F.col("_at"))
    return rows.select("id", version.cast("int").alias("version"), "outcome", *(c for c in batch.columns if c not in ("id", "version")))


def end_problems(facts: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, code) of ends (id, e_lo, e_hi) that are refused: D013 where the fact is frozen or the end isn't narrower
    than the one held, D014 where the fact's state takes none, missing where nothing is stored."""
    rows = ends.select("id", F.col("e_lo").alias("_lo"), F.col("e_hi").alias("_hi")).join(latest(facts), "id", "left")
    code = (
        F.when(F.col("version").isNull(), "missing")
        .when(F.col("status").isin("superseded", "retracted"), "D013")
        .when(~F.col("status").isin("asserted", "disputed"), "D014")
        .when(~_narrower(), "D013")
    )
    return rows.select("id", code.alias("code")).where("code IS NOT NULL")


def _narrower():
    """Whether the new end (_lo, _hi) lies after the start and inside the end that is held, if one is."""
    return (F.col("_lo") >= F.col("s_lo")) & (F.col("e_hi") >= F.col("_hi")) & ((F.col("e_lo") <= F.col("_lo")) | (F.col("e_lo") == F.col("e_hi")))


def end_validity(facts: DataFrame, ends: DataFrame, tx: int) -> DataFrame:
    """New versions for (id, e_lo, e_hi): an end that is added, or made narrower; ``end_problems`` says which are refused."""
    refused = end_problems(facts, ends)
    rows = latest(facts).join(ends.select("id", F.col("e_lo").alias("_lo"), F.col("e_hi").alias("_hi")), "id").join(refused.select("id"), "id", "left_anti")
    kept = rows.where((F.col("_lo") != F.col("e_lo")) | (F.col("_hi") != F.col("e_hi")))
    return kept.select("id", (F.col("version") + 1).cast("int").alias("version"), F.lit(tx).alias("tx_from"), "status", "s_lo", "s_hi", F.col("_lo").alias("e_lo"), F.col("_hi").alias("e_hi"))


def version_problems(before: DataFrame, after: DataFrame, frozen: list[str]) -> DataFrame:
    """(fact_id, code) where a new version loses or changes a binding, or adds one in a frozen role.

    Both have (fact_id, bid, role, ident); a value may only be replaced where it was unknown (null).
    """
    a = before.select("fact_id", "bid", F.col("role").alias("r0"), F.col("ident").alias("i0"), F.lit(True).alias("old"))
    b = after.select("fact_id", "bid", F.col("role").alias("r1"), F.col("ident").alias("i1"), F.lit(True).alias("new"))
    code = (
        F.when(F.col("new").isNull(), "removed")
        .when(F.col("old").isNull() & F.col("r1").isin(*frozen), "frozen_role")
        .when(F.col("r0") != F.col("r1"), "role_changed")
        .when(F.col("i0").isNotNull() & ~F.col("i0").eqNullSafe(F.col("i1")), "value_changed")
    )
    rows = a.join(b, ["fact_id", "bid"], "full_outer")
    known = rows.join(before.select("fact_id").distinct(), "fact_id", "left_semi")
    return known.select("fact_id", "bid", code.alias("code")).where("code IS NOT NULL")


def compare(a: DataFrame, b: DataFrame, digest: str = "content_key") -> DataFrame:
    """(id, state): added, removed or changed between two containers."""
    rows = a.select("id", F.col(digest).alias("x")).join(b.select("id", F.col(digest).alias("y")), "id", "full_outer")
    state = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return rows.select("id", state.alias("state")).where("state IS NOT NULL")


def infer_usage(bindings: DataFrame) -> DataFrame:
    """(relation, role, least, most, kinds): a schema read off the data, roles that are missing counting as 0."""
    counted = bindings.groupBy("relation", "fact_id", "role").agg(F.count("*").alias("n"))
    facts = bindings.groupBy("relation").agg(F.count_distinct("fact_id").alias("facts"))
    kinds = bindings.groupBy("relation", "role").agg(F.array_sort(F.collect_set("value_kind")).alias("kinds"))
    roles = counted.groupBy("relation", "role").agg(F.min("n").alias("lo"), F.max("n").alias("most"), F.count("*").alias("held"))
    rows = roles.join(facts, "relation").join(kinds, ["relation", "role"])
    return rows.select("relation", "role", F.when(F.col("held") < F.col("facts"), 0).otherwise(F.col("lo")).cast("long").alias("least"), "most", "kinds")


def type_closure(parents: DataFrame) -> DataFrame:
    """(type, above): every type with itself and all it specialises; parents: (type, parent)."""
    from ..storage import cut

    links = parents.select("type", F.col("parent").alias("above")).distinct()
    own = links.select("type").union(links.select("above")).distinct()
    now = own.select("type", F.col("type").alias("above")).union(links).distinct()
    size = -1
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.above") == F.col("b.type")).select(F.col("a.type"), F.col("b.above"))
        now = cut(step.union(now).distinct())
        if (n := now.count()) == size:
            break
        size = n
    return now
