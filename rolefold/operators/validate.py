"""Validation rules as findings: (id, code) rows from column predicates, counts and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unresolved(references: DataFrame, known: DataFrame) -> DataFrame:
    """(id, ref) of references (id, ref) to nothing in known (ref)."""
    return references.join(known.select("ref").distinct(), "ref", "left_anti").select("id", "ref")


def cardinalities(bindings: DataFrame, usage: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, role, n, code): roles bound less often than least or more often than most; usage is schema-sized."""
    counted = bindings.groupBy("fact_id", "role").agg(F.count("*").alias("n"))
    every = facts.select("id").crossJoin(F.broadcast(usage))
    rows = every.join(counted, (F.col("id") == F.col("fact_id")) & (every["role"] == counted["role"]), "left")
    n = F.coalesce("n", F.lit(0))
    code = F.when(n < F.col("least"), "S003").when(n > F.col("most"), "S004")
    return rows.select("id", every["role"], n.alias("n"), code.alias("code")).where("code IS NOT NULL")


def constraint(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every row that breaks a rule; rules are conditions that should hold."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(F.col(id_col).alias("id"), F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def pointers(facts: DataFrame, records: DataFrame) -> DataFrame:
    """(id, code): facts whose state needs a record that isn't there, and records that no fact points to.

    facts: (id, status, status_ref); records: (record, target).
    """
    need = facts.where(F.col("status").isin("superseded", "retracted", "disputed"))
    here = records.select("record", "target")
    lacking = need.join(here, (F.col("status_ref") == F.col("record")) & (F.col("id") == F.col("target")), "left_anti")
    back = facts.select(F.col("status_ref").alias("record"), F.col("id").alias("target"))
    idle = here.join(back, ["record", "target"], "left_anti")
    return lacking.select("id", F.lit("no_record").alias("code")).union(idle.select(F.col("record"), F.lit("no_pointer")))


def outcome(findings: DataFrame) -> DataFrame:
    """(id, outcome) by the worst severity: error fails, warning warns, anything else passes."""
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return findings.groupBy("id").agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), worst + 1).alias("outcome"))
