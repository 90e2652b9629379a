"""Record rules: facts and bindings against a schema and against each other, as (id, code, detail) rows.

Tables: facts (id, relation, status, s_lo, e_hi, n_evidence), bindings (fact_id,
bid, role, position, value_kind, ident, types, datatype), usage (relation, role,
least, most, kinds, types, datatypes, ordered), one row per declared role.  Kinds
are entity, fact, literal, novalue, somevalue and unbound.  A rule is a filter or
a count beside a schema-sized table, which is broadcast; the rules of a fact that
its relation or its lack of bindings already refuses aren't looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import sized

SPECIAL = ("novalue", "somevalue", "unbound")


def _found(rows: DataFrame, code: str, detail: Column | str | None = None, id_col: str = "fact_id") -> DataFrame:
    what = F.lit(None).cast("string") if detail is None else (F.col(detail) if isinstance(detail, str) else detail).cast("string")
    return rows.select(F.col(id_col).alias("id"), F.lit(code).alias("code"), what.alias("detail"))


def _flags(rows: DataFrame, flags: list[tuple[Column, str, str | None]], id_col: str = "fact_id") -> DataFrame:
    """Findings of several rules (condition, code, detail) in one pass over rows."""
    none = F.lit(None).cast("string")
    each = F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), (none if d is None else F.col(d).cast("string")).alias("detail"))) for c, code, d in flags))
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array_compact(each)).alias("x")).select("id", "x.code", "x.detail")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def declared(facts: DataFrame, bindings: DataFrame, usage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings S001 (unknown relation) and S007 (no binding), and the ids of the facts that pass both."""
    known = F.broadcast(usage.select("relation").distinct())
    unknown = facts.join(known, "relation", "left_anti")
    here = facts.join(known, "relation", "left_semi")
    bound = sized(bindings.select(F.col("fact_id").alias("id")).distinct())
    empty = here.join(bound, "id", "left_anti")
    return _all([_found(unknown, "S001", "relation", "id"), _found(empty, "S007", None, "id")]), here.join(bound, "id", "left_semi")


def binding_rules(bindings: DataFrame, usage: DataFrame) -> DataFrame:
    """S002 a role that isn't allowed, S005 a filler that its role doesn't take, S015 a position where none is, S025 a bid used twice.

    bindings carry their fact's relation.  An entity's types are its own and all
    above them; an entity without types isn't resolved and passes.
    """
    table = F.broadcast(usage.select("relation", "role", "kinds", F.col("types").alias("wanted"), "datatypes", "ordered"))
    rows = bindings.join(table, ["relation", "role"], "left")
    fine = F.col("kinds").isNotNull()
    kind = ~F.array_contains("kinds", F.col("value_kind")) & (F.col("value_kind") != "unbound")
    typed = (F.col("value_kind") == "entity") & (F.size("wanted") > 0) & (F.size("types") > 0) & ~F.arrays_overlap("wanted", "types")
    datum = (F.col("value_kind") == "literal") & (F.size("datatypes") > 0) & ~F.coalesce(F.array_contains("datatypes", F.col("datatype")), F.lit(False))
    twice = bindings.groupBy("fact_id", "bid").agg(F.count("*").alias("n")).where("n > 1")
    return _all([
        _flags(rows, [(~fine, "S002", "bid"), (fine & (kind | typed | datum), "S005", "bid"), (fine & ~F.col("ordered") & F.col("position").isNotNull(), "S015", "bid")]),
        _found(twice, "S025", "bid"),
    ])


def role_rules(facts: DataFrame, bindings: DataFrame, usage: DataFrame) -> DataFrame:
    """Per role: S003 too few (S018 on a goal), S004 too many, S013 novalue beside others, S014 a filler twice, S015 positions that aren't 1..n."""
    v = F.col("value_kind")
    filler = F.when(v.isin("novalue", "somevalue"), v).when(v != "unbound", F.concat_ws("\x01", v, "ident"))
    counted = bindings.groupBy("fact_id", "role").agg(
        F.count("*").alias("n"), F.count_if(v == "novalue").alias("none"), F.count(filler).alias("fillers"), F.count_distinct(filler).alias("kinds_of"),
        F.array_sort(F.collect_list("position")).alias("places"),
    )
    every = facts.select(F.col("id").alias("fact_id"), "relation", "status").join(F.broadcast(usage.select("relation", "role", "least", "most", "ordered")), "relation")
    rows = every.join(counted, ["fact_id", "role"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n, goal = F.col("n"), F.col("status") == "goal"
    few = n < F.col("least")
    wrong = F.col("ordered") & (n > 0) & (F.coalesce("places", F.array().cast("array<int>")) != F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")))
    repeated = (F.col("fillers") > F.col("kinds_of")) & ~F.col("ordered")
    return _flags(rows, [
        (few & ~goal, "S003", "role"), (few & goal, "S018", "role"), (n > F.col("most"), "S004", "role"), ((F.col("none") > 0) & (n > 1), "S013", "role"),
        (repeated, "S014", "role"), (wrong, "S015", "role"),
    ])


def fact_rules(facts: DataFrame, bindings: DataFrame) -> DataFrame:
    """S009 a validity that can't be, S011 an assertion without evidence, S019 a variable bound twice."""
    v = bindings.where("value_kind = 'unbound'").groupBy("fact_id", "ident").agg(F.count("*").alias("n")).where("n > 1").select("fact_id").distinct()
    own = [(F.col("s_lo") >= F.col("e_hi"), "S009", None), ((F.col("status") == "asserted") & (F.col("n_evidence") == 0), "S011", None)]
    return _all([_flags(facts, own, "id"), _found(v, "S019")])


def support_rules(evidence: DataFrame, bindings: DataFrame) -> DataFrame:
    """S022: evidence (fact_id, eid, supports) that names bindings which its fact doesn't have."""
    named = evidence.select("fact_id", "eid", F.explode("supports").alias("bid"))
    missing = named.join(bindings.select("fact_id", "bid").distinct(), ["fact_id", "bid"], "left_anti")
    return _found(missing, "S022", F.concat_ws("/", "eid", "bid"))


def relation_constraints(bindings: DataFrame, constraints: DataFrame) -> DataFrame:
    """S024 where a relation's constraint (relation, kind, roles) doesn't hold on the fillers of its roles.

    must_differ: no filler is shared; must_agree: all roles have the same fillers;
    requires: who binds the first role binds the others; excludes: at most one of
    the roles is bound; at_least_one_of: one is.
    """
    fillers = bindings.groupBy("fact_id", "relation").agg(
        F.map_from_entries(F.array_distinct(F.transform(F.collect_set("role"), lambda r: F.struct(r.alias("k"), F.lit(True).alias("v"))))).alias("bound"),
        F.collect_set(F.struct("role", F.concat_ws("\x01", "value_kind", "ident").alias("value"))).alias("all"),
    )
    rows = fillers.join(F.broadcast(constraints), "relation")
    of = lambda role: F.array_sort(F.transform(F.filter("all", lambda c: c["role"] == role), lambda c: c["value"]))
    held = F.filter("roles", lambda r: F.map_contains_key("bound", r))
    each = F.flatten(F.transform(held, of))
    kind, n = F.col("kind"), F.size(held)
    ok = (
        F.when(kind == "must_differ", F.size(each) == F.size(F.array_distinct(each)))
        .when(kind == "must_agree", F.size(F.array_distinct(F.transform("roles", of))) <= 1)
        .when(kind == "requires", ~F.map_contains_key("bound", F.get("roles", F.lit(0))) | (n == F.size("roles")))
        .when(kind == "excludes", n <= 1)
        .when(kind == "at_least_one_of", n >= 1)
    )
    return _found(rows.where(~ok), "S024", F.concat_ws(" ", "kind", F.array_join("roles", ",")))


def record_findings(facts: DataFrame, bindings: DataFrame, usage: DataFrame) -> DataFrame:
    """(id, code, detail): all rules of single records."""
    first, fine = declared(facts, bindings, usage)
    fine = sized(fine)  # every rule reads the facts and bindings that are looked at
    held = bindings.drop("relation") if "relation" in bindings.columns else bindings
    held = sized(held.join(fine.select(F.col("id").alias("fact_id"), "relation"), "fact_id"))
    return _all([first, binding_rules(held, usage), role_rules(fine, held, usage), fact_rules(fine, held)])


def document_findings(records: DataFrame, references: DataFrame, complete: bool = True) -> DataFrame:
    """(id, code, detail) across records: D001 an id and version twice, D002 a reference to nothing, D007 an id of two
    kinds, D017 a stored candidate, D020 a reference to what was merged elsewhere.

    records: (kind, id, version, status, redirect_to); references: (id, kind, ref) of current versions.
    """
    twice = records.groupBy("id", "version").agg(F.count("*").alias("n")).where("n > 1")
    both = records.groupBy("id").agg(F.count_distinct("kind").alias("n")).where("n > 1")
    now = records.groupBy("kind", "id").agg(F.max_by("redirect_to", "version").alias("moved"))
    met = references.join(now.select(F.col("kind"), F.col("id").alias("ref"), "moved", F.lit(True).alias("here")), ["kind", "ref"], "left")
    parts = [
        _found(twice, "D001", "version", "id"), _found(both, "D007", None, "id"), _found(records.where("status = 'candidate'"), "D017", None, "id"),
        _found(met.where("moved IS NOT NULL"), "D020", "ref", "id"),
    ]
    return _all([*parts, _found(met.where("here IS NULL"), "D002", "ref", "id")] if complete else parts)
