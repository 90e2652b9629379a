"""Lifecycle events on many facts at once: supersede, dispute, retract and undo, assert, end, add evidence.

Stores are append-only, so an event yields rows: new versions of facts, lifecycle
records and their bindings.  An event is written whole or not at all: if one of
its targets refuses, its findings are returned and none of its rows.

facts: all versions (id, version, relation, status, status_ref); targets of an
event: (event, id).  Codes: D001 an id named twice or already taken, D013 a
frozen fact or evidence already held, D014 a transition that isn't allowed,
missing for an id that isn't stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reads import latest

#: Lifecycle relations, and the role in which each binds what it changes.
RECORDS = {"supersedes": "superseded", "disputes": "disputed", "retracts": "retracted"}
#: Statuses from which each status may be reached by a transition (fixed values).
FROM = {"superseded": ("asserted", "disputed"), "disputed": ("asserted", "disputed"), "retracted": ("asserted", "disputed", "goal", "quoted"), "asserted": ("disputed", "quoted", "goal")}


@dataclass
class Change:
    """What an event writes: versions (id, version, status, status_ref, tx_from), bindings (fact_id, bid, role, ident) of
    the lifecycle records, which are versions too; and refused (event, id, code)."""

    versions: DataFrame
    bindings: DataFrame
    refused: DataFrame


def _met(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets beside what is stored of them, and whether the event names them twice or its own id is taken."""
    now = latest(facts).select("id", "version", "relation", "status", "status_ref")
    times = targets.groupBy("event", "id").agg(F.count("*").alias("times"))
    taken = now.select(F.col("id").alias("event"), F.lit(True).alias("taken"))
    one = targets.dropDuplicates(["event", "id"])
    return one.join(times, ["event", "id"]).join(now, "id", "left").join(taken, "event", "left")


def _code(allowed: Column, named: Column | None = None) -> Column:
    """The first finding of a target, in the order in which writes are checked."""
    clash = (F.col("times") > 1) | (F.coalesce("taken", F.lit(False)) if named is None else named)
    return F.when(F.col("version").isNull(), "missing").when(clash, "D001").when(~allowed, "D014")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets of events that pass, and the findings of those that don't."""
    refused = rows.where("code IS NOT NULL").select("event", "id", "code")
    return rows.join(refused.select("event").distinct(), "event", "left_anti"), refused


def _version(rows: DataFrame, status: str, ref: Column, tx: int) -> DataFrame:
    return rows.select("id", (F.col("version") + 1).cast("int").alias("version"), F.lit(status).alias("status"), ref.cast("string").alias("status_ref"), F.lit(tx).cast("long").alias("tx_from"))


def _records(events: DataFrame, tx: int) -> DataFrame:
    """First versions of lifecycle records; events: (event)."""
    return events.select("event").distinct().select(
        F.col("event").alias("id"), F.lit(1).alias("version"), F.lit("asserted").alias("status"), F.lit(None).cast("string").alias("status_ref"), F.lit(tx).cast("long").alias("tx_from")
    )


def _bound(rows: DataFrame) -> DataFrame:
    """Bindings of lifecycle records; rows: (event, role, id), numbered in the order of roles and ids."""
    members = rows.groupBy("event").agg(F.array_sort(F.collect_set(F.struct("role", "id"))).alias("all"))
    each = members.select(F.col("event").alias("fact_id"), F.posexplode("all").alias("i", "b"))
    return each.select("fact_id", F.concat(F.lit("b"), (F.col("i") + 1).cast("string")).alias("bid"), F.col("b.role").alias("role"), F.col("b.id").alias("ident"))


def _lifecycle() -> Column:
    return F.col("relation").isin(*RECORDS)


def supersede(facts: DataFrame, named: DataFrame, tx: int) -> Change:
    """named: (event, side, id) with side ``superseding`` or ``superseded``; the former stay as they are."""
    rows = _met(facts, named)
    fine = ~_lifecycle() & ((F.col("side") == "superseding") | F.col("status").isin(*FROM["superseded"]))
    kept, refused = _split(rows.withColumn("code", _code(fine)))
    changed = _version(kept.where("side = 'superseded'"), "superseded", F.col("event"), tx)
    return Change(changed.unionByName(_records(kept, tx)), _bound(kept.select("event", F.col("side").alias("role"), "id")), refused)


def dispute(facts: DataFrame, targets: DataFrame, tx: int) -> Change:
    """Asserted and disputed facts become disputed, by a record that binds them."""
    rows = _met(facts, targets)
    kept, refused = _split(rows.withColumn("code", _code(F.col("status").isin(*FROM["disputed"]) & ~_lifecycle())))
    bound = _bound(kept.select("event", F.lit("disputed").alias("role"), "id"))
    return Change(_version(kept, "disputed", F.col("event"), tx).unionByName(_records(kept, tx)), bound, refused)


def assert_(facts: DataFrame, targets: DataFrame, tx: int) -> Change:
    """Disputed, quoted and goal facts become asserted; no record is written."""
    rows = _met(facts, targets)
    kept, refused = _split(rows.withColumn("code", _code(F.col("status").isin(*FROM["asserted"]) & ~_lifecycle(), F.lit(False))))
    none = kept.limit(0).select(F.col("event").alias("fact_id"), F.lit("b").alias("bid"), F.lit("r").alias("role"), F.col("id").alias("ident"))
    return Change(_version(kept, "asserted", F.lit(None), tx), none, refused)


def retract(facts: DataFrame, bindings: DataFrame, targets: DataFrame, tx: int, resolve: str | None = None) -> Change:
    """Targets become retracted; retracting a lifecycle record undoes it.

    What a retracted record supersedes or disputes, and still points to it, is
    asserted again.  ``resolve`` says what becomes of the facts that superseded:
    ``retract`` retracts them too, ``dispute`` disputes them together with what
    they superseded (by a record named after the event), None leaves them.
    """
    if resolve not in (None, "retract", "dispute"):
        raise ValueError(f"resolve is retract, dispute or None, not {resolve!r}")
    rows = _met(facts, targets)
    # a supersession itself is a fact that may be retracted
    kept, refused = _split(rows.withColumn("code", _code(F.col("status").isin(*FROM["retracted"]))))
    undo = F.create_map(*(F.lit(x) for r, role in RECORDS.items() if r != "retracts" for x in (r, role)))
    records = kept.where(F.col("relation").isin("supersedes", "disputes")).select("event", F.col("id").alias("record"), undo[F.col("relation")].alias("undone"), "relation")
    held = records.join(bindings.select(F.col("fact_id").alias("record"), "role", F.col("ident").alias("id")), "record")
    own = kept.select("event", "id")
    now = latest(facts).select("id", "version", "status", "status_ref")
    restored = held.where("role = undone").select("event", "record", "id").distinct().join(now, "id").where("status_ref = record").join(own, ["event", "id"], "left_anti")
    above = held.where("relation = 'supersedes' AND role = 'superseding'").select("event", "id").distinct().join(own, ["event", "id"], "left_anti").join(now, "id")
    retracted = kept.select("event", "id", "version")
    parts = []
    bound = kept.select("event", F.lit("retracted").alias("role"), "id")
    if resolve is not None:
        wanted = FROM["retracted" if resolve == "retract" else "disputed"]
        more = above.where(~F.col("status").isin(*wanted)).select("event", "id", F.lit("D014").alias("code"))
        refused = refused.unionByName(more)
        drop = more.select("event").distinct()
        retracted, restored, above, bound = (x.join(drop, "event", "left_anti") for x in (retracted, restored, above, bound))
    if resolve == "retract":
        retracted = retracted.unionByName(above.select("event", "id", "version"))
        bound = bound.unionByName(above.select("event", F.lit("retracted").alias("role"), "id"))
    if resolve == "dispute":
        both = above.select("event", "id", "version").unionByName(restored.select("event", "id", "version"))
        name = F.concat("event", F.lit("/dispute"))
        parts += [_version(both, "disputed", name, tx), _records(both.select(name.alias("event")), tx)]
        bound = bound.unionByName(both.select(name.alias("event"), F.lit("disputed").alias("role"), "id"))
    else:
        parts.append(_version(restored, "asserted", F.lit(None), tx))
    parts += [_version(retracted, "retracted", F.col("event"), tx), _records(retracted, tx)]
    return Change(reduce(DataFrame.unionByName, parts), _bound(bound), refused)


def add_evidence(facts: DataFrame, bindings: DataFrame, held: DataFrame, new: DataFrame, tx: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, evidence, refused) of evidence (event, id, eid) appended to facts.

    Evidence is only ever added: an id that the fact already holds (held: fact_id,
    eid), or that comes twice, is D013.  What is added supports every binding that
    the fact has now.
    """
    now = latest(facts).select("id", "version", "status", "status_ref")
    rows = new.groupBy("event", "id", "eid").agg(F.count("*").alias("times")).join(now, "id", "left")
    rows = rows.join(held.select(F.col("fact_id").alias("id"), "eid", F.lit(True).alias("here")).distinct(), ["id", "eid"], "left")
    kept, refused = _split(rows.withColumn("code", F.when(F.col("version").isNull(), "missing").when(F.col("here") | (F.col("times") > 1), "D013")))
    changed = kept.dropDuplicates(["id"]).select("id", (F.col("version") + 1).cast("int").alias("version"), "status", "status_ref", F.lit(tx).cast("long").alias("tx_from"))
    bids = bindings.groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_set("bid")).alias("supports"))
    evidence = kept.join(bids, "id", "left").select(F.col("id").alias("fact_id"), "eid", F.coalesce("supports", F.array().cast("array<string>")).alias("supports"))
    return changed, evidence, refused


def carried_supports(evidence: DataFrame) -> DataFrame:
    """(fact_id, eid, supports, since): each evidence as the first version that carries it says; evidence: (fact_id, version, eid, supports)."""
    first = F.min_by(F.struct("supports", "version"), "version")
    return evidence.groupBy("fact_id", "eid").agg(first.alias("f")).select("fact_id", "eid", "f.supports", F.col("f.version").alias("since"))


def clock_problems(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, code) D018: incoming versions (id, tx_from) that aren't later than everything stored."""
    last = versions.agg(F.max("tx_from").alias("last"))
    return incoming.crossJoin(F.broadcast(last)).where(F.col("tx_from") <= F.col("last")).select("id", F.lit("D018").alias("code"))  # one row
