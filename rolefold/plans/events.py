"""Lifecycle events on orders as facts; every customer is one event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events
from .base import Tables, query

#: Orders as facts; customers with a number divisible by 4 have a supersession of their urgent orders by their low ones, by 4 with rest 1 a dispute.
FACTS = """fa AS (SELECT 'o:' || o_orderkey AS id, 1 AS version, 'placed' AS relation,
  CASE WHEN o_custkey % 4 = 0 AND o_orderpriority = '1-URGENT' THEN 'superseded' WHEN o_custkey % 4 = 1 AND o_orderpriority = '1-URGENT' THEN 'disputed' WHEN o_orderstatus = 'P' THEN 'retracted' WHEN o_orderkey % 30 = 7 THEN 'quoted' ELSE 'asserted' END AS status,
  CASE WHEN o_custkey % 4 < 2 AND o_orderpriority = '1-URGENT' THEN 'm:' || o_custkey END AS status_ref, o_custkey AS c, o_orderpriority AS p FROM orders),
re AS (SELECT DISTINCT 'm:' || c AS id, CASE WHEN c % 4 = 0 THEN 'supersedes' ELSE 'disputes' END AS relation, c FROM fa WHERE c % 4 < 2 AND p = '1-URGENT'),
bi AS (SELECT 'm:' || c AS record, CASE WHEN c % 4 = 0 THEN 'superseded' ELSE 'disputed' END AS role, id FROM fa WHERE c % 4 < 2 AND p = '1-URGENT'
  UNION ALL SELECT 'm:' || c, 'superseding', id FROM fa WHERE c % 4 = 0 AND p = '5-LOW' AND c IN (SELECT c FROM re))"""
FLAT = "id, CAST(version AS INTEGER) AS version, status, status_ref, CAST(tx AS BIGINT) AS tx_from"


def state(t: Tables):
    """(facts with c and p, lifecycle bindings)."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    four, urgent = F.col("o_custkey") % 4, F.col("o_orderpriority") == "1-URGENT"
    status = F.when((four == 0) & urgent, "superseded").when((four == 1) & urgent, "disputed").when(F.col("o_orderstatus") == "P", "retracted").when(F.col("o_orderkey") % 30 == 7, "quoted").otherwise("asserted")
    orders = t.orders.select(
        name("o:", "o_orderkey").alias("id"), F.lit(1).alias("version"), F.lit("placed").alias("relation"), status.alias("status"), F.when((four < 2) & urgent, name("m:", "o_custkey")).alias("status_ref"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p")
    )
    named = orders.where("status_ref IS NOT NULL")
    kind = F.when(F.col("c") % 4 == 0, "supersedes").otherwise("disputes")
    records = named.select("c", "status_ref").distinct().select(F.col("status_ref").alias("id"), F.lit(1).alias("version"), kind.alias("relation"), F.lit("asserted").alias("status"), F.lit(None).cast("string").alias("status_ref"), "c", F.lit(None).cast("string").alias("p"))
    low = orders.where("c % 4 = 0 AND p = '5-LOW'").join(records.select("c"), "c", "left_semi")
    below = named.select(F.col("status_ref").alias("fact_id"), F.when(F.col("c") % 4 == 0, "superseded").otherwise("disputed").alias("role"), F.col("id").alias("ident"))
    return orders.unionByName(records), below.unionByName(low.select(F.concat(F.lit("m:"), F.col("c").cast("string")).alias("fact_id"), F.lit("superseding").alias("role"), F.col("id").alias("ident")))


SUPERSEDE = f"""{FACTS}, na AS (SELECT 'n:' || c AS event, CASE WHEN p = '2-HIGH' THEN 'superseding' ELSE 'superseded' END AS side, id, status, c FROM fa WHERE p IN ('2-HIGH', '3-MEDIUM')),
bad AS (SELECT event, id FROM na WHERE side = 'superseded' AND status NOT IN ('asserted', 'disputed')), ok AS (SELECT * FROM na WHERE event NOT IN (SELECT event FROM bad))"""


def _supersede(spark, d):
    facts, _ = state(Tables(spark, d))
    rows = facts.where("p IN ('2-HIGH', '3-MEDIUM')")
    named = rows.select(F.concat(F.lit("n:"), F.col("c").cast("string")).alias("event"), F.when(F.col("p") == "2-HIGH", "superseding").otherwise("superseded").alias("side"), "id")
    return events.supersede(facts, named, 7)


@query(f"WITH {SUPERSEDE} SELECT {FLAT} FROM (SELECT id, 2 AS version, 'superseded' AS status, event AS status_ref, 7 AS tx FROM ok WHERE side = 'superseded' UNION ALL SELECT DISTINCT event, 1, 'asserted', NULL, 7 FROM ok)")
def apply_supersede(spark, d):
    return _supersede(spark, d).versions


@query(f"WITH {SUPERSEDE} SELECT event AS fact_id, 'b' || row_number() OVER (PARTITION BY event ORDER BY side, id) AS bid, side AS role, id AS ident FROM ok")
def apply_supersede_bindings(spark, d):
    return _supersede(spark, d).bindings


@query(f"WITH {SUPERSEDE} SELECT event, id, 'D014' AS code FROM bad")
def apply_supersede_refused(spark, d):
    return _supersede(spark, d).refused


DISPUTE = f"""{FACTS}, na AS (SELECT 'n:' || c AS event, id, status FROM fa WHERE p = '4-NOT SPECIFIED'), bad AS (SELECT event, id FROM na WHERE status NOT IN ('asserted', 'disputed')), ok AS (SELECT * FROM na WHERE event NOT IN (SELECT event FROM bad))"""


@query(f"WITH {DISPUTE} SELECT {FLAT} FROM (SELECT id, 2 AS version, 'disputed' AS status, event AS status_ref, 8 AS tx FROM ok UNION ALL SELECT DISTINCT event, 1, 'asserted', NULL, 8 FROM ok)")
def apply_dispute(spark, d):
    facts, _ = state(Tables(spark, d))
    return events.dispute(facts, facts.where("p = '4-NOT SPECIFIED'").select(F.concat(F.lit("n:"), F.col("c").cast("string")).alias("event"), "id"), 8).versions


@query(f"""WITH {FACTS}, na AS (SELECT 'n:' || c AS event, id, status FROM fa WHERE status IN ('disputed', 'quoted') OR (c % 9 = 0 AND p = '1-URGENT')), bad AS (SELECT event FROM na WHERE status NOT IN ('disputed', 'quoted', 'goal'))
SELECT {FLAT} FROM (SELECT id, 2 AS version, 'asserted' AS status, NULL::VARCHAR AS status_ref, 9 AS tx FROM na WHERE event NOT IN (SELECT event FROM bad))""")
def apply_assert(spark, d):
    facts, _ = state(Tables(spark, d))
    targets = facts.where("p IS NOT NULL AND (status IN ('disputed', 'quoted') OR (c % 9 = 0 AND p = '1-URGENT'))")
    return events.assert_(facts, targets.select(F.concat(F.lit("n:"), F.col("c").cast("string")).alias("event"), "id"), 9).versions


UNDO = f"""{FACTS}, na AS (SELECT 'n:' || c AS event, id, relation, c FROM re), back AS (SELECT na.event, fa.id FROM na JOIN bi ON bi.record = na.id AND bi.role <> 'superseding' JOIN fa ON fa.id = bi.id AND fa.status_ref = na.id),
above AS (SELECT DISTINCT na.event, fa.id, fa.status FROM na JOIN bi ON bi.record = na.id AND bi.role = 'superseding' JOIN fa ON fa.id = bi.id)"""


def _undo(spark, d, resolve):
    facts, bound = state(Tables(spark, d))
    targets = facts.where("relation <> 'placed'").select(F.concat(F.lit("n:"), F.col("c").cast("string")).alias("event"), "id")
    return events.retract(facts, bound, targets, 10, resolve)


@query(f"""WITH {UNDO} SELECT {FLAT} FROM (SELECT id, 2 AS version, 'asserted' AS status, NULL::VARCHAR AS status_ref, 10 AS tx FROM back
UNION ALL SELECT id, 2, 'retracted', event, 10 FROM na UNION ALL SELECT DISTINCT event, 1, 'asserted', NULL, 10 FROM na)""")
def apply_undo(spark, d):
    """Retracted supersessions and disputes: what they changed is asserted again."""
    return _undo(spark, d, None).versions


@query(f"""WITH {UNDO}, bad AS (SELECT event FROM above WHERE status NOT IN ('asserted', 'disputed', 'goal', 'quoted')) SELECT {FLAT} FROM (
SELECT id, 2 AS version, 'asserted' AS status, NULL::VARCHAR AS status_ref, 10 AS tx FROM back WHERE event NOT IN (SELECT event FROM bad) UNION ALL SELECT id, 2, 'retracted', event, 10 FROM na WHERE event NOT IN (SELECT event FROM bad)
UNION ALL SELECT id, 2, 'retracted', event, 10 FROM above WHERE event NOT IN (SELECT event FROM bad) UNION ALL SELECT DISTINCT event, 1, 'asserted', NULL, 10 FROM na WHERE event NOT IN (SELECT event FROM bad))""")
def apply_undo_retract(spark, d):
    return _undo(spark, d, "retract").versions


@query(f"""WITH {UNDO}, bad AS (SELECT event FROM above WHERE status NOT IN ('asserted', 'disputed')), both_ AS (SELECT event, id FROM back UNION ALL SELECT event, id FROM above),
ok AS (SELECT * FROM both_ WHERE event NOT IN (SELECT event FROM bad)) SELECT {FLAT} FROM (SELECT id, 2 AS version, 'disputed' AS status, event || '/dispute' AS status_ref, 10 AS tx FROM ok UNION ALL SELECT DISTINCT event || '/dispute', 1, 'asserted', NULL, 10 FROM ok
UNION ALL SELECT id, 2, 'retracted', event, 10 FROM na WHERE event NOT IN (SELECT event FROM bad) UNION ALL SELECT DISTINCT event, 1, 'asserted', NULL, 10 FROM na WHERE event NOT IN (SELECT event FROM bad))""")
def apply_undo_dispute(spark, d):
    return _undo(spark, d, "dispute").versions


EVIDENCE = """he AS (SELECT 'o:' || l_orderkey AS fact_id, 'e' || l_suppkey % 5 AS eid FROM lineitem WHERE l_returnflag = 'R'), bi AS (SELECT 'o:' || l_orderkey AS fact_id, 'b' || l_linenumber AS bid FROM lineitem),
ne AS (SELECT 'n:' || l_orderkey AS event, 'o:' || l_orderkey AS id, 'e' || l_partkey % 40 AS eid FROM lineitem WHERE l_returnflag = 'A'),
bad AS (SELECT event, id, eid FROM ne GROUP BY event, id, eid HAVING count(*) > 1 OR EXISTS (SELECT 1 FROM he WHERE he.fact_id = id AND he.eid = ne.eid)), ok AS (SELECT * FROM ne WHERE event NOT IN (SELECT event FROM bad))"""


def _evidence(spark, d):
    t = Tables(spark, d)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    order = F.col("l_orderkey")
    facts = t.orders.select(name("o:", F.col("o_orderkey")).alias("id"), F.lit(1).alias("version"), F.lit("asserted").alias("status"), F.lit(None).cast("string").alias("status_ref"))
    held = t.lineitem.where("l_returnflag = 'R'").select(name("o:", order).alias("fact_id"), name("e", F.col("l_suppkey") % 5).alias("eid"))
    new = t.lineitem.where("l_returnflag = 'A'").select(name("n:", order).alias("event"), name("o:", order).alias("id"), name("e", F.col("l_partkey") % 40).alias("eid"))
    return events.add_evidence(facts, t.lineitem.select(name("o:", order).alias("fact_id"), name("b", F.col("l_linenumber")).alias("bid")), held, new, 11)


@query(f"WITH {EVIDENCE} SELECT id AS fact_id, eid, (SELECT array_to_string(list_sort(list(DISTINCT bid)), ',') FROM bi WHERE bi.fact_id = ok.id) AS supports FROM ok")
def apply_add_evidence(spark, d):
    return _evidence(spark, d)[1].withColumn("supports", F.array_join("supports", ","))


@query(f"WITH {EVIDENCE} SELECT event, id, 'D013' AS code FROM bad")
def add_evidence_refused(spark, d):
    return _evidence(spark, d)[2]


@query("""WITH e AS (SELECT 'c:' || o_custkey AS fact_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version, 'e' || o_orderkey % 4 AS eid, o_orderpriority AS supports FROM orders)
SELECT fact_id, eid, arg_min(supports, version) AS supports, min(version) AS since FROM e GROUP BY 1, 2""")
def carried_supports(spark, d):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = Tables(spark, d).orders.select(
        F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("fact_id"), number.alias("version"), F.concat(F.lit("e"), (F.col("o_orderkey") % 4).cast("string")).alias("eid"), F.array("o_orderpriority").alias("supports")
    )
    return events.carried_supports(rows).withColumn("supports", F.array_join("supports", ","))


@query("SELECT 'o:' || o_orderkey AS id, 'D018' AS code FROM orders WHERE o_orderkey <= (SELECT max(event_id) FROM events)")
def clock_findings(spark, d):
    t = Tables(spark, d)
    stored = t.events.select(F.col("event_id").alias("tx_from"))
    return events.clock_problems(stored, t.orders.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("tx_from")))
