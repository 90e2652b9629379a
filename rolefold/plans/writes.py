"""Writes, container differences, schema inference and strict ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsontext import strict_parse
from ..operators import writes
from .base import OPEN, PLACED, PLACED_B, Tables, jdn, query

STORE = "st AS (SELECT 'o:' || o_orderkey AS id, 1 AS version, o_orderstatus AS content_key FROM orders WHERE o_orderkey % 4 <> 0)"


def store(t: Tables):
    rows = t.orders.where("o_orderkey % 4 <> 0")
    return rows.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(1).alias("version"), F.col("o_orderstatus").alias("content_key"))


def incoming(t: Tables):
    key = F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise(F.col("o_orderstatus"))
    return t.orders.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), key.alias("content_key"))


BATCH = "ba AS (SELECT 'o:' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS content_key FROM orders)"


@query(f"""WITH {STORE}, {BATCH} SELECT ba.id, CAST(CASE WHEN st.id IS NULL THEN 1 WHEN st.content_key = ba.content_key THEN 1 ELSE 2 END AS INTEGER) AS version,
CASE WHEN st.id IS NULL THEN 'create' WHEN st.content_key = ba.content_key THEN 'no_op' ELSE 'new_version' END AS outcome, ba.content_key FROM ba LEFT JOIN st ON ba.id = st.id""")
def put_outcomes(spark, d):
    t = Tables(spark, d)
    return writes.put(store(t), incoming(t))


@query(f"""WITH {STORE}, {BATCH} SELECT coalesce(st.id, ba.id) AS id, CASE WHEN st.id IS NULL THEN 'added' WHEN ba.id IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM st FULL JOIN (SELECT * FROM ba WHERE content_key <> 'P') ba ON st.id = ba.id WHERE st.id IS NULL OR ba.id IS NULL OR st.content_key <> ba.content_key""")
def container_diff(spark, d):
    t = Tables(spark, d)
    return writes.compare(store(t), incoming(t).where("content_key <> 'P'"))


@query(f"""WITH {PLACED} SELECT id, CAST(2 AS INTEGER) AS version, CAST(9 AS BIGINT) AS tx_from, status, s_lo, s_hi, s_lo + 864000 AS e_lo, s_lo + 950400 AS e_hi
FROM placed WHERE e_lo = {OPEN} AND e_hi = {OPEN}""")
def apply_end_validity(spark, d):
    facts = Tables(spark, d).facts("placed")
    ends = facts.where(F.col("e_lo") == OPEN).select("id", (F.col("s_lo") + 864000).alias("e_lo"), (F.col("s_lo") + 950400).alias("e_hi"))
    return writes.end_validity(facts, ends, 9).withColumn("tx_from", F.col("tx_from").cast("long"))


@query(f"""WITH {PLACED}, en AS (SELECT id, status, s_lo, e_lo, e_hi, s_lo + 86400 * (1 + s_lo // 86400 % 700) AS lo FROM placed)
SELECT id, CASE WHEN NOT (e_hi >= lo + 86400 AND (e_lo <= lo OR e_lo = e_hi)) THEN 'D013' END AS code FROM en WHERE NOT (e_hi >= lo + 86400 AND (e_lo <= lo OR e_lo = e_hi))""")
def end_findings(spark, d):
    """Ends some days after the start that the end already held contradicts."""
    facts = Tables(spark, d).facts("placed")
    low = F.col("s_lo") + 86400 * (1 + F.floor(F.col("s_lo") / 86400) % 700)
    return writes.end_problems(facts, facts.select("id", low.alias("e_lo"), (low + 86400).alias("e_hi")))


@query(f"""WITH {PLACED}, {PLACED_B}, af AS (SELECT fact_id, bid, role, CASE WHEN role = 'priority' AND fact_id LIKE '%7' THEN 'other' ELSE ident END AS ident FROM binding WHERE NOT (role = 'end' AND fact_id LIKE '%3'))
SELECT b.fact_id, b.bid, CASE WHEN af.fact_id IS NULL THEN 'removed' ELSE 'value_changed' END AS code FROM binding b LEFT JOIN af ON b.fact_id = af.fact_id AND b.bid = af.bid
WHERE af.fact_id IS NULL OR af.ident <> b.ident""")
def version_rule(spark, d):
    before = Tables(spark, d).bindings("placed")
    changed = F.when((F.col("role") == "priority") & F.col("fact_id").endswith("7"), "other").otherwise(F.col("ident"))
    after = before.where(~((F.col("role") == "end") & F.col("fact_id").endswith("3"))).withColumn("ident", changed)
    return writes.version_problems(before, after, ["customer"])


@query(f"""WITH {PLACED}, {PLACED_B}, n AS (SELECT fact_id, role, count(*) AS n FROM binding GROUP BY 1, 2), f AS (SELECT count(DISTINCT fact_id) AS facts FROM binding)
SELECT 'placed' AS relation, role, CAST(CASE WHEN count(*) < (SELECT facts FROM f) THEN 0 ELSE min(n) END AS BIGINT) AS least, max(n) AS most,
 CASE WHEN role IN ('customer', 'order') THEN 'entity' ELSE 'literal' END AS kinds FROM n GROUP BY role""")
def infer_usage(spark, d):
    return writes.infer_usage(Tables(spark, d).bindings("placed")).withColumn("kinds", F.array_join("kinds", ","))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT 't' || l_partkey AS type, 't' || l_partkey // 3 AS parent FROM lineitem WHERE l_partkey > 0),
c(type, above) AS (SELECT type, type FROM (SELECT type FROM p UNION SELECT parent FROM p) UNION SELECT c.type, p.parent FROM c JOIN p ON c.above = p.type) SELECT DISTINCT type, above FROM c""")
def type_closure(spark, d):
    """Parts as types that specialise the one with a third of their number: a lattice as deep as their number is long."""
    part = F.col("l_partkey")
    name = lambda x: F.concat(F.lit("t"), x.cast("string"))
    rows = Tables(spark, d).lineitem.where(part > 0).select(name(part).alias("type"), name(F.floor(part / 3)).alias("parent"))
    return writes.type_closure(rows.distinct())


@query("SELECT event_id, '{\"k\":' || CAST(props::JSON->>'$.k' AS VARCHAR) || '}' AS canonical, NULL::VARCHAR AS code FROM events")
def strict_json(spark, d):
    parsed = strict_parse(F.col("props"))
    return Tables(spark, d).events.select("event_id", parsed["canonical"].alias("canonical"), parsed["code"].alias("code"))
