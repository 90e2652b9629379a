"""Validation, lifecycle histories and the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, queue, validate
from .base import PLACED, PLACED_B, Tables, query

STATUS = """CASE event_type WHEN 'signup' THEN 'asserted' WHEN 'purchase' THEN 'disputed' WHEN 'error' THEN 'retracted' WHEN 'view' THEN 'superseded' ELSE 'quoted' END"""
EVENT_VERSIONS = f"""ev AS (SELECT 'u:' || user_id AS id, CAST(2 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + (event_id % 7 = 0)::INT AS INTEGER) AS version,
 epoch_us(ts) - (event_id % 11 = 0)::INT * 86400000000 AS tx_from, {STATUS} AS status FROM events)"""


def event_versions(t: Tables):
    """Users as entities whose events are versions, some numbered or timed wrongly."""
    from pyspark.sql import Window

    number = 2 * F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) + (F.col("event_id") % 7 == 0).cast("int")
    kind = F.col("event_type")
    status = F.when(kind == "signup", "asserted").when(kind == "purchase", "disputed").when(kind == "error", "retracted").when(kind == "view", "superseded").otherwise("quoted")
    tx = F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("event_id") % 11 == 0).cast("long") * 86_400_000_000
    return t.events.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id"), number.alias("version"), tx.alias("tx_from"), status.alias("status"))


PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in lifecycle.TRANSITIONS)
STEPS = f"""st AS (SELECT *, row_number() OVER w AS place, lag(tx_from) OVER w AS tx_before, lag(status) OVER w AS before FROM ev WINDOW w AS (PARTITION BY id ORDER BY version))"""


@query(f"WITH {EVENT_VERSIONS}, {STEPS} SELECT id, version, 'transition' AS code FROM st WHERE before IS NOT NULL AND before <> status AND (before, status) NOT IN ({PAIRS})")
def transition_violations(spark, d):
    return lifecycle.history_problems(event_versions(Tables(spark, d))).where("code = 'transition'")


@query(f"WITH {EVENT_VERSIONS}, {STEPS} SELECT id, version, code FROM (SELECT id, version, CASE WHEN place <> version THEN 'version_gap' END AS code FROM st UNION ALL SELECT id, version, CASE WHEN tx_from <= tx_before THEN 'time_order' END FROM st) WHERE code IS NOT NULL")
def version_gaps(spark, d):
    return lifecycle.history_problems(event_versions(Tables(spark, d))).where("code <> 'transition'")


@query("SELECT 'o:' || o_orderkey AS id, 'c:' || o_custkey AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def unresolved_refs(spark, d):
    t = Tables(spark, d)
    refs = t.orders.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("ref"))
    known = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("ref"))
    return validate.unresolved(refs, known)


@query("""WITH n AS (SELECT l_orderkey, l_returnflag AS role, count(*) AS n FROM lineitem GROUP BY 1, 2), u(role, least, most) AS (VALUES ('R', 1, 2), ('A', 0, 3), ('N', 1, 9)),
e AS (SELECT o_orderkey, role, least, most FROM orders, u)
SELECT 'o:' || o_orderkey AS id, e.role, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < least THEN 'S003' ELSE 'S004' END AS code
FROM e LEFT JOIN n ON o_orderkey = l_orderkey AND e.role = n.role WHERE coalesce(n, 0) < least OR coalesce(n, 0) > most""")
def cardinality_findings(spark, d):
    t = Tables(spark, d)
    key = lambda c: F.concat(F.lit("o:"), F.col(c).cast("string"))
    usage = spark.createDataFrame([("R", 1, 2), ("A", 0, 3), ("N", 1, 9)], "role string, least int, most int")
    rows = t.lineitem.select(key("l_orderkey").alias("fact_id"), F.col("l_returnflag").alias("role"))
    return validate.cardinalities(rows, usage, t.orders.select(key("o_orderkey").alias("id")))


@query("""SELECT 'o:' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, rule FROM (
SELECT *, 'must_differ' AS rule FROM lineitem WHERE NOT l_partkey % 10 <> l_suppkey % 10
UNION ALL SELECT *, 'requires' FROM lineitem WHERE NOT (l_returnflag <> 'R' OR l_linestatus = 'F')
UNION ALL SELECT *, 'range' FROM lineitem WHERE NOT l_discount <= 0.08)""")
def constraint_findings(spark, d):
    rules = {
        "must_differ": F.col("l_partkey") % 10 != F.col("l_suppkey") % 10,
        "requires": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"),
        "range": F.col("l_discount") <= 0.08,
    }
    text = F.concat(F.lit("o:"), F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))))
    return validate.constraint(Tables(spark, d).lineitem.withColumn("id", text), "id", rules)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return validate.duplicates(Tables(spark, d).lineitem, ["l_orderkey", "l_linenumber"])


@query("""WITH f AS (SELECT 'o:' || o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'asserted' WHEN o_orderstatus = 'O' THEN 'superseded' ELSE 'disputed' END AS status,
 CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 <> 0 THEN 'm:' || o_orderkey END AS status_ref FROM orders),
r AS (SELECT 'm:' || o_orderkey AS record, 'o:' || o_orderkey AS target FROM orders WHERE o_orderkey % 5 <> 0)
SELECT id, 'no_record' AS code FROM f WHERE status IN ('superseded', 'retracted', 'disputed') AND NOT EXISTS (SELECT 1 FROM r WHERE record = status_ref AND target = id)
UNION ALL SELECT record, 'no_pointer' FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE status_ref = record AND id = target)""")
def pointer_findings(spark, d):
    key, mark = F.col("o_orderkey"), F.col("o_orderstatus")
    text = lambda p: F.concat(F.lit(p), key.cast("string"))
    orders = Tables(spark, d).orders
    status = F.when(mark == "F", "asserted").when(mark == "O", "superseded").otherwise("disputed")
    facts = orders.select(text("o:").alias("id"), status.alias("status"), F.when((mark != "F") & (key % 3 != 0), text("m:")).alias("status_ref"))
    return validate.pointers(facts, orders.where(key % 5 != 0).select(text("m:").alias("record"), text("o:").alias("target")))


ACTION = "CASE event_type WHEN 'signup' THEN 'lint_pass' WHEN 'view' THEN 'lint_warn' WHEN 'click' THEN 'flag' WHEN 'purchase' THEN 'accept' ELSE 'withdraw' END"
FOLD = f"""RECURSIVE l AS (SELECT 'q:' || user_id || '-' || event_id % 3 AS target, event_id AS lid, {ACTION} AS action,
 row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, event_id % 3) AS n FROM events),
s(target, i, n, state, illegal) AS (SELECT DISTINCT target, CAST(0 AS BIGINT), n, 'pending', 0 FROM l
 UNION ALL SELECT s.target, s.i + 1, s.n, CASE WHEN ok THEN nxt ELSE s.state END, s.illegal + (NOT ok)::INT FROM s JOIN
  (SELECT *, CASE action WHEN 'lint_pass' THEN 'linted' WHEN 'lint_warn' THEN 'needs_review' WHEN 'flag' THEN 'needs_review' WHEN 'accept' THEN 'accepted' ELSE 'withdrawn' END AS nxt FROM l) l
  ON l.target = s.target AND l.i = s.i + 1,
  LATERAL (SELECT CASE action WHEN 'lint_pass' THEN s.state = 'pending' WHEN 'lint_warn' THEN s.state = 'pending' WHEN 'flag' THEN s.state IN ('pending', 'linted')
   WHEN 'accept' THEN s.state IN ('linted', 'needs_review') ELSE s.state IN ('pending', 'linted', 'needs_review') END AS ok)),
f AS (SELECT target, state, CAST(illegal AS INTEGER) AS illegal, CAST(n AS INTEGER) AS entries FROM s WHERE i = n)"""


def queue_log(t: Tables):
    kind = F.col("event_type")
    action = F.when(kind == "signup", "lint_pass").when(kind == "view", "lint_warn").when(kind == "click", "flag").when(kind == "purchase", "accept").otherwise("withdraw")
    target = F.concat(F.lit("q:"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 3).cast("string"))
    return t.events.select(target.alias("target"), F.col("event_id").alias("lid"), action.alias("action"))


@query(f"WITH {FOLD} SELECT target, state, illegal, entries FROM f")
def queue_fold(spark, d):
    return queue.fold(queue_log(Tables(spark, d)))


@query(f"WITH {FOLD} SELECT state, count(*) AS items, CAST(sum(illegal) AS BIGINT) AS illegal FROM f GROUP BY state")
def queue_state_counts(spark, d):
    return queue.fold(queue_log(Tables(spark, d))).groupBy("state").agg(F.count("*").alias("items"), F.sum("illegal").alias("illegal"))


JUDGE = """RECURSIVE e AS (SELECT 'q:' || user_id || '-' || event_id % 3 AS target, event_id AS line, CASE event_type WHEN 'signup' THEN 'lint' WHEN 'view' THEN 'lint' WHEN 'click' THEN 'flag' WHEN 'purchase' THEN 'accept' ELSE 'verdict' END AS action,
  CASE event_type WHEN 'signup' THEN 'linted' WHEN 'view' THEN 'needs_review' WHEN 'click' THEN 'needs_review' WHEN 'purchase' THEN 'accepted' ELSE ['pending', 'linted', 'needs_review', 'linted'][1 + event_id % 4] END AS after,
  ['pending', 'linted', 'needs_review', 'linted'][1 + event_id % 4] AS before, event_id % 5 = 0 AS error, user_id % 20 <> 0 AS known, event_id % 13 = 0 AS odd FROM events),
l AS (SELECT *, CASE WHEN NOT odd THEN lag(line) OVER (PARTITION BY target, odd ORDER BY line) END AS parent, row_number() OVER (PARTITION BY target ORDER BY line) AS i FROM e),
s(target, i, line, how, code, state, last, flawed) AS (SELECT target, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', NULL::VARCHAR, 'pending', CAST(NULL AS BIGINT), false FROM (SELECT DISTINCT target FROM l)
 UNION ALL SELECT l.target, l.i, l.line, CASE WHEN skip THEN 'skip' WHEN hold THEN 'hold' ELSE 'move' END, CASE WHEN skip THEN 'Q007' WHEN hold THEN 'Q005' END,
  CASE WHEN skip OR hold THEN s.state ELSE l.after END, CASE WHEN skip THEN s.last ELSE l.line END, CASE WHEN NOT skip AND NOT hold AND l.action = 'lint' THEN l.error ELSE s.flawed END
 FROM s JOIN l ON l.target = s.target AND l.i = s.i + 1, LATERAL (SELECT NOT l.known OR l.parent IS DISTINCT FROM s.last AS skip, l.before <> s.state OR NOT (CASE l.action WHEN 'lint' THEN s.state = 'pending'
   WHEN 'flag' THEN s.state IN ('pending', 'linted') WHEN 'accept' THEN s.state IN ('linted', 'needs_review') AND NOT s.flawed ELSE l.after = s.state END) AS hold))"""


def full_log(t: Tables):
    """(log, items): events as log entries with parents and states, of which many don't fit."""
    from pyspark.sql import Window

    kind, number = F.col("event_type"), F.col("event_id")
    guess = F.element_at(F.array(*map(F.lit, ("pending", "linted", "needs_review", "linted"))), (number % 4 + 1).cast("int"))
    rows = t.events.select(
        F.concat(F.lit("q:"), F.col("user_id").cast("string"), F.lit("-"), (number % 3).cast("string")).alias("target"), number.alias("line"), number.cast("string").alias("lid"),
        F.when(kind.isin("signup", "view"), "lint").when(kind == "click", "flag").when(kind == "purchase", "accept").otherwise("verdict").alias("action"), guess.alias("before"),
        F.when(kind == "signup", "linted").when(kind.isin("view", "click"), "needs_review").when(kind == "purchase", "accepted").otherwise(guess).alias("after"), (number % 5 == 0).alias("error"),
        (number % 13 == 0).alias("odd"), (F.col("user_id") % 20 != 0).alias("item"),
    )
    parent = F.lag("lid").over(Window.partitionBy("target", "odd").orderBy("line"))
    log = rows.withColumn("parent", F.when(~F.col("odd"), parent))
    return log, rows.where("item").select("target").distinct()


@query(f"WITH {JUDGE} SELECT target, line, how, code, state FROM s WHERE i > 0")
def queue_judged(spark, d):
    """Every log entry as the fold takes it."""
    return queue.judge(*full_log(Tables(spark, d))).select("target", "line", "how", "code", "state")


@query(f"WITH {JUDGE} SELECT target, arg_max(state, line) AS state FROM s WHERE i > 0 GROUP BY target")
def queue_states(spark, d):
    return queue.states(queue.judge(*full_log(Tables(spark, d))))


LABELS = (*queue.SEVERITIES, "correct", "correct", "odd")
SAID = f"({list(LABELS)})[1 + (event_id * 7) % {len(LABELS)}]"


def verdicts(t: Tables):
    said = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("event_id") * 7) % len(LABELS) + 1).cast("int"))
    target = F.concat(F.lit("q:"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 20).cast("string"))
    return t.events.where("event_type IN ('view', 'click')").select(target.alias("target"), said.alias("label"))


@query(f"""WITH v AS (SELECT 'q:' || user_id || '-' || event_id % 20 AS target, {SAID} AS label FROM events WHERE event_type IN ('view', 'click')),
o(label, severity) AS (SELECT unnest({list(queue.SEVERITIES)}), unnest(range({len(queue.SEVERITIES)})))
SELECT target, CASE WHEN EXISTS (SELECT 1 FROM v c WHERE c.target = t.target AND c.label = 'correct')
  AND NOT EXISTS (SELECT 1 FROM v c WHERE c.target = t.target AND c.label IN ('no_relation', 'wrong_relation')) THEN 'correct'
 ELSE (SELECT arg_min(o.label, o.severity) FROM v c JOIN o USING (label) WHERE c.target = t.target) END AS label
FROM (SELECT DISTINCT target FROM v) t""")
def verdict_aggregate(spark, d):
    return queue.aggregate_verdicts(verdicts(Tables(spark, d)))


@query(f"""SELECT i.target, coalesce(array_to_string(v.said, ','), '') AS verdicts FROM (SELECT DISTINCT 'q:' || user_id || '-' || event_id % 20 AS target FROM events) i LEFT JOIN
(SELECT 'q:' || user_id || '-' || event_id % 20 AS target, list_sort(list({SAID})) AS said FROM events WHERE event_type IN ('view', 'click') GROUP BY 1) v ON i.target = v.target""")
def verdict_attach(spark, d):
    t = Tables(spark, d)
    items = t.events.select(F.concat(F.lit("q:"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 20).cast("string")).alias("target")).distinct()
    said = verdicts(t).withColumnRenamed("label", "verdict")
    return queue.attach(items, said, ["target"]).withColumn("verdicts", F.array_join("verdicts", ","))


@query("""WITH i AS (SELECT 'c:' || conv_id AS target, 'core' || conv_id % 7 AS core_key, 'e' || turn AS evidence_id, md5(text) AS event_hash FROM conversations),
v AS (SELECT 'c:' || conv_id AS target, 'e' || (turn + conv_id % 2) AS evidence_id, 'correct' AS label, CASE WHEN turn = 1 THEN 'given' END AS core_key,
 CASE WHEN turn % 3 = 0 THEN 'kept' END AS event_hash FROM conversations)
SELECT v.target, v.evidence_id, v.label, coalesce(v.core_key, (SELECT any_value(i.core_key) FROM i WHERE i.target = v.target)) AS core_key, coalesce(v.event_hash, h.event_hash) AS event_hash
FROM v LEFT JOIN (SELECT DISTINCT target, evidence_id, event_hash FROM i) h ON h.target = v.target AND h.evidence_id = v.evidence_id""")
def verdict_complete(spark, d):
    rows = Tables(spark, d).conversations
    target = F.concat(F.lit("c:"), F.col("conv_id").cast("string")).alias("target")
    number = lambda c, p="e": F.concat(F.lit(p), c.cast("string"))
    items = rows.select(target, number(F.col("conv_id") % 7, "core").alias("core_key"), number(F.col("turn")).alias("evidence_id"), F.md5(F.col("text").cast("binary")).alias("event_hash"))
    said = rows.select(
        target, number(F.col("turn") + F.col("conv_id") % 2).alias("evidence_id"), F.lit("correct").alias("label"),
        F.when(F.col("turn") == 1, "given").alias("core_key"), F.when(F.col("turn") % 3 == 0, "kept").alias("event_hash"),
    )
    return queue.complete_verdicts(said, items)


@query("""SELECT 'conv:' || conv_id AS id, CASE max(CASE WHEN length(text) < 20 THEN 2 WHEN length(text) < 100 THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS outcome
FROM conversations GROUP BY conv_id""")
def lint_outcome(spark, d):
    size = F.length("text")
    severity = F.when(size < 20, "error").when(size < 100, "warning").otherwise("info")
    return validate.outcome(Tables(spark, d).conversations.select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("id"), severity.alias("severity")))
