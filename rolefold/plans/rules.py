"""Record and document rules on orders as facts that break them in many ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from .base import Tables, query

#: Roles of the relation ``goods``: least, most, kinds, entity types, ordered.
USAGE = (("item", 1, 3, ("entity", "novalue"), ("t0", "t1"), True), ("bonus", 0, 1, ("entity", "somevalue", "novalue"), (), False), ("note", 0, 2, ("literal", "unbound"), (), False), ("buyer", 1, 1, ("entity",), (), False))

GOODS = """f AS (SELECT 'g:' || o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE 'goods' END AS relation, CASE WHEN o_orderstatus = 'P' THEN 'goal' ELSE 'asserted' END AS status,
  o_orderkey % 17 AS s_lo, 12 AS e_hi, o_orderkey % 9 AS n_evidence, o_orderkey AS k FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag <> 'A' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem),
b AS (SELECT 'g:' || l_orderkey AS fact_id, 'b' || l_linenumber AS bid, CASE WHEN l_returnflag <> 'A' THEN 'item' WHEN l_orderkey % 5 = 0 THEN 'wrong' ELSE 'bonus' END AS role,
  CASE WHEN l_returnflag <> 'A' AND l_orderkey % 7 <> 0 THEN CAST(place AS INTEGER) WHEN l_returnflag = 'A' AND l_orderkey % 11 = 0 THEN 1 END AS position,
  CASE WHEN l_quantity > 47 THEN 'novalue' WHEN l_quantity < 3 THEN 'somevalue' ELSE 'entity' END AS value_kind, 'p:' || l_partkey % 20 AS ident, 't' || l_partkey % 3 AS type FROM l WHERE l_orderkey % 13 <> 0
 UNION ALL SELECT 'g:' || o_orderkey, 'c1', 'buyer', NULL, 'entity', 'c:' || o_custkey, NULL FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 13 <> 0
 UNION ALL SELECT 'g:' || o_orderkey, 'n' || i, 'note', NULL, 'unbound', '?x', NULL FROM orders, (SELECT unnest(range(0, 2)) AS i) WHERE o_orderkey % 10 = 3 AND o_orderkey % 13 <> 0 AND (i = 0 OR o_orderkey % 20 = 3)),
u(role, least, most, kinds, ordered) AS (VALUES ('item', 1, 3, ['entity', 'novalue'], true), ('bonus', 0, 1, ['entity', 'somevalue', 'novalue'], false), ('note', 0, 2, ['literal', 'unbound'], false), ('buyer', 1, 1, ['entity'], false)),
ok AS (SELECT * FROM f WHERE relation = 'goods' AND EXISTS (SELECT 1 FROM b WHERE fact_id = id)),
g AS (SELECT b.*, u.kinds, u.ordered FROM b JOIN ok ON b.fact_id = ok.id LEFT JOIN u USING (role)),
n AS (SELECT ok.id AS fact_id, ok.status, u.*, (SELECT count(*) FROM b WHERE b.fact_id = ok.id AND b.role = u.role) AS n,
  (SELECT count(*) FROM b WHERE b.fact_id = ok.id AND b.role = u.role AND value_kind = 'novalue') AS none,
  (SELECT count(*) FROM b WHERE b.fact_id = ok.id AND b.role = u.role AND value_kind <> 'unbound') AS fillers,
  (SELECT count(DISTINCT CASE WHEN value_kind = 'entity' THEN ident ELSE value_kind END) FROM b WHERE b.fact_id = ok.id AND b.role = u.role AND value_kind <> 'unbound') AS distinct_fillers,
  (SELECT count(DISTINCT position) FROM b WHERE b.fact_id = ok.id AND b.role = u.role AND position BETWEEN 1 AND (SELECT count(*) FROM b x WHERE x.fact_id = ok.id AND x.role = u.role)) AS placed FROM ok, u)"""


def goods(t: Tables):
    from pyspark.sql import Window

    key, name = F.col("o_orderkey"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    facts = t.orders.select(
        name("g:", "o_orderkey").alias("id"), F.when(key % 31 == 0, "unknown").otherwise("goods").alias("relation"),
        F.when(F.col("o_orderstatus") == "P", "goal").otherwise("asserted").alias("status"), (key % 17).alias("s_lo"), F.lit(12).alias("e_hi"), (key % 9).alias("n_evidence"),
    )
    extra, line = F.col("l_returnflag") == "A", F.col("l_orderkey")
    order = Window.partitionBy("l_orderkey", extra).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    place = F.row_number().over(order)
    lines = t.lineitem.withColumn("place", place).where(line % 13 != 0)
    many = F.col("l_quantity")
    empty = F.array().cast("array<string>")
    lines = lines.select(
        name("g:", "l_orderkey").alias("fact_id"), name("b", "l_linenumber").alias("bid"), F.when(~extra, "item").when(line % 5 == 0, "wrong").otherwise("bonus").alias("role"),
        F.when(~extra & (line % 7 != 0), F.col("place")).when(extra & (line % 11 == 0), 1).alias("position"),
        F.when(many > 47, "novalue").when(many < 3, "somevalue").otherwise("entity").alias("value_kind"), F.concat(F.lit("p:"), (F.col("l_partkey") % 20).cast("string")).alias("ident"),
        F.array(F.concat(F.lit("t"), (F.col("l_partkey") % 3).cast("string"))).alias("types"), F.lit(None).cast("string").alias("datatype"),
    )
    rest = lambda rows, bid, role, kind, ident: rows.select(name("g:", "o_orderkey").alias("fact_id"), bid.alias("bid"), F.lit(role).alias("role"), F.lit(None).cast("int").alias("position"), F.lit(kind).alias("value_kind"), ident.alias("ident"), empty.alias("types"), F.lit(None).cast("string").alias("datatype"))
    buyers = rest(t.orders.where((key % 6 != 0) & (key % 13 != 0)), F.lit("c1"), "buyer", "entity", name("c:", "o_custkey"))
    noted = t.orders.where((key % 10 == 3) & (key % 13 != 0)).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("i") == 0) | (key % 20 == 3))
    notes = rest(noted, name("n", "i"), "note", "unbound", F.lit("?x"))
    usage = t.spark.createDataFrame([("goods", r, a, z, list(kinds), list(types), [], o) for r, a, z, kinds, types, o in USAGE], "relation string, role string, least int, most int, kinds array<string>, types array<string>, datatypes array<string>, ordered boolean")
    return facts, lines.unionByName(buyers).unionByName(notes), usage


@query(f"""WITH {GOODS}
SELECT id, 'S001' AS code, relation AS detail FROM f WHERE relation <> 'goods'
UNION ALL SELECT id, 'S007', NULL FROM f WHERE relation = 'goods' AND NOT EXISTS (SELECT 1 FROM b WHERE fact_id = id)
UNION ALL SELECT fact_id, 'S002', bid FROM g WHERE kinds IS NULL
UNION ALL SELECT fact_id, 'S005', bid FROM g WHERE kinds IS NOT NULL AND ((value_kind <> 'unbound' AND NOT list_contains(kinds, value_kind)) OR (role = 'item' AND value_kind = 'entity' AND type NOT IN ('t0', 't1')))
UNION ALL SELECT fact_id, 'S015', bid FROM g WHERE NOT ordered AND position IS NOT NULL
UNION ALL SELECT fact_id, 'S025', bid FROM g GROUP BY fact_id, bid HAVING count(*) > 1
UNION ALL SELECT fact_id, CASE WHEN status = 'goal' THEN 'S018' ELSE 'S003' END, role FROM n WHERE n < least
UNION ALL SELECT fact_id, 'S004', role FROM n WHERE n > most
UNION ALL SELECT fact_id, 'S013', role FROM n WHERE none > 0 AND n > 1
UNION ALL SELECT fact_id, 'S014', role FROM n WHERE fillers > distinct_fillers AND NOT ordered
UNION ALL SELECT fact_id, 'S015', role FROM n WHERE ordered AND n > 0 AND placed <> n
UNION ALL SELECT id, 'S009', NULL FROM ok WHERE s_lo >= e_hi
UNION ALL SELECT id, 'S011', NULL FROM ok WHERE status = 'asserted' AND n_evidence = 0
UNION ALL SELECT fact_id, 'S019', NULL FROM g WHERE value_kind = 'unbound' GROUP BY fact_id HAVING count(*) > 1""")
def record_findings(spark, d):
    facts, bindings, usage = goods(Tables(spark, d))
    return rules.record_findings(facts, bindings, usage)


@query("""WITH e AS (SELECT 'o:' || o_orderkey AS fact_id, 'e' || i AS eid, 'b' || (1 + (o_orderkey + i) % 6) AS bid FROM orders, (SELECT unnest(range(0, 2)) AS i))
SELECT e.fact_id AS id, 'S022' AS code, eid || '/' || bid AS detail FROM e WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE 'o:' || l_orderkey = e.fact_id AND 'b' || l_linenumber = e.bid)""")
def support_findings(spark, d):
    t = Tables(spark, d)
    key = F.col("o_orderkey")
    evidence = t.orders.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(F.lit("o:"), key.cast("string")).alias("fact_id"), F.concat(F.lit("e"), F.col("i").cast("string")).alias("eid"),
        F.array(F.concat(F.lit("b"), (1 + (key + F.col("i")) % 6).cast("string"))).alias("supports"),
    )
    return rules.support_rules(evidence, t.lineitem.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("fact_id"), F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("bid")))


CONSTRAINTS = (("must_differ", ["R", "N"]), ("must_agree", ["A", "R"]), ("requires", ["A", "N"]), ("excludes", ["R", "A"]), ("at_least_one_of", ["R", "N"]))


@query("""WITH v AS (SELECT DISTINCT 'o:' || l_orderkey AS id, l_returnflag AS role, l_suppkey % 4 AS ident FROM lineitem), f AS (SELECT DISTINCT id FROM v),
h AS (SELECT id, EXISTS (SELECT 1 FROM v WHERE v.id = f.id AND role = 'R') AS r, EXISTS (SELECT 1 FROM v WHERE v.id = f.id AND role = 'A') AS a, EXISTS (SELECT 1 FROM v WHERE v.id = f.id AND role = 'N') AS n FROM f)
SELECT id, 'S024' AS code, 'must_differ R,N' AS detail FROM f WHERE EXISTS (SELECT 1 FROM v x JOIN v y ON x.id = y.id AND x.ident = y.ident WHERE x.id = f.id AND x.role = 'R' AND y.role = 'N')
UNION ALL SELECT id, 'S024', 'must_agree A,R' FROM f WHERE EXISTS (SELECT 1 FROM v x WHERE x.id = f.id AND x.role IN ('A', 'R') AND NOT EXISTS (SELECT 1 FROM v y WHERE y.id = x.id AND y.ident = x.ident AND y.role IN ('A', 'R') AND y.role <> x.role))
UNION ALL SELECT id, 'S024', 'requires A,N' FROM h WHERE a AND NOT n
UNION ALL SELECT id, 'S024', 'excludes R,A' FROM h WHERE r AND a
UNION ALL SELECT id, 'S024', 'at_least_one_of R,N' FROM h WHERE NOT (r OR n)""")
def relation_constraints(spark, d):
    """The five kinds of constraints on orders whose lines' suppliers fill the roles R, A and N."""
    rows = Tables(spark, d).lineitem.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("fact_id"), F.lit("sent").alias("relation"), F.col("l_returnflag").alias("role"), F.lit("entity").alias("value_kind"), (F.col("l_suppkey") % 4).cast("string").alias("ident")
    )
    table = spark.createDataFrame([("sent", kind, roles) for kind, roles in CONSTRAINTS], "relation string, kind string, roles array<string>")
    return rules.relation_constraints(rows, table)


@query("""WITH r AS (SELECT 'entity' AS kind, 'x:' || c_custkey AS id, 1 AS version, NULL AS status, CASE WHEN c_custkey % 8 = 0 THEN 'x:1' END AS redirect_to FROM customer
 UNION ALL SELECT 'hyperedge', CASE WHEN o_orderkey % 50 = 0 THEN 'x:' || o_custkey ELSE 'o:' || o_orderkey END, 1, CASE WHEN o_orderkey % 40 = 1 THEN 'candidate' ELSE 'asserted' END, NULL FROM orders
 UNION ALL SELECT 'hyperedge', 'o:' || o_orderkey, 1, 'asserted', NULL FROM orders WHERE o_orderkey % 60 = 7),
f AS (SELECT 'o:' || o_orderkey AS id, 'entity' AS kind, 'x:' || (o_custkey + (o_orderkey % 25 = 0)::INT * 1000000) AS ref FROM orders)
SELECT id, 'D001' AS code, '1' AS detail FROM r GROUP BY id, version HAVING count(*) > 1
UNION ALL SELECT id, 'D007', NULL FROM r GROUP BY id HAVING count(DISTINCT kind) > 1
UNION ALL SELECT id, 'D017', NULL FROM r WHERE status = 'candidate'
UNION ALL SELECT f.id, 'D020', ref FROM f JOIN r ON r.id = ref AND r.kind = 'entity' WHERE r.redirect_to IS NOT NULL
UNION ALL SELECT f.id, 'D002', ref FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = ref AND r.kind = 'entity')""")
def document_findings(spark, d):
    t = Tables(spark, d)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key, no = F.col("o_orderkey"), F.lit(None).cast("string")
    row = lambda df, kind, i, status, moved: df.select(F.lit(kind).alias("kind"), i.alias("id"), F.lit(1).alias("version"), status.alias("status"), moved.alias("redirect_to"))
    records = row(t.customer, "entity", name("x:", F.col("c_custkey")), no, F.when(F.col("c_custkey") % 8 == 0, "x:1"))
    records = records.unionByName(row(t.orders, "hyperedge", F.when(key % 50 == 0, name("x:", F.col("o_custkey"))).otherwise(name("o:", key)), F.when(key % 40 == 1, "candidate").otherwise("asserted"), no))
    records = records.unionByName(row(t.orders.where(key % 60 == 7), "hyperedge", name("o:", key), F.lit("asserted"), no))
    references = t.orders.select(name("o:", key).alias("id"), F.lit("entity").alias("kind"), name("x:", F.col("o_custkey") + (key % 25 == 0).cast("int") * 1000000).alias("ref"))
    return rules.document_findings(records, references)
