"""Orders and customers written as a container of records and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.values import quoted
from ..sources import container
from ..storage import shared_dir, sized
from .base import Tables, query


def lines_of(t: Tables):
    """JSON lines with a header, entities of customers (some missing), a hyperedge per order that binds its customer and perhaps
    the order before; some lines are broken in different ways."""
    key = F.col("o_orderkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    people = t.customer.where("c_custkey % 10 <> 0").select(F.concat(F.lit('{"kind": "entity", "types": ["customer"], "id": '), quoted(name("c:", F.col("c_custkey"))), F.lit("}")).alias("line"))
    before = F.when(key % 4 == 1, F.concat(F.lit(',{"bid": "b2", "role": "after", "value": {"fact": '), quoted(name("o:", key - 1)), F.lit("}}"))).otherwise("")
    amount = F.concat(F.lit(',{"bid": "b3", "role": "priority", "value": {"literal": {"value": '), quoted(F.col("o_orderpriority")), F.lit(', "datatype": "string"}}}'))
    whole = F.concat(
        F.lit('{"kind": "hyperedge", "id": '), quoted(name("o:", key)), F.lit(', "relation": "placed", "status": "asserted", "version": 1, "bindings": [{"bid": "b1", "role": "customer", "value": {"entity": '),
        quoted(name("c:", F.col("o_custkey"))), F.lit("}}"), before, amount, F.lit("]}"),
    )
    broken = F.when(key % 97 == 5, F.lit('{"kind": "hyperedge", "kind": 1}')).when(key % 97 == 6, F.lit('{"kind": "hyperedge", "x": 1e999}')).when(key % 97 == 7, F.lit('{"kind": "thing", "id": "t"}')).otherwise(whole)
    return people.union(t.orders.select(broken.alias("line")))


def stored_lines(spark, d):
    """The container, written in parts that are one text and parsed once; queries read its stored lines several times."""
    path = f"{shared_dir(spark)}/container-{uuid.uuid4().hex}"
    rows = lines_of(Tables(spark, d))
    head = spark.createDataFrame([('{"kind": "header", "format": "records/1.0", "content": "snapshot"}', 0)], "line string, n int")
    head.unionByName(rows.withColumn("n", F.lit(1))).orderBy("n", "line").select("line").write.text(path)
    return sized(container.read_lines(spark, path))


GOOD = """ok AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_orderkey % 97 NOT IN (5, 6, 7)), pe AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 10 <> 0)"""


@query("SELECT CASE o_orderkey % 97 WHEN 5 THEN 'J003' WHEN 6 THEN 'J004' ELSE 'C001' END AS code, count(*) AS lines FROM orders WHERE o_orderkey % 97 IN (5, 6, 7) GROUP BY 1")
def container_findings(spark, d):
    return container.findings(stored_lines(spark, d)).groupBy("code").agg(F.count("*").alias("lines"))


@query(f"WITH {GOOD} SELECT 'c:' || c AS id, 1 AS version, 'customer' AS types, NULL::VARCHAR AS redirect_to FROM pe")
def container_entities(spark, d):
    rows = container.entities(container.records(stored_lines(spark, d)))
    return rows.select("id", "version", F.array_join("types", ",").alias("types"), "redirect_to")


@query(f"""WITH {GOOD} SELECT 'o:' || k AS fact_id, 'b1' AS bid, 'customer' AS role, 'entity' AS value_kind, 'c:' || c AS ident FROM ok
UNION ALL SELECT 'o:' || k, 'b2', 'after', 'fact', 'o:' || (k - 1) FROM ok WHERE k % 4 = 1 UNION ALL SELECT 'o:' || k, 'b3', 'priority', 'literal', '{{"datatype":"string","value":"' || p || '"}}' FROM ok""")
def container_bindings(spark, d):
    return container.bindings(container.records(stored_lines(spark, d))).select("fact_id", "bid", "role", "value_kind", "ident")


@query(f"""WITH RECURSIVE {GOOD}, bad AS (SELECT k FROM ok WHERE c NOT IN (SELECT c FROM pe) OR (k % 4 = 1 AND k - 1 NOT IN (SELECT k FROM ok))
 UNION SELECT ok.k FROM ok JOIN bad ON ok.k % 4 = 1 AND ok.k - 1 = bad.k) SELECT 'o:' || k AS id FROM ok WHERE k NOT IN (SELECT k FROM bad)""")
def container_load_skip(spark, d):
    """What can be loaded: orders whose customer and order before are there, and theirs in turn."""
    return container.load(container.records(stored_lines(spark, d)), "skip").where("kind = 'hyperedge'").select("id")
