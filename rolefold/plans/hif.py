"""Interchange documents of orders as facts, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import hif
from ..storage import shared_dir
from .base import PLACED, PLACED_B, Tables, query


@query(f"""WITH {PLACED} SELECT id AS edge, '{{"attrs":{{"rank":"' || rank || '","relation":"placed","status":"' || status || '","visibility":"visible"}},"edge":"' || id || '"}}' AS item FROM placed""")
def hif_edges(spark, d):
    return hif.edges(Tables(spark, d).facts("placed"))


@query(f"WITH {PLACED}, {PLACED_B} SELECT fact_id, 'placed' AS relation, bid, role, value_kind, ident FROM binding")
def hif_round_trip(spark, d):
    """What is read from the document that was written."""
    t = Tables(spark, d)
    path = f"{shared_dir(spark)}/hif-{uuid.uuid4().hex}"
    hif.write(t.facts("placed"), t.bindings("placed"), path)
    return hif.Read(spark, path).bindings()


@query("""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'o:' || o_orderkey WHEN 1 THEN 'gone:' || o_orderkey ELSE 'o:' || o_orderkey END AS id, CASE o_orderkey % 3 WHEN 0 THEN 'S007' WHEN 1 THEN 'D002' ELSE 'P016' END AS code FROM orders""")
def hif_findings(spark, d):
    """Orders as edges of a document in which each lacks something: incidences, a node, or a role."""
    key = F.col("o_orderkey")
    name = lambda p: F.concat(F.lit(p), key.cast("string"))
    orders = Tables(spark, d).orders
    read = hif.Read.__new__(hif.Read)
    read.nodes = orders.select(name("n:").alias("node"), F.create_map(F.lit("kind"), F.lit("entity")).alias("attrs"))
    read.edges = orders.select(name("o:").alias("edge"), F.create_map(F.lit("relation"), F.lit("placed")).alias("attrs"))
    role = F.when(key % 3 == 2, F.create_map(F.lit("bid"), F.lit("b1"))).otherwise(F.create_map(F.lit("role"), F.lit("order")))
    read.incidences = orders.where(key % 3 != 0).select(name("o:").alias("edge"), F.when(key % 3 == 1, name("gone:")).otherwise(name("n:")).alias("node"), role.alias("attrs"))
    return read.findings()
