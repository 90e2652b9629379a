"""Registration, and the fact tables that queries share; their SQL twins are common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import star, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPEN = 4611686018427387904


def query(sql: str | None = None):
    """Register a function under its name; sql gives the same rows in another engine."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


class Tables:
    """Fact, binding and plain tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return star.read(self.spark, self.dir, name)

    def wide(self, relation: str) -> DataFrame:
        return star.wide(self.spark, self.dir, relation)

    def facts(self, relation: str) -> DataFrame:
        return star.facts(self.wide(relation), relation)

    def bindings(self, relation: str) -> DataFrame:
        return star.bindings(self.wide(relation), relation)

    def store(self, relation: str) -> store.Store:
        return store.stored(self.spark, self.dir, relation)


def ingest(spark: SparkSession, sf_dir: str) -> None:
    """Write the stores that reads use, before they are asked for."""
    for relation in ("placed", "supplied"):
        store.stored(spark, sf_dir, relation).write()


def jdn(ts: str) -> str:
    return f"((date_diff('day', DATE '1970-01-01', CAST({ts} AS DATE)) + 2440588) * 86400)"


PLACED = f"""
placed0 AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders),
placed AS (SELECT 'placed:' || o_orderkey AS id, 'c:' || o_custkey AS customer, 'o:' || o_orderkey AS ord, o_orderpriority AS priority,
  strftime(o_orderdate, '%Y-%m-%d') AS start_day, strftime(nxt, '%Y-%m-%d') AS end_day,
  CASE WHEN o_orderstatus = 'O' THEN 'disputed' ELSE 'asserted' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'deprecated' ELSE 'normal' END AS rank,
  CAST({jdn("o_orderdate")} AS BIGINT) AS s_lo, CAST({jdn("o_orderdate")} + 86400 AS BIGINT) AS s_hi,
  CAST(coalesce({jdn("nxt")}, {OPEN}) AS BIGINT) AS e_lo, CAST(coalesce({jdn("nxt")} + 86400, {OPEN}) AS BIGINT) AS e_hi,
  CAST(4 + (nxt IS NOT NULL)::INT AS INTEGER) AS n_bindings
  FROM placed0)"""
SUPPLIED = f"""
supplied AS (SELECT 'supplied:' || sha256(concat_ws('|', 'o:' || l_orderkey, 'p:' || l_partkey, 's:' || l_suppkey, l_linenumber,
    CAST(l_quantity AS DECIMAL(18,2)), CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_discount AS DECIMAL(18,2)), CAST(l_tax AS DECIMAL(18,2)),
    l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS id,
  'o:' || l_orderkey AS ord, 'p:' || l_partkey AS part, 's:' || l_suppkey AS supplier, CAST(l_linenumber AS VARCHAR) AS line,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS quantity, l_returnflag AS returnflag, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
  CASE WHEN l_linestatus = 'O' THEN 'disputed' ELSE 'asserted' END AS status,
  CAST({jdn("l_shipdate")} AS BIGINT) AS s_lo, CAST({jdn("l_shipdate")} + 86400 AS BIGINT) AS s_hi FROM lineitem)"""
PLACED_B = """
binding AS (SELECT id AS fact_id, 'b' || i AS bid, role, slot, value_kind, ident FROM (
  SELECT id, 1 AS i, 'customer' AS role, 'core' AS slot, 'entity' AS value_kind, customer AS ident FROM placed
  UNION ALL SELECT id, 2, 'order', 'core', 'entity', ord FROM placed
  UNION ALL SELECT id, 3, 'priority', 'qualifier', 'literal', priority FROM placed
  UNION ALL SELECT id, 4, 'start', 'time', 'literal', start_day FROM placed
  UNION ALL SELECT id, 5, 'end', 'time', 'literal', end_day FROM placed) WHERE ident IS NOT NULL)"""
SUPPLIED_B = """
binding AS (SELECT id AS fact_id, 'b' || i AS bid, role, slot, value_kind, ident FROM (
  SELECT id, 1 AS i, 'order' AS role, 'core' AS slot, 'entity' AS value_kind, ord AS ident FROM supplied
  UNION ALL SELECT id, 2, 'part', 'core', 'entity', part FROM supplied
  UNION ALL SELECT id, 3, 'supplier', 'core', 'entity', supplier FROM supplied
  UNION ALL SELECT id, 4, 'line', 'core', 'literal', line FROM supplied
  UNION ALL SELECT id, 5, 'quantity', 'qualifier', 'literal', quantity FROM supplied
  UNION ALL SELECT id, 6, 'returnflag', 'qualifier', 'literal', returnflag FROM supplied
  UNION ALL SELECT id, 7, 'shipped', 'time', 'literal', shipped FROM supplied) WHERE ident IS NOT NULL)"""
