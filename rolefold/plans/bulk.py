"""Bulk statement statistics and schema analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import width
from ..sources import dump, star
from .base import Tables, query

#: An order is an item, a line a statement of its part's tenth, with its supplier, flag and tax as qualifiers.
ST = """st AS (SELECT l_orderkey AS item, 'P' || l_partkey % 10 AS property, CASE WHEN l_linenumber = 7 THEN 'novalue' ELSE 'value' END AS kind,
 CASE l_returnflag WHEN 'A' THEN 'preferred' WHEN 'N' THEN 'normal' ELSE 'deprecated' END AS rank, l_shipdate, l_tax, l_suppkey FROM lineitem),
qu AS (SELECT *, 1 + (l_tax > 0.04)::INT + (l_suppkey % 3 = 0)::INT AS nq FROM st)"""


def rows(t: Tables):
    q = lambda name, kind="value": F.struct(F.lit(name).alias("property"), F.lit(kind).alias("kind"))
    flag = F.col("l_returnflag")
    held = F.array_compact(F.array(q("Pship"), F.when(F.col("l_tax") > 0.04, q("Ptax")), F.when(F.col("l_suppkey") % 3 == 0, q("Psup", "novalue"))))
    return t.lineitem.select(
        F.col("l_orderkey").alias("item"), F.concat(F.lit("P"), (F.col("l_partkey") % 10).cast("string")).alias("property"),
        F.when(F.col("l_linenumber") == 7, "novalue").otherwise("value").alias("kind"),
        F.when(flag == "A", "preferred").when(flag == "N", "normal").otherwise("deprecated").alias("rank"), held.alias("qualifiers"),
    )


@query(f"WITH {ST} SELECT rank, count(*) AS n FROM st GROUP BY rank")
def slice_rank_hist(spark, d):
    return dump.rank_histogram(rows(Tables(spark, d)))


@query(f"WITH {ST} SELECT CAST(2 + (kind <> 'novalue')::INT + (l_tax > 0.04)::INT AS INTEGER) AS arity, count(*) AS n FROM qu GROUP BY 1")
def slice_arity_hist(spark, d):
    return dump.arity_histogram(rows(Tables(spark, d)))


@query(f"WITH {ST} SELECT property, qualifier, count(*) AS n FROM (SELECT property, 'Pship' AS qualifier FROM st UNION ALL SELECT property, 'Ptax' FROM st WHERE l_tax > 0.04 UNION ALL SELECT property, 'Psup' FROM st WHERE l_suppkey % 3 = 0) GROUP BY 1, 2")
def slice_qualifier_pairs(spark, d):
    return dump.qualifier_pairs(rows(Tables(spark, d)))


@query(f"WITH {ST} SELECT property, count(*) AS n FROM (SELECT item, property FROM st WHERE l_tax > 0.04 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1")
def slice_time_series(spark, d):
    return dump.time_series(rows(Tables(spark, d)), "Ptax")


@query(f"WITH {ST} SELECT item, count(*) AS statements, count(DISTINCT property) AS properties, CAST(sum(nq) AS BIGINT) AS qualifiers, count(*) FILTER (rank = 'deprecated') AS deprecated FROM qu GROUP BY item")
def slice_index_rows(spark, d):
    return dump.index_rows(rows(Tables(spark, d)))


FULL = """fu AS (SELECT l_orderkey AS item, l_orderkey % 2 = 0 AS seed, 'P' || (l_partkey % 10 + 578) AS property, CASE l_linenumber WHEN 7 THEN 'novalue' WHEN 6 THEN 'somevalue' ELSE 'value' END AS kind,
  CASE WHEN l_partkey % 2 = 0 THEN 'item' ELSE 'quantity' END AS datatype, CASE l_returnflag WHEN 'A' THEN 'preferred' WHEN 'N' THEN 'normal' ELSE 'deprecated' END AS rank, l_linenumber % 3 AS refs,
  l_suppkey % 2 = 0 AS two, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS s, l_tax, l_suppkey FROM lineitem),
qs AS (SELECT s, 'P580' AS q, 'value' AS qk, 'time' AS qd, NULL::VARCHAR AS v FROM fu UNION ALL SELECT s, 'P580', 'value', 'time', NULL FROM fu WHERE two UNION ALL SELECT s, 'P582', CASE WHEN two THEN 'novalue' ELSE 'value' END, 'time', NULL FROM fu WHERE l_tax > 0.04
 UNION ALL SELECT s, 'P2241', CASE WHEN l_suppkey % 7 = 0 THEN 'somevalue' ELSE 'value' END, 'item', 'Q' || l_suppkey % 5 FROM fu WHERE l_suppkey % 3 = 0 UNION ALL SELECT s, 'P7452', 'value', 'item', 'Q' || l_suppkey % 4 FROM fu WHERE l_suppkey % 4 = 0),
qn AS (SELECT fu.*, (SELECT count(*) FROM qs WHERE qs.s = fu.s) AS nq, (SELECT count(DISTINCT q) FROM qs WHERE qs.s = fu.s) AS np, (SELECT count(*) FROM qs WHERE qs.s = fu.s AND qk <> 'novalue') AS na,
  (SELECT count(*) FROM qs WHERE qs.s = fu.s AND qk <> 'novalue' AND q NOT IN ('P580', 'P582')) AS nt, 1 + (kind <> 'novalue')::INT AS base FROM fu),
jo AS (SELECT fu.*, q, qk, qd, v FROM fu JOIN qs USING (s)),
sc AS (SELECT 'all' AS scope, false AS seeds UNION ALL SELECT 'seed', true)"""


def full_rows(t: Tables):
    """Order lines as statements with references, datatypes and qualifiers of all sorts."""
    no = F.lit(None).cast("string")
    q = lambda name, kind, datatype, value=no: F.struct(F.lit(name).alias("property"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(datatype).alias("datatype"), value.alias("value"))
    sup, two = F.col("l_suppkey"), F.col("l_suppkey") % 2 == 0
    held = F.array_compact(F.array(
        q("P580", "value", "time"), F.when(two, q("P580", "value", "time")), F.when(F.col("l_tax") > 0.04, q("P582", F.when(two, "novalue").otherwise("value"), "time")),
        F.when(sup % 3 == 0, q("P2241", F.when(sup % 7 == 0, "somevalue").otherwise("value"), "item", F.concat(F.lit("Q"), (sup % 5).cast("string")))),
        F.when(sup % 4 == 0, q("P7452", "value", "item", F.concat(F.lit("Q"), (sup % 4).cast("string")))),
    ))
    cited = F.array_repeat(F.when(two, F.array(F.lit("P854"), F.lit("P813"))).otherwise(F.array(F.lit("P854"))), (F.col("l_linenumber") % 3).cast("int"))
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return t.lineitem.select(
        F.col("l_orderkey").alias("item"), (F.col("l_orderkey") % 2 == 0).alias("seed"), F.concat(F.lit("P"), (F.col("l_partkey") % 10 + 578).cast("string")).alias("property"),
        F.when(line == 7, "novalue").when(line == 6, "somevalue").otherwise("value").alias("kind"), F.when(F.col("l_partkey") % 2 == 0, "item").otherwise("quantity").alias("datatype"),
        F.when(flag == "A", "preferred").when(flag == "N", "normal").otherwise("deprecated").alias("rank"), held.alias("qualifiers"), cited.alias("references"),
    )


def _stat(name: str, key: str, table: str = "qn", where: str = "true", n: str = "count(*)") -> str:
    return f"SELECT scope, '{name}' AS statistic, CAST({key} AS VARCHAR) AS key, CAST({n} AS BIGINT) AS n FROM {table}, sc WHERE (seed OR NOT seeds) AND {where} GROUP BY scope, 3"


def _reason(name: str, prop: str, rank: str) -> str:
    none = _stat(name, "'<none>'", "fu", f"rank = '{rank}' AND NOT EXISTS (SELECT 1 FROM qs WHERE qs.s = fu.s AND q = '{prop}')")
    return _stat(name, "CASE WHEN qk = 'value' THEN v ELSE '<' || qk || '>' END", "jo", f"rank = '{rank}' AND q = '{prop}'") + " UNION ALL " + none


@query(f"WITH {FULL}, x AS (" + " UNION ALL ".join([
    _stat("statements", "''"), _stat("by_rank", "rank"), _stat("main_snaktype", "kind"), _stat("main_datatype", "datatype"), _stat("qualified_statements", "''", where="nq > 0"),
    _stat("qualifier_snaks_hist", "nq"), _stat("qualifier_props_hist", "np"), _stat("arity_all_hist", "base + na"), _stat("arity_no_interval_hist", "base + nt"),
    _stat("referenced_statements", "''", where="refs > 0"), _stat("references", "''", n="sum(refs)"), _stat("qualifier_snaktype", "qk", "jo"), _stat("qualifier_datatype", "qd", "jo"), _stat("qualifier_property", "q", "jo"),
    _stat("reference_property", "'P854'", where="refs > 0", n="sum(refs)"), _stat("reference_property", "'P813'", where="refs > 0 AND two", n="sum(refs)"),
    _reason("deprecated_reasons", "P2241", "deprecated"), _reason("preferred_reasons", "P7452", "preferred"),
]) + ") SELECT * FROM x WHERE n > 0")
def slice_statistics(spark, d):
    """All counters of statements at once."""
    return dump.scope_statistics(full_rows(Tables(spark, d)))


_HAS = "(SELECT count(*) FROM qs WHERE qs.s = fu.s AND q IN ({}))"


@query(f"""WITH {FULL}, p AS (SELECT property, rank, refs, {_HAS.format("'P580', 'P582', 'P585'")} AS timed, {_HAS.format("'P580'")} AS starts, {_HAS.format("'P582'")} AS ends, {_HAS.format("property")} AS self, {_HAS.format("'P2241'")} AS low, {_HAS.format("'P7452'")} AS high FROM fu)
SELECT property, count(*) AS statements, count(*) AS qualified, count(*) FILTER (rank = 'deprecated') AS deprecated, count(*) FILTER (rank = 'preferred') AS preferred, count(*) FILTER (refs > 0) AS referenced,
 count(*) FILTER (timed > 0) AS timed, count(*) FILTER (starts > 1) AS multi_start, count(*) FILTER (ends > 1) AS multi_end, count(*) FILTER (timed > 1) AS multi_time, count(*) FILTER (self > 0) AS self_qualified,
 count(*) FILTER (low > 0 AND rank <> 'deprecated') AS low_reason_elsewhere, count(*) FILTER (high > 0 AND rank <> 'preferred') AS high_reason_elsewhere,
 CAST(sum(CASE WHEN rank <> 'deprecated' THEN low ELSE 0 END) AS BIGINT) AS low_reason_snaks_elsewhere, CAST(sum(CASE WHEN rank <> 'preferred' THEN high ELSE 0 END) AS BIGINT) AS high_reason_snaks_elsewhere FROM p GROUP BY property""")
def slice_property_statistics(spark, d):
    return dump.property_statistics(full_rows(Tables(spark, d)))


@query("SELECT least(len(string_split(html, '<p')) - 1, 20) AS size, count(*) AS n FROM pages GROUP BY 1")
def slice_sitelink_hist(spark, d):
    sizes = Tables(spark, d).pages.select((F.size(F.split("html", "<p")) - 1).cast("long").alias("k"))
    return dump.size_histogram(sizes, "k", 20)


def usage(spark):
    return spark.createDataFrame([(rel, role) for rel, roles in star.USAGE.items() for role, *_ in roles], "relation string, role string")


ROLES = ", ".join(f"('{rel}', '{role}')" for rel, roles in star.USAGE.items() for role, *_ in roles)


@query(f"SELECT relation, string_agg(role, ',' ORDER BY role) AS roles FROM (VALUES {ROLES}) u(relation, role) GROUP BY relation")
def schema_hypergraph(spark, d):
    return width.hypergraph(usage(spark)).withColumn("roles", F.array_join("roles", ","))


@query(f"""WITH u AS (SELECT DISTINCT relation, role FROM (VALUES {ROLES}) u(relation, role)), r AS (SELECT relation, count(*) AS n FROM u GROUP BY 1), g AS (SELECT role, count(*) AS n FROM u GROUP BY 1)
SELECT (SELECT max(n) FROM r) AS rank, (SELECT count(*) FROM r) AS relations, (SELECT max(n) FROM g) AS degree, (SELECT count(*) FROM g) AS roles,
(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM u a JOIN u b ON a.role = b.role AND a.relation < b.relation GROUP BY a.relation, b.relation)) AS intersection""")
def schema_degree_rank(spark, d):
    return width.statistics(usage(spark))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey // 4 AS relation, l_partkey AS role FROM lineitem WHERE l_suppkey % 40 = 0),
r(role, other) AS (SELECT DISTINCT role, role FROM u UNION SELECT r.role, b.role FROM r JOIN u a ON a.role = r.other JOIN u b ON a.relation = b.relation)
SELECT CAST(role AS VARCHAR) AS role, min(CAST(other AS VARCHAR)) AS component FROM r GROUP BY role""")
def schema_components(spark, d):
    """Parts as roles that the orders of four numbers connect."""
    rows = Tables(spark, d).lineitem.where("l_suppkey % 40 = 0")
    return width.components(rows.select(F.floor(F.col("l_orderkey") / 4).alias("relation"), F.col("l_partkey").cast("string").alias("role")))


def table_edges(t: Tables) -> width.Edges:
    """Tables as relations over their key columns."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return {n: frozenset(c.split("_", 1)[1] for c in getattr(t, n).columns if c.endswith("key")) for n in names}


@query()
def gyo_residue(spark, d):
    left = width.gyo(table_edges(Tables(spark, d)))
    found = [(n, ",".join(sorted(rs))) for n, rs in sorted(left.items())] or [("none", "")]
    return spark.createDataFrame(found, "relation string, roles string")


@query()
def acyclicity_class(spark, d):
    edges = table_edges(Tables(spark, d))
    sizes = width.widths(edges)
    return spark.createDataFrame([(width.classify(edges), int(sizes["tw"]), int(sizes["ghw"]), float(sizes["fhw"]))], "class string, tw int, ghw int, fhw double")
