"""Hypergraph interchange documents: nodes, edges and incidences in one JSON object, written and read as tables.

The parts are written in canonical order, one item a line, so a document of any
size is made by sorted tasks and never held in one place; such a document is read by its
lines as well.  Any other JSON text is split as a whole, by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import quoted
from .exchange import node_id

NODE = "struct<node:string,weight:double,attrs:map<string,string>>"
EDGE = "struct<edge:string,weight:double,attrs:map<string,string>>"
INCIDENCE = "struct<edge:string,node:string,weight:double,direction:string,attrs:map<string,string>>"
#: (part, line): what stands around the items of a document that is written here
FRAME = ((0, '{"network-type":"undirected","metadata":{"profile":"role-aware"},"nodes":['), (2, '],"edges":['), (4, '],"incidences":['), (6, "]}"))


def _object(pairs: list[tuple[str, Column]]) -> Column:
    """A canonical JSON object of the given keys, in order, without those that are null."""
    cells = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in pairs)))
    return F.concat(F.lit("{"), F.array_join(cells, ","), F.lit("}"))


def nodes(bindings: DataFrame) -> DataFrame:
    """(node, item): every bound entity, fact and literal once; a literal's node carries its value."""
    rows = bindings.select(node_id(F.col("value_kind"), F.col("ident")).alias("node"), "value_kind", F.when(F.col("value_kind") == "literal", quoted(F.col("ident"))).alias("value")).distinct()
    attrs = _object([("kind", quoted(F.col("value_kind"))), ("value", F.col("value"))])
    return rows.select("node", _object([("attrs", attrs), ("node", quoted(F.col("node")))]).alias("item"))


def edges(facts: DataFrame) -> DataFrame:
    """(edge, item): every fact with its relation and axes."""
    attrs = _object([(c, quoted(F.col(c))) for c in ("rank", "relation", "status", "visibility")])
    return facts.select(F.col("id").alias("edge"), _object([("attrs", attrs), ("edge", quoted(F.col("id")))]).alias("item"))


def incidences(bindings: DataFrame) -> DataFrame:
    """(edge, bid, item): a binding each."""
    attrs = _object([("bid", quoted(F.col("bid"))), ("role", quoted(F.col("role")))])
    item = _object([("attrs", attrs), ("edge", quoted(F.col("fact_id"))), ("node", quoted(node_id(F.col("value_kind"), F.col("ident"))))])
    return bindings.select(F.col("fact_id").alias("edge"), "bid", item.alias("item"))


def document(facts: DataFrame, bindings: DataFrame) -> DataFrame:
    """(line) of one JSON document, in order; literal nodes come after named ones."""
    spark = facts.sparkSession
    part = lambda rows, number, first, second: rows.select(F.lit(number).alias("part"), first.alias("a"), second.alias("b"), "item")
    literal = F.col("node").startswith("_:").cast("string")
    items = part(nodes(bindings), 1, literal, F.col("node")).union(part(edges(facts), 3, F.col("edge"), F.lit(""))).union(part(incidences(bindings), 5, F.col("edge"), F.col("bid")))
    last = items.groupBy("part").agg(F.max(F.struct("a", "b")).alias("last"))  # three rows
    lines = items.join(F.broadcast(last), "part", "left").select("part", "a", "b", F.concat("item", F.when(F.struct("a", "b") == F.col("last"), "").otherwise(",")).alias("line"))
    around = spark.createDataFrame([(n, "", "", text) for n, text in FRAME], "part int, a string, b string, line string")
    return lines.unionByName(around).orderBy("part", "a", "b").select("line")


def write(facts: DataFrame, bindings: DataFrame, path: str) -> None:
    """The document as a folder of text parts; their concatenation is the JSON object."""
    document(facts, bindings).write.text(path)


class Read:
    """A document's tables, and what is wrong with it."""

    def __init__(self, spark: SparkSession, path: str):
        lines = spark.read.text(path)
        # a node's item has no edge, an edge's has no node
        item = F.from_json(F.regexp_replace("value", ",$", ""), INCIDENCE)
        rows = lines.select("value", F.col("value").isin(*(text for _, text in FRAME)).alias("frame"), item.alias("x"))
        known = F.col("x.node").isNotNull() | F.col("x.edge").isNotNull()
        seen = rows.agg(F.count_if("frame").alias("frame"), F.count_if(~F.col("frame") & ~F.coalesce(known, F.lit(False))).alias("odd")).first()
        if seen["frame"] == len(FRAME) and not seen["odd"]:
            rows = rows.where(~F.col("frame")).select("x.*")
            self.nodes = rows.where("edge IS NULL").select("node", "weight", "attrs")
            self.edges = rows.where("node IS NULL").select("edge", "weight", "attrs")
            self.incidences = rows.where("edge IS NOT NULL AND node IS NOT NULL")
            return
        # the parts in the order of their names are one text
        parts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
        text = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda x: x["value"]), "").alias("text"))
        doc = text.select(F.from_json("text", f"nodes array<{NODE}>, edges array<{EDGE}>, incidences array<{INCIDENCE}>").alias("d"))
        one = lambda name: doc.select(F.explode(f"d.{name}").alias("x")).select("x.*")
        self.nodes, self.edges, self.incidences = one("nodes"), one("edges"), one("incidences")

    def findings(self) -> DataFrame:
        """(id, code): D001 a node or edge twice, D002 an incidence with a node that isn't there, P017 with an edge that
        isn't, P016 without a role, S007 an edge without incidences."""
        twice = lambda rows, c: rows.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("D001").alias("code"))
        no_node = self.incidences.join(self.nodes.select("node"), "node", "left_anti").select(F.col("node").alias("id"), F.lit("D002").alias("code"))
        no_edge = self.incidences.join(self.edges.select("edge"), "edge", "left_anti").select(F.col("edge").alias("id"), F.lit("P017").alias("code"))
        bare = self.incidences.where(F.col("attrs")["role"].isNull()).select(F.col("edge").alias("id"), F.lit("P016").alias("code"))
        idle = self.edges.join(self.incidences.select("edge"), "edge", "left_anti").select(F.col("edge").alias("id"), F.lit("S007").alias("code"))
        return twice(self.nodes, "node").union(twice(self.edges, "edge")).union(no_node).union(no_edge).union(bare).union(idle)

    def facts(self) -> DataFrame:
        a = F.col("attrs")
        return self.edges.select(F.col("edge").alias("id"), a["relation"].alias("relation"), a["status"].alias("status"), a["rank"].alias("rank"), a["visibility"].alias("visibility"))

    def bindings(self) -> DataFrame:
        """The bindings that were written; a literal is read from its node."""
        kinds = self.nodes.select("node", F.col("attrs")["kind"].alias("value_kind"), F.col("attrs")["value"].alias("value"))
        rows = self.incidences.join(kinds, "node").join(self.edges.select("edge", F.col("attrs")["relation"].alias("relation")), "edge")
        return rows.select(F.col("edge").alias("fact_id"), "relation", F.col("attrs")["bid"].alias("bid"), F.col("attrs")["role"].alias("role"), "value_kind", F.coalesce("value", "node").alias("ident"))
