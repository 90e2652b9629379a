"""Interchange: nodes, edges and incidences, triples, canonical lines, closed slices, containers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import iri_decode, iri_encode, quoted
from ..storage import cut


def node_id(kind: Column, ident: Column) -> Column:
    """Entities and facts are their ids; literals get one derived from their text."""
    derived = F.concat(F.lit("_:lit:"), F.substring(F.sha2(F.concat(F.lit("literal\n"), quoted(ident)), 256), 1, 32))
    return F.when(kind == "literal", derived).otherwise(ident)


def literal_nodes(bindings: DataFrame) -> DataFrame:
    rows = bindings.where("value_kind = 'literal'").select("ident").distinct()
    return rows.select("ident", node_id(F.lit("literal"), F.col("ident")).alias("node"))


def nodes(bindings: DataFrame) -> DataFrame:
    return bindings.select(node_id(F.col("value_kind"), F.col("ident")).alias("node"), F.col("value_kind").alias("kind")).distinct()


def incidences(bindings: DataFrame) -> DataFrame:
    attrs = F.concat(F.lit('{"role":'), quoted(F.col("role")), F.lit("}"))
    return bindings.select(F.col("fact_id").alias("edge"), node_id(F.col("value_kind"), F.col("ident")).alias("node"), F.lit(1).alias("weight"), attrs.alias("attrs"))


def from_incidences(rows: DataFrame, edge_relation: DataFrame) -> DataFrame:
    """Bindings again: roles from the attributes, relations from the edges (edge, relation)."""
    role = F.get_json_object("attrs", "$.role")
    return rows.join(edge_relation, "edge").select(F.col("edge").alias("fact_id"), "relation", role.alias("role"), F.col("node").alias("ident"))


def triples(bindings: DataFrame) -> DataFrame:
    """A type triple per fact and one triple per binding; names are percent-encoded, literals quoted as in JSON."""
    iri = lambda x: F.concat(F.lit("urn:"), iri_encode(x))
    value = F.when(F.col("value_kind") == "literal", quoted(F.col("ident"))).otherwise(iri(F.col("ident")))
    typed = bindings.select(iri(F.col("fact_id")).alias("s"), F.lit("rdf:type").alias("p"), iri(F.col("relation")).alias("o")).distinct()
    return typed.union(bindings.select(iri(F.col("fact_id")), F.concat(iri(F.col("relation")), F.lit("/"), iri_encode(F.col("role"))), value))


def from_triples(rows: DataFrame) -> DataFrame:
    """(fact_id, relation, role, value_kind, ident): the inverse of triples()."""
    literal = F.col("o").startswith('"')
    name = lambda c: iri_decode(F.expr(f"substr({c}, 5)"))
    parts = F.split(F.expr("substr(p, 5)"), "/")
    path = [F.get(parts, F.lit(i)) for i in (0, 1)]
    plain = F.get_json_object(F.concat(F.lit("["), "o", F.lit("]")), "$[0]")
    return rows.where("p <> 'rdf:type'").select(
        name("s").alias("fact_id"), iri_decode(path[0]).alias("relation"), iri_decode(path[1]).alias("role"), F.when(literal, "literal").otherwise("entity").alias("value_kind"),
        F.when(literal, plain).otherwise(name("o")).alias("ident"),
    )


def canonical_lines(bindings: DataFrame) -> DataFrame:
    """(id, line): one canonical JSON record per fact, keys and bindings in order."""
    value = F.concat(F.when(F.col("value_kind") == "literal", '{"literal":').otherwise('{"entity":'), quoted(F.col("ident")), F.lit("}"))
    text = F.concat(F.lit('{"bid":'), quoted(F.col("bid")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"value":'), value, F.lit("}"))
    rows = bindings.groupBy("fact_id", "relation").agg(F.array_sort(F.collect_list(F.struct("role", "ident", text.alias("text")))).alias("bs"))
    parts = F.array_join(F.transform("bs", lambda b: b["text"]), ",")
    line = F.concat(F.lit('{"bindings":['), parts, F.lit('],"id":'), quoted(F.col("fact_id")), F.lit(',"kind":"hyperedge","relation":'), quoted(F.col("relation")), F.lit("}"))
    return rows.select(F.col("fact_id").alias("id"), line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A text container in id order; the committer makes it appear whole."""
    lines.orderBy("id").select("line").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Bindings of a text container; lines that aren't records are left out."""
    binding = "struct<bid:string,role:string,value:struct<entity:string,literal:string>>"
    record = F.from_json("value", f"id string, kind string, relation string, bindings array<{binding}>")
    rows = spark.read.text(path).select(record.alias("r")).where("r.kind = 'hyperedge'").select("r.id", "r.relation", F.explode("r.bindings").alias("b"))
    kind = F.when(F.col("b.value.literal").isNotNull(), "literal").otherwise("entity")
    return rows.select(F.col("id").alias("fact_id"), "relation", "b.bid", "b.role", kind.alias("value_kind"), F.coalesce("b.value.entity", "b.value.literal").alias("ident"))


def closed_slice(bindings: DataFrame, relations: Sequence[str]) -> DataFrame:
    """(kind, id): facts of some relations, facts they bind (to any depth), and all entities these bind."""
    facts = bindings.where(F.col("relation").isin(*relations)).select(F.col("fact_id").alias("id")).distinct()
    links = bindings.where("value_kind = 'fact'").select("fact_id", "ident")
    fresh = facts
    for depth in count(1):
        fresh = cut(links.join(fresh, F.col("fact_id") == F.col("id"), "left_semi").select(F.col("ident").alias("id")).distinct().join(facts, "id", "left_anti"))
        if fresh.isEmpty():
            break
        facts = facts.union(fresh)
        if depth % 16 == 0:
            facts = cut(facts)
    bound = bindings.where("value_kind = 'entity'").join(facts, F.col("fact_id") == F.col("id"), "left_semi")
    return facts.select(F.lit("fact").alias("kind"), "id").union(bound.select(F.lit("entity"), "ident").distinct())
