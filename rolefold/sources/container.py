"""Containers of the record model: JSON lines, or one JSON document, of a header and its records.

A line is parsed strictly once, at ingest; from then on records are tables:
entities, headers, bindings and evidence.  Lines are numbered over a whole file in
blocks, so a large file is read by many tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsontext import strict_parse
from ..storage import cut, sized

VALUE = "struct<entity:string,fact:string,literal:string,special:string,unbound:string>"
RECORD = (
    "kind string, id string, version int, recorded_at string, types array<string>, label string, redirect_to string, relation string, status string, status_ref string, rank string, "
    f"rank_reason array<string>, visibility string, reason string, bindings array<struct<bid:string,role:string,position:int,direction:string,value:{VALUE}>>, "
    "evidence array<struct<id:string,type:string,mode:string,supports:array<string>,event_hash:string,source:struct<doc_id:string>>>"
)
HEADER = "kind string, format string, document_id string, content string, complete boolean, schema struct<id:string,version:string,sha256:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, canonical, code) of a JSON-lines container: n counts the lines that aren't blank, 0 is the header; code says why a line is refused.

    The parts of a folder, in the order of their names, are one text.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path, lineSep="\n").select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).where(F.trim(F.regexp_replace("value", r"\r$", "")) != "")
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("size"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = sizes.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    placed = rows.withColumn("i", inside).join(starts, ["file", "block"])
    parsed = strict_parse(F.regexp_replace("value", r"\r$", ""))
    return placed.select((F.col("start") + F.col("i")).alias("n"), parsed.alias("p")).select("n", "p.canonical", "p.code")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The same of a container that is one JSON document with ``header`` and ``records``."""
    whole = spark.read.text(path, wholetext=True).select(strict_parse(F.col("value")).alias("p"))
    parts = F.from_json("p.canonical", "header string, records array<string>")
    rows = whole.select(F.col("p.code").alias("code"), F.concat(F.array(parts["header"]), parts["records"]).alias("all"))
    good = rows.where("code IS NULL").select(F.posexplode("all").alias("n", "canonical"), F.lit(None).cast("string").alias("code"))
    return good.union(rows.where("code IS NOT NULL").select(F.lit(0), F.lit(None).cast("string"), "code"))


def findings(lines: DataFrame, formats: str = r"^[a-z-]+/1\.[0-9]+$") -> DataFrame:
    """(path, code): lines that strict parsing refuses, a header of another format (V001), and records whose shape no rule can read.

    C001 an unknown kind, C003 no id, C010 a hyperedge without relation or status,
    or with a binding that lacks bid, role or exactly one value.
    """
    path = F.concat(F.lit("/lines/"), F.col("n").cast("string"))
    refused = lines.where("code IS NOT NULL").select(path.alias("path"), "code")
    head = F.from_json("canonical", HEADER)
    gate = lines.where("n = 0 AND code IS NULL").where(~F.coalesce(head["format"].rlike(formats), F.lit(False))).select(path.alias("path"), F.lit("V001").alias("code"))
    r = F.from_json("canonical", RECORD)
    values = lambda b: F.size(F.array_compact(F.array(*(b["value"][k] for k in ("entity", "fact", "literal", "special", "unbound")))))
    broken = F.exists(F.coalesce(r["bindings"], F.array().cast(r_bindings())), lambda b: b["bid"].isNull() | b["role"].isNull() | b["value"].isNull() | (values(b) != 1))
    code = (
        F.when(~F.coalesce(r["kind"].isin("entity", "hyperedge"), F.lit(False)), "C001")
        .when(r["id"].isNull(), "C003")
        .when((r["kind"] == "hyperedge") & (r["relation"].isNull() | r["status"].isNull() | r["bindings"].isNull() | broken), "C010")
    )
    shape = lines.where("n > 0 AND code IS NULL").select(path.alias("path"), code.alias("code")).where("code IS NOT NULL")
    return refused.union(gate).union(shape)


def r_bindings() -> str:
    return f"array<struct<bid:string,role:string,position:int,direction:string,value:{VALUE}>>"


def header(lines: DataFrame) -> DataFrame:
    return lines.where("n = 0 AND code IS NULL").select(F.from_json("canonical", HEADER).alias("h")).select("h.*")


def records(lines: DataFrame) -> DataFrame:
    """Records as columns, beside their canonical text; refused lines are in ``findings``."""
    return lines.where("n > 0 AND code IS NULL").select("n", "canonical", F.from_json("canonical", RECORD).alias("r")).select("n", "canonical", "r.*").withColumn("version", F.coalesce("version", F.lit(1)))


def entities(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'entity'").select("id", "version", "recorded_at", F.coalesce("types", F.array().cast("array<string>")).alias("types"), "label", "redirect_to")


def headers(rows: DataFrame) -> DataFrame:
    """Hyperedges without their bindings; what a record leaves out has its default."""
    return rows.where("kind = 'hyperedge'").select(
        "id", "version", "recorded_at", "relation", "status", "status_ref", F.coalesce("rank", F.lit("normal")).alias("rank"), "rank_reason",
        F.coalesce("visibility", F.lit("visible")).alias("visibility"), "reason", F.size("bindings").alias("n_bindings"),
    )


def bindings(rows: DataFrame) -> DataFrame:
    """(fact_id, version, relation, bid, role, position, direction, value_kind, ident): a literal's identity is its canonical text."""
    b = rows.where("kind = 'hyperedge'").select(F.col("id").alias("fact_id"), "version", "relation", F.explode("bindings").alias("b"))
    v = F.col("b.value")
    kind = F.when(v["entity"].isNotNull(), "entity").when(v["fact"].isNotNull(), "fact").when(v["literal"].isNotNull(), "literal").when(v["special"].isNotNull(), v["special"]).otherwise("unbound")
    ident = F.coalesce(v["entity"], v["fact"], v["literal"], v["special"], v["unbound"])
    return b.select("fact_id", "version", "relation", "b.bid", "b.role", "b.position", "b.direction", kind.alias("value_kind"), ident.alias("ident"))


def evidence(rows: DataFrame) -> DataFrame:
    e = rows.where("kind = 'hyperedge' AND evidence IS NOT NULL").select(F.col("id").alias("fact_id"), "version", F.explode("evidence").alias("e"))
    return e.select("fact_id", "version", F.col("e.id").alias("eid"), "e.type", "e.mode", "e.supports", "e.event_hash", F.col("e.source.doc_id").alias("doc_id"))


def unloadable(rows: DataFrame) -> DataFrame:
    """(id) of hyperedges that bind, or point to, what isn't there, and of all that need them in turn."""
    facts = rows.where("kind = 'hyperedge'").select("id").distinct()
    bound = bindings(rows)
    there = rows.select(F.col("kind"), F.col("id").alias("ref")).distinct()
    needs = bound.where("value_kind IN ('entity', 'fact')").select(F.col("fact_id").alias("id"), F.when(F.col("value_kind") == "fact", "hyperedge").otherwise("entity").alias("kind"), F.col("ident").alias("ref"))
    needs = needs.union(rows.where("kind = 'hyperedge' AND status_ref IS NOT NULL").select("id", F.lit("hyperedge"), "status_ref")).distinct()
    there, needs = sized(there), sized(needs)  # every round reads them
    gone = cut(needs.join(there, ["kind", "ref"], "left_anti").select("id").distinct())
    fresh = gone
    while not fresh.isEmpty():
        more = needs.where("kind = 'hyperedge'").join(fresh.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
        fresh = cut(more.join(gone, "id", "left_anti"))
        gone = cut(gone.union(fresh))
    return facts.join(gone, "id", "left_semi")


def load(rows: DataFrame, on_missing: str = "raise") -> DataFrame:
    """The records that a store takes in: all, or, with ``skip``, those that need nothing that isn't there."""
    if on_missing not in ("raise", "skip"):
        raise ValueError(f"on_missing is raise or skip, not {on_missing!r}")
    gone = unloadable(rows)
    if on_missing == "raise":
        if first := gone.limit(1).collect():
            raise ValueError(f"{first[0]['id']} needs a record that isn't there")
        return rows
    return rows.join(gone.withColumn("kind", F.lit("hyperedge")), ["kind", "id"], "left_anti")


def canonical_lines(lines: DataFrame) -> DataFrame:
    """(line) in canonical order: the header, then records by kind, id and version."""
    r = F.from_json("canonical", "kind string, id string, version int")
    first = F.when(F.col("n") == 0, 0).otherwise(1)
    good = lines.where("code IS NULL").select(first.alias("first"), r["kind"].alias("kind"), r["id"].alias("id"), F.coalesce(r["version"], F.lit(1)).alias("version"), F.col("canonical").alias("line"))
    return good.orderBy("first", "kind", "id", "version").select("line")


def write(lines: DataFrame, path: str) -> None:
    """A JSON-lines container in canonical order; the committer makes it appear whole."""
    canonical_lines(lines).write.text(path)


def sha256(lines: DataFrame) -> str:
    """The digest of the canonical text, whose parts pass the driver one after another."""
    out = hashlib.sha256()
    for row in canonical_lines(lines).toLocalIterator():
        out.update(row["line"].encode() + b"\n")
    return f"sha256:{out.hexdigest()}"
