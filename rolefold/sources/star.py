"""The star, event and document tables read as n-ary facts.

fact: id, relation, version, tx_from, status, rank, visibility, s_lo..e_hi, n_bindings
binding: fact_id, relation, bid, role, slot, position, value_kind, ident
Bindings are narrow rows; a fact's header never carries them, so reads by
id or by time touch no binding and reads by value touch no header.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import temporal as T

#: relation -> ((role, slot, value kind, core part of the key), ...)
USAGE = {
    "placed": (("customer", "core", "entity", True), ("order", "core", "entity", False), ("priority", "qualifier", "literal", False), ("start", "time", "literal", False), ("end", "time", "literal", False)),
    "supplied": (("order", "core", "entity", True), ("part", "core", "entity", False), ("supplier", "core", "entity", False), ("line", "core", "literal", True), ("quantity", "qualifier", "literal", False), ("returnflag", "qualifier", "literal", False), ("shipped", "time", "literal", False)),
    "did": (("user", "core", "entity", True), ("event_type", "core", "literal", False), ("value", "qualifier", "literal", False)),
    "based_in": (("party", "core", "entity", True), ("nation", "core", "entity", False)),
    "in_region": (("nation", "core", "entity", True), ("region", "core", "entity", False)),
}

#: relations whose ids are a prefix and 64 hexadecimal digits
HASHED = {"supplied": "supplied:"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix + ":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def day(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def decimal(x: Column | str) -> Column:
    """A measure as text: two digits after the point, the same in every engine."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)").cast("string")


def line_parts() -> list[Column]:
    """What tells order lines apart beside order, part and supplier, as text."""
    return [F.col("l_linenumber").cast("string"), decimal("l_quantity"), decimal("l_extendedprice"), decimal("l_discount"), decimal("l_tax"),
            F.col("l_returnflag"), F.col("l_linestatus"), day("l_shipdate")]


def wide(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    """One row per fact with a column per role: what headers and bindings are cut from."""
    t = lambda n: read(spark, sf_dir, n)
    if relation == "placed":
        following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        rows = t("orders").withColumn("next", following)
        return rows.select(
            entity("placed", "o_orderkey").alias("id"), entity("c", "o_custkey").alias("customer"), entity("o", "o_orderkey").alias("order"),
            F.col("o_orderpriority").alias("priority"), day("o_orderdate").alias("start"), day("next").alias("end"),
            T.day_instant(F.col("o_orderdate")).alias("start_at"), T.day_instant(F.col("next")).alias("end_at"), F.col("o_orderstatus").alias("mark"),
        )
    if relation == "supplied":
        parts = [entity("o", "l_orderkey"), entity("p", "l_partkey"), entity("s", "l_suppkey"), F.col("l_linenumber").cast("string"),
                 decimal("l_quantity"), decimal("l_extendedprice"), decimal("l_discount"), decimal("l_tax"), F.col("l_returnflag"),
                 F.col("l_linestatus"), day("l_shipdate")]
        return t("lineitem").select(
            F.concat(F.lit("supplied:"), F.sha2(F.concat_ws("|", *parts), 256)).alias("id"), parts[0].alias("order"), parts[1].alias("part"),
            parts[2].alias("supplier"), parts[3].alias("line"), parts[4].alias("quantity"), parts[8].alias("returnflag"), parts[10].alias("shipped"),
            T.day_instant(F.col("l_shipdate")).alias("start_at"), F.lit(None).cast("long").alias("end_at"), F.col("l_linestatus").alias("mark"),
        )
    if relation == "did":
        return t("events").select(
            entity("did", "event_id").alias("id"), entity("u", "user_id").alias("user"), F.col("event_type"), decimal("value").alias("value"),
            F.lit(None).cast("long").alias("start_at"), F.lit(None).cast("long").alias("end_at"), F.lit("F").alias("mark"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("tx_from"),
        )
    none = F.lit(None).cast("long")
    if relation == "based_in":
        both = t("customer").select(entity("c", "c_custkey").alias("party"), "c_nationkey").union(t("supplier").select(entity("s", "s_suppkey"), "s_nationkey"))
        return both.select(
            F.concat(F.lit("based:"), "party").alias("id"), "party", entity("n", "c_nationkey").alias("nation"), none.alias("start_at"), none.alias("end_at"), F.lit("F").alias("mark")
        )
    return t("nation").select(
        entity("in", "n_nationkey").alias("id"), entity("n", "n_nationkey").alias("nation"), entity("r", "n_regionkey").alias("region"), none.alias("start_at"), none.alias("end_at"), F.lit("F").alias("mark")
    )


def facts(rows: DataFrame, relation: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Headers, with ``more`` columns of the wide rows.  Order and line states stand for belief and editorial rank: O is disputed, P deprecated."""
    roles = [r for r, *_ in USAGE[relation]]
    held = reduce(lambda a, b: a + b, (F.col(r).isNotNull().cast("int") for r in roles))
    known = F.when(F.col("start_at").isNotNull(), "literal")
    closed = F.when(F.col("end_at").isNotNull(), "literal")
    both = T.bounds(known, (F.col("start_at"), F.col("start_at") + T.DAY), closed, (F.col("end_at"), F.col("end_at") + T.DAY))
    tx = F.col("tx_from") if "tx_from" in rows.columns else F.coalesce("start_at", F.lit(0)) * 1_000_000
    return rows.select(
        "id", F.lit(relation).alias("relation"), F.lit(1).alias("version"), tx.cast("long").alias("tx_from"),
        F.when(F.col("mark") == "O", "disputed").otherwise("asserted").alias("status"),
        F.when(F.col("mark") == "P", "deprecated").otherwise("normal").alias("rank"), F.lit("visible").alias("visibility"),
        *(c.cast("long").alias(n) for n, c in both.items()), held.alias("n_bindings"), *more,
    )


def bindings(rows: DataFrame, relation: str) -> DataFrame:
    """One row per bound role, in usage order; a role that is null isn't bound."""
    cells = [
        F.struct(F.lit(f"b{i}").alias("bid"), F.lit(role).alias("role"), F.lit(slot).alias("slot"), F.lit(kind).alias("value_kind"), F.col(role).alias("ident"))
        for i, (role, slot, kind, _) in enumerate(USAGE[relation], 1)
    ]
    cut = rows.select("id", F.explode(F.array(*cells)).alias("b")).where("b.ident IS NOT NULL")
    return cut.select(F.col("id").alias("fact_id"), F.lit(relation).alias("relation"), "b.*")
