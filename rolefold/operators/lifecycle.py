"""Status transitions, version histories, successions, redirects and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Allowed status changes of a fact from one version to the next (fixed values).
TRANSITIONS = (
    ("asserted", "superseded"), ("disputed", "superseded"), ("asserted", "disputed"), ("disputed", "disputed"),
    ("asserted", "retracted"), ("disputed", "retracted"), ("goal", "retracted"), ("quoted", "retracted"),
    ("disputed", "asserted"), ("quoted", "asserted"), ("goal", "asserted"), ("superseded", "asserted"), ("superseded", "disputed"),
)


def allowed(before, after):
    """An unchanged status is always allowed."""
    pair = F.concat_ws(">", before, after)
    return (before == after) | pair.isin(*(f"{a}>{b}" for a, b in TRANSITIONS))


def history_problems(versions: DataFrame) -> DataFrame:
    """(id, version, code): gaps in version numbers, time that doesn't rise, transitions that aren't allowed."""
    order = Window.partitionBy("id").orderBy("version")
    rows = versions.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("tx_before", F.lag("tx_from").over(order)).withColumn("before", F.lag("status").over(order))
    checks = F.array_compact(F.array(
        F.when(F.col("place") != F.col("version"), F.lit("version_gap")),
        F.when(F.col("tx_from") <= F.col("tx_before"), F.lit("time_order")),
        F.when(F.col("before").isNotNull() & ~allowed(F.col("before"), F.col("status")), F.lit("transition")),
    ))
    return rows.select("id", "version", F.explode(checks).alias("code"))


def successions(orders: DataFrame) -> DataFrame:
    """(src, dst): each order of a customer leads to the next one."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select(F.col("o_orderkey").alias("src"), following.alias("dst")).where("dst IS NOT NULL")


def resolve_redirects(moved: DataFrame) -> DataFrame:
    """(id, target, depth) of redirects that end; the pointers double each round, cycles never end.

    Each round ends the redirects next to those that have ended, so if it ends none, cycles alone are left.
    """
    now = moved.select("id", F.col("redirect_to").alias("target"), F.lit(1).alias("depth"))
    on = moved.select(F.col("id").alias("target"))
    many = None
    while (left := now.join(on, "target", "left_semi").select("id").distinct().count()) not in (0, many):
        many = left
        step = now.select(F.col("id").alias("at"), F.col("target").alias("further"), F.col("depth").alias("more"))
        now = now.join(step, F.col("target") == F.col("at"), "left").select(
            "id", F.coalesce("further", "target").alias("target"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        now = cut(now)
    return now.join(on, "target", "left_anti").select("id", "target", "depth")


def cycle_members(links: DataFrame) -> DataFrame:
    """(node) of the nodes on a cycle: what can't be reached or can't go on is peeled off, then reach is closed."""
    now = links.select("src", "dst").distinct()
    many = None
    while True:
        kept = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = cut(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        left = kept.count()
        now = kept
        if left == many:
            break
        many = left
    reach, size = now.select("src", "dst"), -1
    while True:  # only the core is closed, by doubling
        more = reach.alias("x").join(reach.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src"), F.col("y.dst"))
        reach = cut(reach.union(more).distinct())
        if (n := reach.count()) == size:
            break
        size = n
    return reach.where("src = dst").select(F.col("src").alias("node"))
