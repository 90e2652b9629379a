"""Prefix sums over a global order without a global sort in one task, and groups that stream through tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, order: str, sums: dict[str, Column], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns with the sums over all rows up to and including each, in the order of a numeric column.

    Rows are dealt into ranges of the order; a range's sums are kept beside the
    ranges before it (as many rows as the session has shuffle partitions), and
    windows run inside ranges.  ``ties`` break ties of ``order``.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.col(order).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.5 / parts) if parts > 1 else []
    bounds = sorted(set(cuts))
    number = F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b <= F.col(order).cast("double"))) if bounds else F.lit(0)
    dealt = rows.withColumn("_range", number)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    per = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    per = per.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.select("*", *(F.sum(c).over(inside).alias(n) for n, c in sums.items())).join(F.broadcast(per), "_range")
    out = [c for c in dealt.columns if c != "_range"]
    return rows.select(*out, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def grouped(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows of each key side by side in one task, in order, for functions over a task's rows.

    They are dealt by a hash of the key: a plain repartition by the key is left out of
    the plan where a join has dealt by it already, and the join may then be made
    without dealing while the query runs.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key, *order)
