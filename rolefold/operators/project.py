"""Views of facts: by role, fixed width, subject and object, sets, text, arity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.star import USAGE

NONE = "khg:none"


def by_role(bindings: DataFrame, relation: str) -> DataFrame:
    """One row per fact with a column per role; one aggregation, no pivot pass."""
    roles = [r for r, *_ in USAGE[relation]]
    cells = [F.max(F.when(F.col("role") == r, F.col("ident"))).alias(r) for r in roles]
    # moved as they are: aggregated first they would be sorted, and spilled, once more
    rows = bindings.where(F.col("relation") == relation).select(F.col("fact_id").alias("id"), "role", "ident").repartition("id")
    return rows.groupBy("id").agg(*cells)


def positional(bindings: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width rows: the i-th value of each role, in position or value order, padded."""
    order = Window.partitionBy("fact_id", "role").orderBy(*(["position"] if "position" in bindings.columns else []), "ident")
    rows = bindings.where(F.col("role").isin(*widths)).withColumn("i", F.row_number().over(order))
    cells = [
        F.coalesce(F.max(F.when((F.col("role") == r) & (F.col("i") == i), F.col("ident"))), F.lit(NONE)).alias(f"{r}_{i}")
        for r, n in widths.items()
        for i in range(1, n + 1)
    ]
    return rows.groupBy("fact_id").agg(*cells)


def hyper_relational(bindings: DataFrame, subject: str, object_: str) -> DataFrame:
    """(fact_id, subject, object, others): the two primary roles, and the rest as sorted pairs."""
    pair = F.concat(F.col("role"), F.lit("="), F.col("ident"))
    one = lambda r, name: F.min(F.when(F.col("role") == r, F.col("ident"))).alias(name)
    rest = F.array_sort(F.collect_list(F.when(~F.col("role").isin(subject, object_), pair))).alias("others")
    return bindings.groupBy("fact_id").agg(one(subject, "subject"), one(object_, "object"), rest)


def role_values(bindings: DataFrame) -> DataFrame:
    """(fact_id, pairs): the sorted multiset of role=value."""
    return bindings.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.concat("role", F.lit("="), "ident"))).alias("pairs"))


def arity(bindings: DataFrame) -> DataFrame:
    """arity, core_arity, statement_arity, distinct_fillers and the arity's bin."""
    slot = F.col("slot")
    filler = F.when(F.col("value_kind").isNotNull() & F.col("ident").isNotNull(), F.struct("value_kind", "ident"))
    found = bindings.select("fact_id", "slot", "value_kind", "ident").repartition("fact_id").groupBy("fact_id").agg(
        F.count("*").alias("arity"), F.count_if(slot == "core").alias("core_arity"),
        F.count_if(slot.isin("core", "qualifier")).alias("statement_arity"), F.size(F.collect_set(filler)).cast("long").alias("distinct_fillers"),
    )
    n = F.col("arity")
    return found.withColumn("bin", F.when(n <= 1, "0-1").when(n >= 5, "5+").otherwise(n.cast("string")))


def render(bindings: DataFrame, relation: str) -> DataFrame:
    """(fact_id, line): core; qualifiers; and the interval, in usage order."""
    place = F.create_map(*(F.lit(x) for i, (r, *_) in enumerate(USAGE[relation]) for x in (r, i)))
    item = F.struct(place[F.col("role")].alias("i"), F.concat("role", F.lit(": "), "ident").alias("text"))
    part = lambda slot: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == slot, item))), lambda x: x["text"]), ", ")
    side = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("ident"))), F.lit(""))
    rows = bindings.groupBy("fact_id").agg(part("core").alias("core"), part("qualifier").alias("more"), side("start").alias("start"), side("end").alias("end"))
    more = F.when(F.col("more") == "", "").otherwise(F.concat(F.lit("; "), "more"))
    line = F.concat(F.lit(f"{relation}("), "core", more, F.lit(") ["), "start", F.lit(", "), "end", F.lit(")"))
    return rows.select("fact_id", line.alias("line"))
