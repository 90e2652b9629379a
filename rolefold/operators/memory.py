"""What a memory should answer at a moment: current, expired, revised, outranked and future facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("current", "expired", "revised", "outranked", "future", "disputed")


#: Reasons for a low rank that say a fact was wrong (fixed values are the caller's schema's).
REASONS = ("incorrect",)


def gold(facts: DataFrame, instant: int, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """(id, key_digest, kind): the kind of each fact under its key at an instant; facts of no kind are left out.

    Only preferred facts are current where a key has one that holds; the normal
    ones that hold beside it are outranked.  A fact is revised if it is superseded
    or retracted after a version that asserted it (column ``was_asserted``), or
    deprecated for one of ``reasons`` (column ``rank_reason``, an array).
    """
    t = F.lit(instant)
    holds = (F.col("s_hi") <= t) & (t < F.col("e_lo"))
    live = (F.col("status") == "asserted") & (F.col("rank") != "deprecated")
    marked = facts.withColumn("live_now", live & holds)
    best = marked.where(F.col("live_now") & (F.col("rank") == "preferred")).select(F.col("key_digest").alias("k")).distinct().withColumn("some", F.lit(True))
    rows = marked.join(best, F.col("key_digest") == F.col("k"), "left")
    withdrawn = F.col("status").isin("superseded", "retracted") & F.coalesce("was_asserted", F.lit(False))
    wrong = (F.col("rank") == "deprecated") & F.coalesce(F.arrays_overlap("rank_reason", F.array(*map(F.lit, reasons))), F.lit(False))
    kind = (
        F.when(F.col("live_now") & (F.col("some").isNull() | (F.col("rank") == "preferred")), "current")
        .when(live & (F.col("e_hi") <= t), "expired")
        .when(withdrawn | wrong, "revised")
        .when(F.col("live_now"), "outranked")
        .when(live & (F.col("s_lo") > t), "future")
        .when(F.col("status") == "disputed", "disputed")
    )
    return rows.select("id", "key_digest", kind.alias("kind")).where("kind IS NOT NULL")


def was_asserted(versions: DataFrame, tx: int) -> DataFrame:
    """(id, was_asserted): whether some version before a transaction time asserted the fact; versions: (id, tx_from, status)."""
    return versions.groupBy("id").agg(F.coalesce(F.max((F.col("status") == "asserted") & (F.col("tx_from") < tx)), F.lit(False)).alias("was_asserted"))


def outcomes(answers: DataFrame, kinds: DataFrame) -> DataFrame:
    """(key_digest, outcome): right, stale (by its kind), unknown, abstained rightly or wrongly.

    answers: (key_digest, answer), null for an abstention; kinds as from gold().
    """
    held = kinds.where("kind = 'current'").select("key_digest").distinct().withColumn("answerable", F.lit(True))
    named = kinds.select("key_digest", F.col("id").alias("answer"), "kind")
    rows = answers.join(named, ["key_digest", "answer"], "left").join(held, "key_digest", "left")
    can = F.coalesce("answerable", F.lit(False))
    outcome = (
        F.when(F.col("answer").isNull(), F.when(can, "missed").otherwise("abstained"))
        .when(F.col("kind") == "current", "right")
        .when(F.col("kind").isNotNull(), F.concat(F.lit("stale_"), "kind"))
        .otherwise("unknown")
    )
    return rows.select("key_digest", outcome.alias("outcome"))
