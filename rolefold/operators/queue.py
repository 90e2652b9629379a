"""The candidate queue: item states as a fold over the log, verdicts, and their join to items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import grouped

OPEN = ("pending", "linted", "needs_review")
#: Moves (fixed values): action -> (states it may leave, state it leads to; lint's target is its outcome).
MOVES = {
    "lint_pass": (("pending",), "linted"),
    "lint_warn": (("pending",), "needs_review"),
    "lint_fail": (("pending",), "rejected"),
    "accept": (("linted", "needs_review"), "accepted"),
    "reject": (OPEN, "rejected"),
    "flag": (("pending", "linted"), "needs_review"),
    "withdraw": (OPEN, "withdrawn"),
}
#: Verdict labels from the worst on (fixed values and order); ``correct`` stands apart.
SEVERITIES = (
    "no_relation", "wrong_relation", "wrong_role", "wrong_filler", "missing_participant", "extra_participant", "span_boundary", "negated", "hypothesis", "other",
)


def step(state: str, action: str) -> tuple[str, bool]:
    """The state after an action, and whether the action was legal; an illegal one changes nothing."""
    if action == "verdict":
        return state, True
    sources, target = MOVES.get(action, ((), state))
    return (target, True) if state in sources else (state, False)


def fold_group(pdf: pd.DataFrame) -> pd.DataFrame:
    state, illegal = "pending", 0
    for action in pdf.sort_values("lid")["action"]:
        state, legal = step(state, action)
        illegal += not legal
    return pd.DataFrame([(pdf["target"].iloc[0], state, illegal, len(pdf))], columns=["target", "state", "illegal", "entries"])


def fold(log: DataFrame) -> DataFrame:
    """(target, state, illegal, entries) from (target, lid, action), in log order.

    Entries stream through a task sorted by item and place, so an item of any
    length costs one state, not its log.
    """
    import pyarrow as pa

    names = ["target", "state", "illegal", "entries"]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())

    def run(batches):
        at, state, illegal, many, started = None, "pending", 0, 0, False
        for b in batches:
            out = []
            for target, action in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not started or target != at:
                    if started:
                        out.append((at, state, illegal, many))
                    at, state, illegal, many, started = target, "pending", 0, 0, True
                state, legal = step(state, action)
                illegal, many = illegal + (not legal), many + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((at, state, illegal, many), kinds, strict=True)], names=names)

    rows = grouped(log.select("target", "lid", "action"), "target", "lid").select("target", "action")
    return rows.mapInArrow(run, "target string, state string, illegal int, entries int")


def parents(log: DataFrame) -> DataFrame:
    """Adds the entry before each one on the same item."""
    return log.withColumn("parent", F.lag("lid").over(Window.partitionBy("target").orderBy("lid")))


def aggregate_verdicts(verdicts: DataFrame) -> DataFrame:
    """(target, label): one judgement of a candidate from those of its evidence; verdicts: (target, label).

    One ``correct`` is enough, unless some verdict denies the relation; else the
    worst label counts.  Labels that aren't known say nothing.
    """
    order = F.create_map(*(F.lit(x) for i, v in enumerate(SEVERITIES) for x in (v, i)))
    said = F.col("label")
    least = F.min(F.when(said.isin(*SEVERITIES), order[said]))
    right = F.max(said == "correct") & ~F.max(said.isin("no_relation", "wrong_relation"))
    label = F.when(right, "correct").otherwise(F.get(F.array(*map(F.lit, SEVERITIES)), least))
    return verdicts.where(said.isNotNull()).groupBy("target").agg(label.alias("label"))


def complete_verdicts(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Verdicts whose missing core_key and event_hash are filled from the item and the evidence that they name.

    verdicts: (target, evidence_id, label, core_key, event_hash); items: (target, core_key, evidence_id, event_hash).
    """
    keys = items.groupBy("target").agg(F.any_value("core_key").alias("_core"))
    hashes = items.select("target", "evidence_id", F.col("event_hash").alias("_hash")).distinct()
    rows = verdicts.join(keys, "target", "left").join(hashes, ["target", "evidence_id"], "left")
    return rows.select("target", "evidence_id", "label", F.coalesce("core_key", "_core").alias("core_key"), F.coalesce("event_hash", "_hash").alias("event_hash"))


def attach(items: DataFrame, verdicts: DataFrame, on: list[str]) -> DataFrame:
    """Items with their verdicts as a sorted array; none is an empty one."""
    held = verdicts.groupBy(*on).agg(F.array_sort(F.collect_list("verdict")).alias("verdicts"))
    return items.join(held, on, "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast("array<string>")))


#: Where each action may lead from each state (fixed values).
STEPS = {
    "lint": {"pending": ("linted", "needs_review", "rejected")},
    "accept": {"linted": ("accepted",), "needs_review": ("accepted",)},
    "reject": {s: ("rejected",) for s in OPEN},
    "flag": {"pending": ("needs_review",), "linted": ("needs_review",)},
    "verdict": {s: (s,) for s in (*OPEN, "accepted", "rejected")},
    "withdraw": {s: ("withdrawn",) for s in OPEN},
}
JUDGED = "target string, line long, lid string, how string, code string, state string"


def judge(log: DataFrame, items: DataFrame) -> DataFrame:
    """(target, line, lid, how, code, state): each entry as the fold takes it, and the item's state after it.

    log: (target, line, lid, parent, action, before, after, error), items: (target).
    An entry is skipped if its item is unknown or its parent isn't the item's last
    folded entry (Q007); it is held, changing nothing, if it doesn't follow the state
    or accepts what was linted with an error (Q005); else it moves the state.
    Entries stream through a task in log order, so an item of any length keeps one state.
    """
    import pyarrow as pa

    known = log.join(items.select("target", F.lit(True).alias("known")).distinct(), "target", "left")
    rows = known.select("target", "line", "lid", "parent", "action", "before", "after", "error", F.coalesce("known", F.lit(False)).alias("known"))

    def run(batches):
        at, state, last, error = None, "pending", None, False
        for b in batches:
            out = []
            for target, line, lid, parent, action, before, after, flawed, here in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if target != at:
                    at, state, last, error = target, "pending", None, False
                if action not in STEPS:
                    out.append((target, line, lid, "skip", None, state))
                    continue
                if not here or parent != last:
                    out.append((target, line, lid, "skip", "Q007", state))
                    continue
                last = lid
                if before != state or after not in STEPS[action].get(state, ()) or (action == "accept" and error):
                    out.append((target, line, lid, "hold", "Q005", state))
                    continue
                state = after
                error = bool(flawed) if action == "lint" else error
                out.append((target, line, lid, "move", None, state))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in JUDGED.split(", ")])

    return grouped(rows, "target", "line").mapInArrow(run, JUDGED)


def states(judged: DataFrame) -> DataFrame:
    """(target, state) after the whole log."""
    return judged.groupBy("target").agg(F.max_by("state", "line").alias("state"))
