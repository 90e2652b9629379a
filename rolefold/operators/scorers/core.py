"""Metrics as aggregations.  Ratios are formed once from integer sums."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.running import running_sums
from ..keys import both_ways, overlapping


# ----------------------------------------------------------------- completion


def rank_bounds(scores: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(query, candidates, greater, equal, o, p): place of the target among candidates that aren't known answers.

    scores: (query, candidate, score, is_target); known: (query, candidate), the target excepted.
    A row with ``n`` stands for so many candidates with one score.  Candidates are
    counted by score where they are before any is moved.
    """
    if known is not None:
        hidden = known.select("query", "candidate").distinct().withColumn("hide", F.lit(True))
        scores = scores.join(hidden, ["query", "candidate"], "left").where(F.col("is_target") | F.col("hide").isNull()).drop("hide")
    is_target = F.coalesce("is_target", F.lit(False)).alias("is_target")
    each = scores.groupBy("query", "score", is_target).agg((F.sum("n") if "n" in scores.columns else F.count("*")).alias("n"))
    target = each.where("is_target").select("query", F.col("score").alias("t"), F.col("n").alias("times"))
    n = F.col("n") * F.col("times")
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    counted = each.join(target, "query").groupBy("query").agg(
        F.sum(n).alias("candidates"), total(F.col("score") > F.col("t")).alias("greater"), total((F.col("score") == F.col("t")) & ~F.col("is_target")).alias("equal"),
    )
    o = (F.col("greater") + 1).alias("o")
    return counted.select("*", o, (F.col("greater") + 1 + F.col("equal")).alias("p"))


def reciprocal(o: Column, p: Column) -> Column:
    """Expected reciprocal rank when ties are broken at random: the mean of 1/r over o..p."""
    return F.aggregate(F.sequence(o, p), F.lit(0.0), lambda a, r: a + 1.0 / r) / (p - o + 1)


def hits(o: Column, p: Column, k: int) -> Column:
    """Chance that a random tie order ranks the target within k."""
    return F.greatest(F.lit(0), F.least(F.lit(k), p) - o + 1) / (p - o + 1)


def measures(rows: DataFrame, convention: str = "tie_exact", ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Adds rr, rank and hits_k of each query under a rank convention; rows: (o, p, and model_rank for ``model``).

    tie_exact averages over random tie orders; realistic ranks the middle of the
    tie block, optimistic and pessimistic its ends; model takes the model's own
    rank, or the block's end where it gave none.
    """
    o, p = F.col("o"), F.col("p")
    if convention == "tie_exact":
        made = {"rr": reciprocal(o, p), "rank": (o + p) / 2, **{f"hits_{k}": hits(o, p, k) for k in ks}}
    else:
        rank = {"optimistic": lambda: o, "pessimistic": lambda: p, "realistic": lambda: (o + p) / 2, "model": lambda: F.coalesce(F.col("model_rank"), p)}[convention]().cast("double")
        made = {"rr": 1 / rank, "rank": rank, **{f"hits_{k}": (rank <= k).cast("double") for k in ks}}
    return rows.select("*", *(c.cast("double").alias(n) for n, c in made.items()))


def averages(rows: DataFrame, names: list[str], fact: str = "fact", bin_: str = "bin") -> DataFrame:
    """(level, names...): means per query, per fact, and over bins of the facts' means."""
    mean = lambda df, level: df.agg(*(F.avg(n).alias(n) for n in names)).select(F.lit(level).alias("level"), *names)
    facts = rows.groupBy(fact, bin_).agg(*(F.avg(n).alias(n) for n in names))
    bins = facts.groupBy(bin_).agg(*(F.avg(n).alias(n) for n in names))
    return mean(rows, "per_task").union(mean(facts, "per_fact")).union(mean(bins, "macro"))


def known_answers(bindings: DataFrame, by: list[str]) -> DataFrame:
    """(by..., candidates): all fillers seen with the same other bindings."""
    return bindings.groupBy(*by).agg(F.array_sort(F.collect_set("ident")).alias("candidates"))


def known_at_once(facts: DataFrame, context: str) -> DataFrame:
    """(query, known): facts of one context that surely hold together, every fact as the query of all others.

    Facts meet in windows of time no longer than the context's longest validity,
    so only facts that start near one another are compared.
    """
    rows = facts.select("id", F.col(context).alias("c"), "s_lo", "s_hi", "e_lo", "e_hi")
    return both_ways(overlapping(rows, ["c"], "definite"))


# ------------------------------------------------------------------ retrieval


def first_support(ranked: DataFrame, support: DataFrame, k: int) -> DataFrame:
    """(query, first, found, wanted): first rank of a supporting unit within k, how many are found, how many exist."""
    wanted = support.groupBy("query").agg(F.count_distinct("unit").alias("wanted"))
    hit = ranked.where(F.col("rank") <= k).join(support.select("query", "unit").distinct(), ["query", "unit"])
    found = hit.groupBy("query").agg(F.min("rank").alias("first"), F.count_distinct("unit").alias("found"))
    return wanted.join(found, "query", "left").select("query", "first", F.coalesce("found", F.lit(0)).alias("found"), "wanted")


def ndcg(ranked: DataFrame, support: DataFrame, k: int, discount: str = "log2") -> DataFrame:
    """(query, ndcg) with binary relevance of first occurrences; the discount of place i is log2(i + 1), or, for
    ``shifted``, 1 at the first place and log2(i) from then on."""
    cost = (lambda i: F.log2(i + 1)) if discount == "log2" else (lambda i: F.when(i == 1, 1.0).otherwise(F.log2(i)))
    once = ranked.where(F.col("rank") <= k).groupBy("query", "unit").agg(F.min("rank").alias("rank"))
    hit = once.join(support.select("query", "unit").distinct(), ["query", "unit"])
    gain = hit.groupBy("query").agg(F.sum(1.0 / cost(F.col("rank"))).alias("dcg"))
    wanted = support.groupBy("query").agg(F.count_distinct("unit").alias("wanted"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted").cast("int"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1.0 / cost(i))
    return wanted.join(gain, "query", "left").select("query", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def ranking(ranked: DataFrame, support: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query, r_precision, hit_k, success_k, recall_k, mrr_k) with alternative support sets: the best set counts.

    ranked: (query, rank, unit); support: (query, set, unit).  r_precision looks
    as deep as each set is large; a query without a support set isn't ranked.
    """
    sets = support.select("query", "set", "unit").distinct()
    sizes = sets.groupBy("query", "set").agg(F.count("*").alias("size"))
    first = ranked.groupBy("query", "unit").agg(F.min("rank").alias("rank"))
    found = sets.join(first, ["query", "unit"]).join(sizes, ["query", "set"])
    upto = {k: F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks}
    per = found.groupBy("query", "set").agg(F.count_if(F.col("rank") <= F.col("size")).alias("n_r"), F.min("rank").alias("first"), *upto.values())
    rows = sizes.join(per, ["query", "set"], "left").fillna(0, ["n_r", *(f"n_{k}" for k in ks)])
    some = rows.groupBy("query").agg(
        F.max(F.col("n_r") / F.col("size")).alias("r_precision"), F.min("first").alias("first"),
        *(F.max(F.col(f"n_{k}") / F.col("size")).alias(f"recall_{k}") for k in ks),
    )
    hit = lambda k: F.coalesce(F.col("first") <= k, F.lit(False))
    return some.select(
        "query", "r_precision", *(hit(k).cast("int").alias(f"hit_{k}") for k in ks), *((F.col(f"recall_{k}") == 1).cast("int").alias(f"success_{k}") for k in ks),
        *(F.col(f"recall_{k}") for k in ks), *(F.when(hit(k), 1.0 / F.col("first")).otherwise(0.0).alias(f"mrr_{k}") for k in ks),
    )


def binding_coverage(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query, coverage): share of the best support set's bindings within rank k.

    ranked: (query, rank, fact, bid), a row per binding that a unit shows; gold: (query, set, fact, bid).
    """
    shown = ranked.where(F.col("rank") <= k).select("query", "fact", "bid").distinct().withColumn("seen", F.lit(1))
    rows = gold.select("query", "set", "fact", "bid").distinct().join(shown, ["query", "fact", "bid"], "left")
    per = rows.groupBy("query", "set").agg((F.count("seen") / F.count("*")).alias("share"))
    return per.groupBy("query").agg(F.max("share").alias("coverage"))


def claimed_support(claims: DataFrame, support: DataFrame) -> DataFrame:
    """(query, precision, recall, f1, em) of the facts an answer names, against the set that suits them best.

    claims: (query, unit); support: (query, set, unit); only queries that claim something are scored.
    """
    c, s = claims.select("query", "unit").distinct(), support.select("query", "set", "unit").distinct()
    n_claims = c.groupBy("query").agg(F.count("*").alias("predicted"))
    n_sets = s.groupBy("query", "set").agg(F.count("*").alias("gold"))
    tp = c.join(s, ["query", "unit"]).groupBy("query", "set").agg(F.count("*").alias("tp"))
    rows = prf(n_sets.join(n_claims, "query").join(tp, ["query", "set"], "left").fillna(0, ["tp"]))
    em = ((F.col("tp") == F.col("predicted")) & (F.col("tp") == F.col("gold"))).cast("int").alias("em")
    best = F.max_by(F.struct("precision", "recall", "f1", em), F.struct("f1", -F.col("set").cast("long")))
    return rows.groupBy("query").agg(best.alias("b")).select("query", "b.*")


def value_answers(gold: DataFrame, given: DataFrame, abstained: DataFrame | None = None) -> DataFrame:
    """(query, em, precision, recall, f1) of value sets; gold, given: (query, value); who abstains gave nothing."""
    given = given if abstained is None else given.join(abstained.select("query"), "query", "left_anti")
    questions = gold.select("query").distinct()
    rows = matched(gold.withColumnRenamed("value", "key"), given.join(questions, "query", "left_semi").withColumnRenamed("value", "key"), ["query"])
    em = ((F.col("tp") == F.col("predicted")) & (F.col("tp") == F.col("gold"))).cast("int").alias("em")
    return prf(rows).select("query", em, "precision", "recall", "f1")


def joint(answers: DataFrame, supports: DataFrame, ranks: DataFrame) -> DataFrame:
    """(query, joint_p, joint_r, joint_f1, joint_em, gated_em): an answer counts as far as its support does.

    Joint precision and recall are products of the answer's and the claimed
    support's; gated_em counts an answer only where the ranking finds a whole
    support set first (r_precision 1).  answers, supports: (query, em, precision,
    recall); ranks: (query, r_precision).
    """
    s = supports.select("query", F.col("precision").alias("sp"), F.col("recall").alias("sr"), F.col("em").alias("se"))
    rows = answers.join(s, "query", "left").join(ranks.select("query", "r_precision"), "query", "left")
    p, r = F.col("precision") * F.col("sp"), F.col("recall") * F.col("sr")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).when(p.isNotNull(), 0.0)
    gated = F.when(F.col("r_precision").isNotNull(), F.col("em") * (F.col("r_precision") == 1).cast("int"))
    return rows.select("query", p.alias("joint_p"), r.alias("joint_r"), f1.alias("joint_f1"), (F.col("em") * F.col("se")).alias("joint_em"), gated.alias("gated_em"))


def budget_curve(questions: DataFrame, steps: int = 10) -> DataFrame:
    """(step, budget, answered, answer_em): what is answered rightly within each tenth of all tokens spent.

    questions: (place, tokens, answerable, em, missing), read in the order of
    ``place`` until one doesn't fit.  Questions without a response spend nothing;
    the denominator is every answerable question.
    """
    spent = running_sums(questions.where(~F.col("missing")), "place", {"run": F.col("tokens")})
    whole = questions.agg(F.count_if("answerable").alias("answerable"), F.coalesce(F.sum(F.when(~F.col("missing"), F.col("tokens"))), F.lit(0)).alias("total"))
    limits = whole.select("answerable", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "total")
    limits = limits.withColumn("budget", (F.col("total") * F.col("step") + (steps - 1) - F.pmod(F.col("total") * F.col("step") + (steps - 1), F.lit(steps))) / steps)
    met = spent.join(F.broadcast(limits), F.col("run") <= F.col("budget"))  # ``steps`` rows
    right = F.sum(F.when(F.col("n.answerable"), F.coalesce("n.em", F.lit(0))).otherwise(0))
    counted = met.select("step", F.struct(spent["answerable"], spent["em"]).alias("n")).groupBy("step").agg(F.count("*").alias("answered"), right.alias("right"))
    rows = limits.where("answerable > 0 AND total > 0").join(counted, "step", "left")
    return rows.select("step", F.col("budget").cast("long").alias("budget"), F.coalesce("answered", F.lit(0)).alias("answered"), (F.coalesce("right", F.lit(0)) / F.col("answerable")).alias("answer_em"))


def abstention(answers: DataFrame) -> DataFrame:
    """(right, abstained, unanswerable, precision, recall) of not answering; answers: (abstained, answerable)."""
    sums = answers.agg(
        F.count_if(F.col("abstained") & ~F.col("answerable")).alias("right"), F.count_if("abstained").alias("abstained"),
        F.count_if(~F.col("answerable")).alias("unanswerable"),
    )
    ratio = lambda n: F.when(F.col(n) > 0, F.col("right") / F.col(n))
    return sums.select("*", ratio("abstained").alias("precision"), ratio("unanswerable").alias("recall"))


# ------------------------------------------------------------ sets and scores


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, predicted, gold; two empty sides are perfect, one is zero."""
    tp, pred, gold = F.col("tp"), F.col("predicted"), F.col("gold")
    both = (pred == 0) & (gold == 0)
    ratio = lambda a, b: F.when(both, 1.0).when(b == 0, 0.0).otherwise(a / b)
    return counts.select("*", ratio(tp, pred).alias("precision"), ratio(tp, gold).alias("recall"), ratio(2 * tp, pred + gold).alias("f1"))


def matched(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """(by..., tp, predicted, gold): distinct keys on each side and on both."""
    g = gold.select(*by, "key").distinct().withColumn("g", F.lit(1))
    p = predicted.select(*by, "key").distinct().withColumn("p", F.lit(1))
    both = g.join(p, [*by, "key"], "full_outer")
    return both.groupBy(*by).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("p").alias("predicted"), F.count("g").alias("gold"))


def pairwise_jaccard(units: DataFrame) -> DataFrame:
    """(a, b, common, either, jaccard) over pairs of runs; units: (run, unit).

    Pairs are of runs, which are few; units meet through their own key.
    """
    rows = units.distinct()
    sizes = rows.groupBy("run").agg(F.count("*").alias("n"))
    x, y = rows.alias("x"), rows.alias("y")
    common = x.join(y, (F.col("x.unit") == F.col("y.unit")) & (F.col("x.run") < F.col("y.run"))).groupBy(F.col("x.run").alias("a"), F.col("y.run").alias("b")).agg(F.count("*").alias("common"))
    a, b = sizes.select(F.col("run").alias("a"), F.col("n").alias("na")), sizes.select(F.col("run").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(common, ["a", "b"], "left")
    shared = F.coalesce("common", F.lit(0))
    either = F.col("na") + F.col("nb") - shared
    return pairs.select("a", "b", shared.alias("common"), either.alias("either"), F.when(either == 0, 1.0).otherwise(shared / either).alias("jaccard"))


def support_counts(units: DataFrame) -> DataFrame:
    """(unit, support): in how many runs each unit occurs."""
    return units.groupBy("unit").agg(F.count_distinct("run").alias("support"))


def core_ratio(units: DataFrame, runs: int) -> DataFrame:
    """(units, core_ratio, unstable_fraction, mean_churn) over all runs; no units at all are stable."""
    s, n = F.col("support"), F.count("*")
    share = lambda c, empty: F.when(n == 0, empty).otherwise(F.count_if(c) / n)
    mean = F.coalesce(F.avg(s * (runs - s) / (runs * (runs - 1) / 2)), F.lit(0.0)) if runs > 1 else F.lit(0.0)
    return support_counts(units).agg(n.alias("units"), share(s == runs, 1.0).alias("core_ratio"), share(s < runs, 0.0).alias("unstable_fraction"), mean.alias("mean_churn"))


def dispersion(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., mean, sd, least, most, runs) of a score over runs; nulls don't count, and fewer than two say nothing."""
    v = F.col("value")
    rows = values.where(v.isNotNull()).groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), F.count("*").alias("runs")
    )
    return rows.where("runs >= 2")


def churn(units: DataFrame, runs: int) -> DataFrame:
    """(unit, support, churn): the share of run pairs that disagree on the unit."""
    s = F.col("support")
    return support_counts(units).select("unit", "support", (s * (runs - s) / (runs * (runs - 1) / 2)).alias("churn"))


# ---------------------------------------------------------------- calibration


def equal_width(rows: DataFrame, bins: int) -> DataFrame:
    """rows: (confidence decimal, correct int); (bin, n, correct, confidence): right-closed bins, 0 in the first."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.ceil(F.col("confidence") * bins) - 1).cast("int")))
    return _binned(rows.withColumn("bin", at))


def equal_mass(rows: DataFrame, bins: int) -> DataFrame:
    """Bins of about equal counts by confidence; equal confidences are never split.

    There are as many bins as distinct confidences at most; the i-th cut lies at
    row ceil(i * n / bins), or, if that is inside a run of equal confidences, at the
    run's end.  Runs are counted first, and the order is summed up range by range.
    """
    runs = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    whole = runs.agg(F.sum("n").alias("total"), F.least(F.lit(bins), F.count("*")).alias("bins"))
    upto = running_sums(runs, "confidence", {"upto": F.col("n")}).join(F.broadcast(whole))  # one row
    cuts = lambda x: F.least(F.col("bins") - 1, (x * F.col("bins") - F.pmod(x * F.col("bins"), F.col("total"))) / F.col("total"))
    first = F.col("upto") - F.col("n")
    ends = upto.withColumn("ends", (cuts(F.col("upto")) > cuts(first)).cast("int"))
    placed = running_sums(ends, "confidence", {"cut": F.col("ends")})
    cut = placed.withColumn("bin", (F.col("cut") - F.col("ends")).cast("int"))
    return cut.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum(F.col("confidence") * F.col("n")).alias("confidence"))


def _binned(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"), F.sum("confidence").alias("confidence"))


def expected_error(binned: DataFrame) -> DataFrame:
    """(ece): the bins' gaps between accuracy and confidence, weighted by size."""
    gap = F.abs(F.col("correct").cast("decimal(38,6)") - F.col("confidence").cast("decimal(38,6)"))
    return binned.agg((F.sum(gap).cast("double") / F.sum("n")).alias("ece"))


def brier(rows: DataFrame) -> DataFrame:
    """(brier): mean squared distance of confidence and outcome."""
    miss = F.col("confidence") - F.col("correct").cast("decimal(10,0)")
    return rows.agg((F.sum((miss * miss).cast("decimal(38,8)")).cast("double") / F.count("*")).alias("brier"))


def resamples(n: int, draws: int, seed: int) -> np.ndarray:
    """draws x n indices; the generator is Python's, so seeds mean the same everywhere, run in one vectorised step."""
    _, state, _ = random.Random(seed).getstate()
    rng = np.random.RandomState()
    rng.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    return (rng.random_sample(draws * n) * n).astype(np.int64).reshape(draws, n)


def _positions(count: int, alpha: float) -> tuple[int, int]:
    """Places of the interval's ends among sorted statistics, in exact arithmetic."""
    a = Fraction(repr(alpha))
    low = math.floor(a / 2 * count)
    return low, max(low, math.floor((1 - a / 2) * count) - 1)


def _interval(stats: np.ndarray, alpha: float) -> tuple[float, float]:
    low, high = _positions(len(stats), alpha)
    ordered = np.sort(stats)
    return float(ordered[low]), float(ordered[high])


def _means(values: list[float], draws: int, seed: int) -> np.ndarray:
    """Means of the resamples, blocks of draws at a time."""
    data, n = np.asarray(values, float), len(values)
    at = resamples(n, draws, seed)
    return np.concatenate([data[part].sum(axis=1) for part in np.array_split(at, max(1, at.size >> 22))]) / n


def bootstrap(values: list[float], draws: int = 1000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of the mean."""
    return _interval(_means(values, draws, seed), alpha)


def bootstrap_paired(a: list[float], b: list[float], draws: int = 1000, seed: int = 0, alpha: float = 0.05) -> dict:
    """Intervals of two systems' means on the same units and of b - a, and the share of draws in which b is better."""
    if len(a) != len(b):
        raise ValueError("paired units differ in number")
    x, y = _means(a, draws, seed), _means(b, draws, seed)
    return {"a": _interval(x, alpha), "b": _interval(y, alpha), "difference": _interval(y - x, alpha), "b_better": float((y > x).mean())}


def bootstrap_by(rows: DataFrame, by: str, value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(by, low, high): one interval per group; groups are evaluation units, in id order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap(pdf.sort_values("id")[value].tolist(), draws, seed)
        return pd.DataFrame([(pdf[by].iloc[0], low, high)], columns=[by, "low", "high"])

    kind = dict(rows.dtypes)[by]
    return rows.select(by, "id", value).groupBy(by).applyInPandas(one, f"{by} {kind}, low double, high double")


def bootstrap_paired_by(rows: DataFrame, by: str, a: str, b: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(by, low, high, b_better): interval of the difference b - a per group, units in id order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = bootstrap_paired(pdf[a].tolist(), pdf[b].tolist(), draws, seed)
        return pd.DataFrame([(pdf[by].iloc[0], *found["difference"], found["b_better"])], columns=[by, "low", "high", "b_better"])

    kind = dict(rows.dtypes)[by]
    return rows.select(by, "id", a, b).groupBy(by).applyInPandas(one, f"{by} {kind}, low double, high double, b_better double")
