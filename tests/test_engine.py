"""Rules whose values are known by hand, brute force on small cases, and plans that must stay pruned."""

from __future__ import annotations

import itertools
import os
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolefold.functions.jsontext import Refused, strict
from rolefold.functions.running import running_sums
from rolefold.functions.values import iri_decode, iri_encode
from rolefold.operators import keys, lifecycle, queue, reads
from rolefold.operators.scorers import assign, core
from rolefold.sources import container, exchange

DATA = "/root/testdata/sf0.001"


def test_equal_mass_bins_end_where_runs_end(spark):
    values = [".95"] * 4 + [".55"] * 4 + [".15"] * 2
    rows = spark.createDataFrame([(Decimal(v), int(c)) for v, c in zip(values, "1110110000", strict=True)], "confidence decimal(5,2), correct int")
    got = {r["bin"]: (r["n"], r["correct"]) for r in core.equal_mass(rows, 2).collect()}
    assert got == {0: (6, 2), 1: (4, 3)}
    one = core.equal_mass(rows.withColumn("confidence", F.lit(Decimal("0.5"))), 10).collect()
    assert [(r["bin"], r["n"]) for r in one] == [(0, 10)]


def best_assignment(weights):
    rows, cols = len(weights), len(weights[0])
    options = itertools.product(*([*[j for j in range(cols) if row[j]], None] for row in weights))
    valid = (o for o in options if len([j for j in o if j is not None]) == len({j for j in o if j is not None}))
    return list(min(valid, key=lambda o: (-sum(weights[i][j] for i, j in enumerate(o) if j is not None), [cols if j is None else j for j in o])))


def test_assignment_is_the_heaviest_and_first():
    assert assign.assign([[1, 1], [1, 0], [1, 1]]) == [0, None, 1]
    rng = random.Random(2)
    for _ in range(600):
        weights = [[rng.randint(0, rng.choice([1, 3])) for _ in range(rng.randint(1, 4))] for _ in range(1)]
        weights += [[rng.randint(0, 3) for _ in weights[0]] for _ in range(rng.randint(0, 3))]
        assert assign.assign(weights) == best_assignment(weights), weights


def test_alignment_by_scope(spark):
    rows = spark.createDataFrame([("d", "g1", "p1", 3), ("d", "g1", "p2", 3), ("d", "g2", "p1", 3), ("e", "g9", "p9", 1)], "scope string, gold string, predicted string, weight long")
    assert sorted(map(tuple, assign.align(rows).collect())) == [("d", "g1", "p2", 3), ("d", "g2", "p1", 3), ("e", "g9", "p9", 1)]


def test_budgets_round_up_and_stop_at_the_first_overflow(spark):
    rows = [(0, 5, True, 1, False), (1, 5, True, 0, False), (2, 5, False, 1, False), (3, 9, True, 1, True)]
    df = spark.createDataFrame(rows, "place long, tokens long, answerable boolean, em int, missing boolean")
    got = {r["step"]: (r["budget"], r["answered"], round(r["answer_em"], 6)) for r in core.budget_curve(df).collect()}
    assert got[1] == (2, 0, 0.0) and got[4] == (6, 1, round(1 / 3, 6)) and got[10] == (15, 3, round(1 / 3, 6))


def test_verdicts(spark):
    cases = {"a": ["correct", "negated"], "b": ["correct", "wrong_relation"], "c": ["other", "span_boundary"], "d": ["odd"], "e": ["no_relation", "correct", "other"]}
    rows = spark.createDataFrame([(t, label) for t, labels in cases.items() for label in labels], "target string, label string")
    got = {r["target"]: r["label"] for r in queue.aggregate_verdicts(rows).collect()}
    assert got == {"a": "correct", "b": "wrong_relation", "c": "span_boundary", "d": None, "e": "no_relation"}


def test_resamples_are_pythons():
    rng = random.Random(3)
    assert core.resamples(7, 5, 3).tolist() == [[int(rng.random() * 7) for _ in range(7)] for _ in range(5)]
    found = core.bootstrap_paired([0.0, 1.0, 0.0, 1.0], [1.0, 1.0, 1.0, 1.0], draws=200)
    assert found["b"] == (1.0, 1.0) and found["b_better"] > 0.8 and found["difference"][0] >= 0


@pytest.mark.parametrize("text", ['{"a": 1e999}', '{"a": -1e999}', '{"a": NaN}'])
def test_numbers_that_json_does_not_have(text):
    with pytest.raises(Refused, match="J004"):
        strict(text)


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(300)]
    got = running_sums(spark.createDataFrame(rows, "at long, i long, n long"), "at", {"upto": F.col("n")}, ("i",)).collect()
    want, total = {}, 0
    for _, i, n in sorted(rows):
        total += n
        want[i] = total
    assert {r["i"]: r["upto"] for r in got} == want


def test_triples_round_trip_odd_names(spark):
    odd = 'a "b"\n\\ c/d%20+*~é'
    rows = [("f/1 é", "rel/x", "b1", "ro/le", "core", "literal", odd), ("f/1 é", "rel/x", "b2", "o", "core", "entity", odd)]
    df = spark.createDataFrame(rows, "fact_id string, relation string, bid string, role string, slot string, value_kind string, ident string")
    back = exchange.from_triples(exchange.triples(df)).select("fact_id", "relation", "role", "value_kind", "ident")
    assert sorted(map(tuple, back.collect())) == sorted((f, r, role, k, i) for f, r, _, role, _, k, i in rows)
    from urllib.parse import quote

    row = df.limit(1).select(iri_encode(F.lit(odd)).alias("x"), iri_decode(iri_encode(F.lit(odd))).alias("y")).first()
    assert row["x"] == quote(odd, safe="") and row["y"] == odd


def test_loops_have_no_cap(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    got = reads.walk(chain, spark.createDataFrame([(0,)], "node long")).collect()
    assert {(r["node"], r["depth"]) for r in got} == {(i, i) for i in range(201)}
    moved = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(300)] + [("x", "y"), ("y", "x")], "id string, redirect_to string")
    ends = {r["id"]: (r["target"], r["depth"]) for r in lifecycle.resolve_redirects(moved).collect()}
    assert ends["r0"] == ("r300", 300) and "x" not in ends


def test_overlaps_with_long_and_short_validities(spark):
    rng = random.Random(5)
    day, far = 86400, 4611686018427387904
    rows = []
    for i in range(80):
        low = rng.randint(0, 400) * day
        high = far if i % 9 == 0 else low + rng.choice([1, 3, 10, 900]) * day
        rows.append((f"f{i:02d}", f"k{i % 3}", low, low + day // 2, high, min(far, high + day)))
    df = spark.createDataFrame(rows, "id string, key_digest string, s_lo long, s_hi long, e_lo long, e_hi long")
    for mode, a, b in (("definite", 3, 4), ("possible", 2, 5)):
        want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and max(x[a], y[a]) < min(x[b], y[b])}
        got = keys.overlaps(df, mode).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_container_lines(spark, tmp_path):
    lines = ['{"format": "records/1.0"}', "", '{"kind": "entity", "id": "e1"}', "{broken", '{"kind": "hyperedge", "id": "f1", "relation": "r", "status": "asserted", "bindings": [{"bid": "b1", "role": "x"}]}']
    lines.append('{"kind": "hyperedge", "id": "f2", "relation": "r", "status": "asserted", "bindings": [{"bid": "b1", "role": "x", "value": {"fact": "f3"}}]}')
    (tmp_path / "c.jsonl").write_text("\n".join(lines) + "\r\n")
    rows = container.read_lines(spark, f"file://{tmp_path}/c.jsonl")
    assert sorted(map(tuple, container.findings(rows).collect())) == [("/lines/2", "J001"), ("/lines/3", "C010")]
    records = container.records(rows)
    assert [r["id"] for r in container.unloadable(records).collect()] == ["f2"]
    assert container.sha256(rows).startswith("sha256:")
    with pytest.raises(ValueError, match="f2"):
        container.load(records)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stored_reads_are_pruned(spark):
    from rolefold.plans.base import Tables

    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    store = Tables(spark, DATA).store("supplied")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = plan(reads.find(store.by_value, "supplied", [("part", "p:7")]))
    assert "EqualTo(ident,p:7)" in one and "role#" in one.split("PartitionFilters")[1].split("]")[0]
    key = plan(keys.find_by_key(store.facts, "supplied", {"order": "o:7", "line": "1"}))
    assert "EqualTo(key_digest,sha256:" in key and "Exchange" not in key
    time = plan(reads.Where(as_of=5).apply(store.facts))
    assert "LessThanOrEqual(s_hi,5)" in time and "GreaterThan(e_lo,5)" in time


def test_paired_means_agree_with_numpy():
    values = [0.1, 0.7, 0.4]
    at = core.resamples(3, 50, 1)
    low, high = core.bootstrap(values, 50, 1)
    means = np.sort(np.array(values)[at].sum(axis=1) / 3)
    assert (low, high) == (means[1], means[47])
