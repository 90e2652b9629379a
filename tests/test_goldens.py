"""Hand-checked values: windows, bounds, ranks, calibration, assignment, acyclicity, folds."""

from __future__ import annotations

import itertools
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolefold.functions import refine, temporal, values
from rolefold.operators import keys, lifecycle, queue, reads, width
from rolefold.operators.scorers import assign, core
from rolefold.sources import dump, exchange
from rolefold.streaming.fold import fold_stream


def windows(spark, rows):
    df = spark.createDataFrame(rows, "text string, precision int, calendar string")
    lo, hi = temporal.window(F.col("text"), F.col("precision"), F.col("calendar"))
    return [(r["lo"], r["hi"]) for r in df.select(lo.alias("lo"), hi.alias("hi")).collect()]


def test_windows(spark):
    day = 86400
    got = windows(
        spark,
        [
            ("+1970-01-01T00:00:00Z", 11, "gregorian"), ("+1582-10-05T00:00:00Z", 11, "julian"), ("+1582-10-15T00:00:00Z", 11, "gregorian"),
            ("+2000-02-00T00:00:00Z", 10, "gregorian"), ("+1999-12-00T00:00:00Z", 10, "gregorian"), ("+1900-00-00T00:00:00Z", 7, "gregorian"),
            ("+1901-00-00T00:00:00Z", 7, "gregorian"), ("-0001-00-00T00:00:00Z", 9, "gregorian"), ("-0005-00-00T00:00:00Z", 8, "gregorian"),
            ("+1970-01-01T10:30:00Z", 13, "gregorian"),
        ],
    )
    jan1970 = 2440588 * day
    assert got[0] == (jan1970, jan1970 + day)
    assert got[1] == got[2]  # the day the calendars change
    assert got[3][1] - got[3][0] == 29 * day
    assert got[4][1] - got[4][0] == 31 * day
    assert got[5][1] == got[6][0]  # 1900 closes the nineteenth century
    assert got[7][1] - got[7][0] == 366 * day  # year 0 is a leap year
    assert got[8][1] - got[8][0] == 3653 * day or got[8][1] - got[8][0] == 3652 * day
    assert got[9] == (jan1970 + 10 * 3600 + 1800, jan1970 + 10 * 3600 + 1860)


def kings(spark):
    text = [("f:king-13", "+1610-05-14", "+1643-05-14"), ("f:king-14", "+1643-05-14", "+1715-09-01")]
    df = spark.createDataFrame(text, "id string, s string, e string")
    sides = [temporal.window(F.concat(F.col(c), F.lit("T00:00:00Z")), F.lit(11), F.lit("gregorian")) for c in "se"]
    both = temporal.bounds(F.lit("literal"), sides[0], F.lit("literal"), sides[1])
    marks = {"status": "asserted", "rank": "normal", "visibility": "visible"}
    return df.select("id", *(c.alias(n) for n, c in both.items()), *(F.lit(v).alias(n) for n, v in marks.items()))


def test_kings_as_of(spark):
    facts = kings(spark).cache()
    at = lambda year: windows(spark, [(f"+{year}-01-01T00:00:00Z", 11, "gregorian")])[0][0]
    found = lambda year: [r["id"] for r in reads.Where(as_of=at(year)).apply(facts).collect()]
    assert (found(1620), found(1700), found(1720)) == (["f:king-13"], ["f:king-14"], [])
    assert reads.Where(status=frozenset()).apply(facts).count() == 0
    with pytest.raises(ValueError):
        reads.Where(status=frozenset({"odd"}))


def test_bounds_of_special_values(spark):
    df = spark.createDataFrame([(None, "novalue"), ("somevalue", None), ("novalue", "literal"), ("literal", "somevalue")], "s string, e string")
    lit = (F.lit(10).cast("long"), F.lit(20).cast("long"))
    both = temporal.bounds(F.col("s"), lit, F.col("e"), lit)
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in both.items())).collect()]
    o = temporal.OPEN
    assert got == [(-o, o, o, o), (-o, o, o, o), (-o, -o, 10, 20), (10, 20, 10, o)]


def test_injective_find(spark):
    rows = [("a", "r", "x", "1"), ("a", "r", "x", "2"), ("b", "r", "x", "1"), ("b", "r", "x", "1"), ("c", "r", "x", "1"), ("c", "r", "x", "2"), ("c", "r", "x", "3")]
    df = spark.createDataFrame(rows, "fact_id string, relation string, role string, ident string")
    ids = lambda *p, **k: sorted(r[0] for r in reads.find(df, "r", [("x", v) for v in p], **k).collect())
    assert ids("1", "1") == ["b"]
    assert ids("1", None) == ["a", "b", "c"]
    assert ids("1", "2", exact=True) == ["a"]
    assert ids("1", None, None) == ["c"]


def test_reciprocal_rank_ties(spark):
    row = spark.range(1).select(core.reciprocal(F.lit(1).cast("long"), F.lit(4).cast("long")).alias("rr"), core.hits(F.lit(1), F.lit(4), 1).alias("h")).first()
    assert row["rr"] == pytest.approx(25 / 48) and row["h"] == 0.25


def test_calibration_values(spark):
    rows = [(c, int(x)) for c, x in zip([".95"] * 4 + [".55"] * 4 + [".15"] * 2, "1110110000", strict=True)]
    df = spark.createDataFrame(rows, "c string, correct int").select(F.col("c").cast("decimal(5,2)").alias("confidence"), "correct")
    assert core.expected_error(core.equal_width(df, 10)).first()["ece"] == pytest.approx(13 / 100)
    assert core.brier(df).first()["brier"] == pytest.approx(393 / 2000)


def test_bootstrap():
    assert core.bootstrap([0, 1, 1, 0, 1, 1, 1, 0, 1, 1]) == (0.4, 1.0)


def test_token_f1(spark):
    df = spark.createDataFrame([("the cat sat on mats", "a cat sat there"), ("", "the"), ("x", "")], "a string, b string")
    assert [r[0] for r in df.select(values.token_f1(F.col("a"), F.col("b"))).collect()] == [pytest.approx(4 / 7), 1.0, 0.0]


def test_assignment_is_heaviest():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        table = [[rng.randint(0, 4) for _ in range(m)] for _ in range(n)]
        got = assign.assign(table)
        used = [j for j in got if j is not None]
        assert len(used) == len(set(used))
        wide = max(n, m)
        padded = [[table[i][j] if i < n and j < m else 0 for j in range(wide)] for i in range(wide)]
        best = max(sum(padded[i][p[i]] for i in range(wide)) for p in itertools.permutations(range(wide)))
        assert sum(table[i][j] for i, j in enumerate(got) if j is not None) == best


def random_edges(rng):
    return {f"e{i}": frozenset(rng.sample("abcdef", rng.randint(1, 4))) for i in range(rng.randint(1, 5))}


def has_beta_cycle(edges):
    return any(width.gyo(dict(c)) for n in range(1, len(edges) + 1) for c in itertools.combinations(edges.items(), n))


def test_acyclicity_against_definitions():
    triangle = {"sale": frozenset({"buyer", "seller"}), "brokerage": frozenset({"seller", "broker"}), "referral": frozenset({"broker", "buyer"})}
    assert width.classify(triangle) == "cyclic"
    assert width.widths(triangle) == {"tw": 2, "ghw": 2, "fhw": Fraction(3, 2)}
    rng = random.Random(5)
    for _ in range(150):
        edges = random_edges(rng)
        kind = width.classify(edges)
        assert (kind in ("berge", "gamma", "beta")) == (not has_beta_cycle(edges))
        assert (width.widths(edges)["ghw"] == 1) == (kind != "cyclic")
        if width.is_berge(edges):
            assert width.is_gamma(edges)
        if width.is_gamma(edges):
            assert width.is_beta(edges)


def test_redirects_and_cycles(spark):
    moved = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "id string, redirect_to string")
    assert {tuple(r) for r in lifecycle.resolve_redirects(moved).collect()} == {("a", "c", 2), ("b", "c", 1)}
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (0, 1), (3, 4)], "src long, dst long")
    assert {r[0] for r in lifecycle.cycle_members(links).collect()} == {1, 2, 3}


def test_loops_go_on_to_the_end(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 69)], "src long, dst long").coalesce(1)
    walked = reads.walk(links, spark.createDataFrame([(0,)], "node long"))
    assert sorted(map(tuple, walked.collect())) == [(0, i, i) for i in range(71)]
    moved = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1001)], "id long, redirect_to long").coalesce(1)
    assert sorted(map(tuple, lifecycle.resolve_redirects(moved).collect())) == [(i, 300, 300 - i) for i in range(300)]
    nested = [(f"f{i}", "a" if i == 0 else "b", "fact", f"f{i + 1}") for i in range(40)] + [("f40", "b", "entity", "e")]
    bindings = spark.createDataFrame(nested, "fact_id string, relation string, value_kind string, ident string").coalesce(1)
    assert {tuple(r) for r in exchange.closed_slice(bindings, ["a"]).collect()} == {("fact", f"f{i}") for i in range(41)} | {("entity", "e")}


def test_collision_actions():
    assert keys.action("close_older", "distinct", "succession") == "close_older"
    assert keys.action("close_older", "distinct", "backfill") == "close_incoming"
    assert keys.action("close_older", "distinct", "same_start") == "dispute"
    assert keys.action("dispute", "refines", "succession") == "merge"


def test_refinement(spark):
    fits = lambda a, b: b is None or a == b
    assert refine.matching(["x", "y"], [None, "x"], fits) and not refine.matching(["x", "y"], ["x", "x"], fits)
    row = spark.range(1).select(
        refine.geo_refines(refine.geo(F.lit("1.01"), F.lit("2.0"), F.lit("0.01"), F.lit("earth")), refine.geo(F.lit("1.0"), F.lit("2.0"), F.lit("0.1"), F.lit("earth"))),
        refine.quantity_refines(refine.quantity(F.lit("5"), F.lit("m"), F.lit(None), F.lit(None)), refine.quantity(F.lit("6"), F.lit("m"), F.lit("4"), F.lit("8"))),
    ).first()
    assert tuple(row) == (True, True)


LOG = [("a", 1, "lint_pass"), ("a", 2, "accept"), ("a", 3, "reject"), ("b", 4, "lint_warn"), ("b", 5, "flag"), ("b", 6, "verdict"), ("b", 7, "accept"), ("c", 8, "accept")]


def test_fold_batch_stream_and_python_agree(spark, tmp_path):
    log = spark.createDataFrame(LOG, "target string, lid long, action string")
    batch = {tuple(r) for r in queue.fold(log).collect()}
    assert batch == {("a", "accepted", 1, 3), ("b", "accepted", 1, 4), ("c", "pending", 1, 1)}
    frame = pd.DataFrame(LOG, columns=["target", "lid", "action"])
    assert {tuple(queue.fold_group(g).iloc[0]) for _, g in frame.groupby("target")} == batch
    for n, part in enumerate((LOG[:4], LOG[4:])):
        spark.createDataFrame(part, log.schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("fold_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {}
    for r in spark.table("fold_out").collect():
        if r["target"] not in last or r["entries"] > last[r["target"]][3]:
            last[r["target"]] = tuple(r)
    assert {v[0]: v[3] for v in last.values()} == {"a": 3, "b": 4, "c": 1}


def test_container_round_trip(spark, tmp_path):
    rows = [("f1", "r", "b1", "who", "entity", "c:1"), ("f1", "r", "b2", "said", "literal", 'a "quote"\n'), ("f2", "r", "b1", "who", "entity", "c:2")]
    df = spark.createDataFrame(rows, "fact_id string, relation string, bid string, role string, value_kind string, ident string")
    exchange.write_lines(exchange.canonical_lines(df), str(tmp_path / "lines"))
    back = exchange.read_lines(spark, str(tmp_path / "lines"))
    columns = ["fact_id", "relation", "bid", "role", "value_kind", "ident"]
    assert {tuple(r) for r in back.select(*columns).collect()} == set(rows)
    triples = exchange.from_triples(exchange.triples(df))
    assert triples.count() == len(rows)


def test_dump(spark, tmp_path):
    import bz2
    import json

    snak = lambda p, kind="value": {"snaktype": kind, "property": p}
    item = {"id": "Q1", "sitelinks": {"enwiki": {"title": "Talk:X"}}, "claims": {"P1": [{"rank": "normal", "mainsnak": snak("P1"), "qualifiers": {"P2": [snak("P2"), snak("P2", "novalue")]}}, {"rank": "deprecated", "mainsnak": snak("P1", "novalue")}]}}
    path = tmp_path / "dump.json.bz2"
    path.write_bytes(bz2.compress(("[\n" + json.dumps(item) + "\n]\n").encode()))
    entities = dump.read_dump(spark, str(path))
    rows = dump.statements(entities).cache()
    assert {tuple(r) for r in dump.arity_histogram(rows).collect()} == {(3, 1), (1, 1)}
    assert {tuple(r) for r in dump.rank_histogram(rows).collect()} == {("preferred", 0), ("normal", 1), ("deprecated", 1)}
    assert not entities.select(dump.is_seed(F.col("sitelinks")["enwiki"]["title"])).first()[0]


def test_strict_json():
    from rolefold.functions.jsontext import Refused, canonical, strict

    assert canonical(strict('{"b": 1.50, "a": ["e\\u0301", 1e21, 1E-7, -0.0, true, null]}')) == '{"a":["é",1e+21,1e-7,0,true,null],"b":1.5}'
    for text, code in (('{"a":1,"a":2}', "J003"), ('{"a":NaN}', "J004"), ("﻿{}", "J002"), ('{"a":"\\ud800"}', "J005"), ('{"a":9007199254740992}', "J006"), ("[]", "J007"), ("{", "J001"), ("[" * 400 + "]" * 400, "J001")):
        with pytest.raises(Refused) as e:
            strict(text)
        assert e.value.args[0] == code


def test_put_is_all_or_nothing(spark):
    from rolefold.operators import writes

    store = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "id string, version int, content_key string")
    batch = spark.createDataFrame([("a", "y", None), ("b", "z", 1), ("c", "q", 0)], "id string, content_key string, expect int")
    assert {(r["id"], r["version"], r["outcome"]) for r in writes.put(store, batch).collect()} == {("a", 2, "no_op"), ("b", 2, "new_version"), ("c", 1, "create")}
    late = spark.createDataFrame([("a", "y", 1), ("c", "q", 0)], "id string, content_key string, expect int")
    assert {r["outcome"] for r in writes.put(store, late).collect()} == {"conflict"}
