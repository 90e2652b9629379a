"""Steps that must not grow faster than their input: what is moved, and where."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from rolefold.operators.scorers import assign, core, extraction


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df) -> int:
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning") + plan(df).count("Exchange SinglePartition")


def test_rows_that_stand_for_many_candidates(spark):
    rng = random.Random(4)
    rows = [(q, c, rng.randint(0, 3), c == 0) for q in range(6) for c in range(rng.randint(1, 30))]
    one = spark.createDataFrame(rows, "query long, candidate long, score int, is_target boolean")
    many = one.groupBy("query", "score", "is_target").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate"))
    got = {tuple(r) for r in core.rank_bounds(many).collect()}
    want = set()
    for q in range(6):
        mine = [r for r in rows if r[0] == q]
        t = next(r[2] for r in mine if r[3])
        over, equal = sum(r[2] > t for r in mine), sum(r[2] == t and not r[3] for r in mine)
        want.add((q, len(mine), over, equal, over + 1, over + 1 + equal))
    assert got == want == {tuple(r) for r in core.rank_bounds(one).collect()}


def test_ranks_take_negative_keys_one_by_one(spark, tmp_path):
    from rolefold.plans.base import Tables
    from rolefold.plans.evaluation import ranks

    customers, suppliers = [(c, c % 2) for c in range(-9, 30)], [(s, s % 2) for s in range(-40, 90)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    rest = lambda x, n: abs(x) % n * (1 if x >= 0 else -1)
    want = set()
    for c, nation in customers:
        mine = [s for s, n in suppliers if n == nation]
        score = {s: rest(c * 31 + s * 17, 7) for s in mine if s == min(mine) or rest(c + s, 5) != 0}
        t = score.pop(min(mine))
        over, equal = sum(x > t for x in score.values()), sum(x == t for x in score.values())
        want.add((c, len(score) + 1, over, equal, over + 1, over + 1 + equal))
    assert {tuple(r) for r in ranks(Tables(spark, str(tmp_path))).collect()} == want


def test_alignment_moves_bindings_once(spark):
    rng = random.Random(8)
    side = lambda: [(f"s{rng.randint(0, 4)}", "r", rng.randint(0, 5), rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None])) for _ in range(120)]
    gold, pred = side(), side()
    table = lambda rows: spark.createDataFrame(rows, "scope string, relation string, fact long, role string, ident string")
    found = extraction.aligned(table(gold), table(pred))
    assert moves(found) == 1
    want = set()
    for scope in {r[0] for r in gold} & {r[0] for r in pred}:
        g, p = ([r for r in rows if r[0] == scope] for rows in (gold, pred))
        big, count = min(len(g), len(p)) + 1, lambda rows, f, key: [key(r) for r in rows if r[2] == f and None not in key(r)]
        pairs = {}
        for a in {r[2] for r in g}:
            for b in {r[2] for r in p}:
                both = []
                for key in (lambda r: (r[4],), lambda r: (r[3], r[4])):
                    x, y = count(g, a, key), count(p, b, key)
                    both.append(sum(min(x.count(k), y.count(k)) for k in set(x)))
                if both[0]:
                    pairs[str(a), str(b)] = both
        for a, b in assign.best({k: big * v + c for k, (v, c) in pairs.items()}):
            want.add((scope, a, b, *pairs[a, b]))
    assert {tuple(r) for r in found.collect()} == want


def test_stores_write_what_is_read(spark, tmp_path):
    """A layout is written when it is asked for, and facts that come twice are stored once, also where only their texts agree."""
    from rolefold.operators import keys, reads
    from rolefold.sources import star
    from rolefold.sources.store import Store, once

    rows = [(k, k % 3, k % 2, 1, 5.0, price, 0.0, 0.0, "R", "F", "1998-01-02") for k in range(6) for price in ((7.001, 7.002) if k == 2 else (7.0, 8.0) if k == 3 else (7.0,))]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    table = spark.createDataFrame(rows, columns).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    table.union(table.where("l_orderkey = 1")).write.parquet(f"{tmp_path}/lineitem.parquet")
    wide = star.wide(spark, str(tmp_path), "supplied")
    store = Store(spark, f"{tmp_path}/store", once(wide), "supplied")
    assert store.rows.count() == store.rows.select("id").distinct().count() == 7
    part = reads.find(store.values("part"), "supplied", [("part", "p:2")])
    assert os.listdir(f"{tmp_path}/store") == ["by_value"] and os.listdir(f"{tmp_path}/store/by_value") == ["role=part"]
    ids = lambda where: sorted(r["id"] for r in wide.where(where).select("id").distinct().collect())
    assert sorted(r["fact_id"] for r in part.collect()) == ids("part = 'p:2'")
    assert sorted(r["id"] for r in keys.find_by_key(store.facts, "supplied", {"order": "o:3", "line": "1"}).collect()) == ids("`order` = 'o:3'")
    everything = lambda df: sorted(map(tuple, df.select("fact_id", "relation", "bid", "role", "slot", "value_kind", "ident", "first").collect()))
    assert everything(store.by_value) == everything(store.by_fact) == everything(store.bindings())
    heads = star.facts(store.rows.withColumn("key_digest", keys.key_digest_column("supplied")), "supplied", ("key_digest",))
    assert store.facts.columns == heads.columns and sorted(map(tuple, store.facts.collect())) == sorted(map(tuple, heads.collect()))
    degrees = {r["ident"]: r["degree"] for r in reads.degree(store.bindings("order", "supplier")).collect()}
    assert degrees == {"o:0": 1, "o:1": 1, "o:2": 1, "o:3": 2, "o:4": 1, "o:5": 1, "s:0": 3, "s:1": 4}
    two = reads.two_hop(store.by_value, "o:2", store.by_fact)
    assert sorted(map(tuple, reads.two_hop_of_rows(wide, ["order", "part", "supplier"], "o:2").collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_an_items_log_stays_together_when_joins_change_while_running(spark):
    """At size the join with items is planned as a sort-merge join and becomes a broadcast join later, whose rows lie as they did before it."""
    from rolefold.operators import queue
    from rolefold.plans import checks
    from rolefold.plans.base import Tables

    judged = lambda: {(r["target"], r["line"]): (r["how"], r["code"], r["state"]) for r in queue.judge(*checks.full_log(Tables(spark, "/root/testdata/sf0.001"))).collect()}
    want = judged()
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "10485760")
        spark.conf.set(names[2], "false")
        assert judged() == want
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_a_containers_parts_are_one_text(spark, tmp_path):
    """A folder of several parts is numbered over all of them, so that a large container needs no single file."""
    from rolefold.sources import container

    folder = tmp_path / "c"
    folder.mkdir()
    lines = ['{"format": "records/1.0"}', *(f'{{"kind": "entity", "id": "e{i}"}}' for i in range(7))]
    for part, some in enumerate((lines[:3], [], lines[3:5], ["", *lines[5:]])):
        (folder / f"part-0000{part}.txt").write_text("".join(f"{x}\n" for x in some))
    rows = container.read_lines(spark, f"file://{folder}")
    assert sorted(r["n"] for r in rows.collect()) == list(range(8))
    assert sorted(r["id"] for r in container.records(rows).collect()) == [f"e{i}" for i in range(7)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_documents_are_read_by_line_and_others_whole(spark, tmp_path):
    from rolefold.sources import hif, star

    wide = star.wide(spark, "/root/testdata/sf0.001", "placed").limit(40)
    facts, bindings = star.facts(wide, "placed"), star.bindings(wide, "placed")
    hif.write(facts, bindings, f"file://{tmp_path}/doc")
    read = hif.Read(spark, f"file://{tmp_path}/doc")
    assert "collect_list" not in plan(read.bindings())
    text = "".join(line for (line,) in hif.document(facts, bindings).collect())
    (tmp_path / "one.json").write_text(text.replace('"nodes":[', '"nodes": [\n'))
    whole = hif.Read(spark, f"file://{tmp_path}/one.json")
    assert "collect_list" in plan(whole.bindings())
    everything = lambda r: [sorted(map(repr, t.collect())) for t in (r.nodes, r.edges, r.incidences, r.bindings(), r.facts())]
    assert everything(read) == everything(whole) and all(everything(read))


def test_identity_labels_move_facts_once(spark):
    from rolefold.operators import keys

    rng = random.Random(6)
    facts = [(f"f{i:02d}", f"k{i % 4}", 0, 1, 5 + i % 3, 6 + i % 3) for i in range(40)]
    bound = [(f[0], role, slot, kind, value) for f in facts for role, slot in (("a", "core"), ("b", "qualifier")) for kind, value in rng.choices([("entity", "x"), ("novalue", "none"), ("literal", "y")], k=rng.randint(0, 3))]
    table = spark.createDataFrame(facts, "id string, key_digest string, s_lo long, s_hi long, e_lo long, e_hi long")
    bindings = spark.createDataFrame(bound, "fact_id string, role string, slot string, value_kind string, ident string")
    cells = [(f[0], [b[1:] for b in bound if b[0] == f[0]]) for f in facts]
    rows = table.join(F.broadcast(spark.createDataFrame(cells, "id string, cells array<struct<role:string,slot:string,value_kind:string,ident:string>>")), "id")
    found = keys.relate_rows(rows, complete=("b",))
    assert plan(found).count("Exchange hashpartitioning(key_digest") == moves(found)
    got = {(r["incoming"], r["stored"]): r["label"] for r in found.collect()}
    assert got == {(r["incoming"], r["stored"]): r["label"] for r in keys.relate(table, bindings, complete=("b",)).collect()}
    bags = {f: sorted(map(tuple, c)) for f, c in cells}
    assert len(got) == sum(bool(bags[x[0]]) and bool(bags[y[0]]) for x in facts for y in facts if x[1] == y[1] and x[0] > y[0])
    assert all((label == "duplicate") == (bags[x] == bags[y]) for (x, y), label in got.items())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_gathered_bindings_are_moved_as_they_are(spark):
    """Facts are put together after their bindings have moved, so nothing is sorted and spilled on the way; digests of wide rows move nothing."""
    from rolefold.operators import keys, project
    from rolefold.operators.scorers import completion
    from rolefold.plans import values
    from rolefold.plans.base import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    digests = values.core_key(spark, t.dir)
    assert moves(digests) == 0
    want = keys.content_digests(t.bindings("supplied")).select("fact_id", "core_key")
    assert {tuple(r) for r in digests.collect()} == {tuple(r) for r in want.collect()}
    bound = t.bindings("supplied").withColumn("slot", F.col("slot"))
    for made in (project.by_role(bound, "supplied"), project.arity(bound), completion.build_queries(bound), keys.content_digests(bound)):
        text = plan(made)
        assert moves(made) == 1 and "REPARTITION_BY_COL" in text and "Aggregate" not in text[text.index("REPARTITION_BY_COL"):]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_record_rules_read_bindings_once(spark):
    """What the rules look at is stored, so no rule numbers the order lines again; new evidence meets itself without a join."""
    from rolefold.plans import events, rules

    found = rules.record_findings(spark, "/root/testdata/sf0.001")
    assert "Window" not in plan(found) and found.where("code = 'S002'").count()
    evidence = plan(events._evidence(spark, "/root/testdata/sf0.001")[1])
    assert evidence.count("Join") == 5
