"""The pipeline's stages on small tables with every odd case, and the whole of it against what its stages promise."""

from __future__ import annotations

import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rolefold.llm import charlm, common

BAD = ["grumwit", "fooldork", "snarkle"]
SYLLABLES = {"aa": ["ba", "ti", "lo", "shu", "re"], "bb": ["kra", "vek", "mon", "pli", "dus"]}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", kept long, rows string, place int, row string, key long, root int, label string, score double"
JUNK = "qzxv wkjq pplm zzxq vbnk qwrt ztpk hjkl xcvb " * 4
FOREIGN = "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 3


def corpus():
    rng = random.Random(7)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    text = lambda lang, n: [word(lang) for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        lang = ("aa", "bb")[i % 2]
        words = text(lang, rng.randint(30, 60))
        if toxic := i % 8 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), lang, f"s{i % 3}" if i % 7 else None))
        labels.append((i, 1, int(toxic)))
    first = text("aa", 90)
    near = [*first[:40], "tiba", *first[41:]]  # one word of ninety: likeness 0.89
    far = [w if n % 6 else "rere" for n, w in enumerate(first)]  # one word of six: below 0.8
    rows += [(1000, " ".join(first), "aa", "s0"), (1001, " ".join(first), "aa", "s1"), (1002, " ".join(near), "aa", "s1"), (1003, " ".join(far), "aa", "s0")]
    rows += [(1100, " ".join(text("bb", 6000)), "bb", "s2"), (1101, None, "aa", "s0"), (1102, "", "aa", "s0"), (1103, "12 ... 34", "aa", "s0"), (1104, JUNK, None, "s1"), (1105, FOREIGN, None, "s1")]
    rows += [(None, " ".join(text("aa", 40)), "aa", "s0"), (None, " ".join(text("bb", 40)), "bb", None), (3, rows[3][1], "bb", "s0"), (3, rows[3][1], "bb", "s0")]
    rows += [(1200, "ba ti " + " ".join(text("aa", 30)) + " grumw1t", "aa", "s0"), (1201, " ".join(text("bb", 30)) + " f o o l d o r k", "bb", "s0")]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, rows


def clashing(docs):
    """The same documents with columns named like those that operators use inside."""
    return docs.select("*", F.lit(1).cast("long").alias("kept"), F.lit("x").alias("rows"), F.lit(2).alias("place"), F.lit("r").alias("row"), F.lit(3).cast("long").alias("key"), F.lit(4).alias("root"), F.lit("l").alias("label"), F.lit(0.5).alias("score"))


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_toxic_documents_go(spark, tables):
    folder, docs, rows = tables
    got = ids(pipeline.toxic_documents(spark, clashing(docs), folder))
    bad = {i for i, t, *_ in rows if t and any(b in t for b in BAD)} | {1200, 1201}
    every = collections.Counter(i for i, *_ in rows)
    assert sum(got[i] for i in bad) <= 0.1 * len(bad)
    gone = {i for i in every if i not in bad and got[i] != every[i]}
    assert len(gone) <= 3 and not gone & {None, 1100, 1101, 1102, 1103}, "clean documents stay, empty ones too"


def test_unknown_languages_go(spark, tables):
    folder, docs, rows = tables
    got = ids(pipeline.unknown_languages(spark, clashing(docs), folder))
    gone = {1101, 1102, 1103, 1104, 1105}  # no letters, junk, a language that no document is known to be of
    assert got == collections.Counter(i for i, *_ in rows if i not in gone)


def test_one_of_each_group_stays(spark, tables):
    folder, docs, rows = tables
    found = pipeline.near_duplicates(spark, clashing(docs), folder)
    assert found.columns == pipeline.COLUMNS
    got = ids(found)
    assert got[1000] == 1 and not got[1001] and not got[1002] and got[1003] == 1
    assert got[3] == 1, "equal rows with equal ids are one"
    assert got[None] == 2, "rows without an id are no copies of each other"
    assert got[1101] == 1 and not got[1102], "texts without words are alike"


def test_mixture_takes_sources_by_weight(spark, tables):
    folder, docs, rows = tables
    mixed = pipeline.source_mixture(spark, docs, folder)
    assert mixed.columns == pipeline.COLUMNS
    words = lambda rs: collections.Counter({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rs if r["source"] == s) for s in {r["source"] for r in rs}})
    before, after = words(docs.collect()), words(made := mixed.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in made)
    names = sorted(s for s in before if s) + [None]
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    rate, capped = sum(before.values()) / sum(weights.values()), set()
    while more := {s for s in names if s not in capped and rate * weights[s] > 3 * before[s]}:
        capped |= more
        rate = (sum(before.values()) - sum(3 * before[s] for s in capped)) / sum(weights[s] for s in names if s not in capped)
    for s in names:
        want = 3 * before[s] if s in capped else rate * weights[s]
        assert abs(after[s] - want) <= max(130, 0.05 * want)


def test_run_keeps_what_each_stage_promises(spark, tables):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    folder, docs, rows = tables
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    step = docs
    for name, stage in pipeline.STAGES[:-1]:
        step = pipeline.saved(stage(spark, step, folder), name)
        assert step.columns == pipeline.COLUMNS
    lengths = collections.Counter()
    for r in step.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        lengths.update([4096] * (n // 4096) + ([n % 4096] if n % 4096 else []))
    got = pipeline.run(spark, folder).collect()
    assert collections.Counter(r["length"] for r in got) == lengths, "the run is its stages, one after another"
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0 and sum(n for _, n in spans) <= 4096
    assert not {r["doc_id"] for r in got} & {1001, 1002, 1104, 1105, 1200, 1201}


def test_empty_tables_pass_through(spark, tables):
    folder, docs, _ = tables
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_texts_reach_python_in_small_batches(spark, tables):
    import pyarrow as pa

    from rolefold.llm import common

    folder, docs, _ = tables
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = lambda: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    before = spark.conf.get(key)
    try:
        large = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
        spark.conf.set(key, "64m")
        found = common.id_text(large, "doc_id", "text").mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in found) == 300 and max(r["bytes"] for r in found) < common.BATCH + 200_000
        for _, stage in pipeline.STAGES:
            spark.conf.set(key, "64m")
            stage(spark, docs, folder)
            assert bound() == common.BATCH, "what a stage leaves to its writer is bounded, too"
        spark.conf.set(key, "1m")
        common.small_batches(spark)
        assert bound() == 1 << 20
    finally:
        spark.conf.set(key, before)


class Recorded:
    """Stands in for a table: remembers the task that mapInArrow gets."""

    def select(self, *_):
        return self

    groupBy = agg = select

    def mapInArrow(self, task, _):
        self.task = task
        return self


def test_ngrams_are_listed_for_few_words_at_once_and_all_counted(spark, monkeypatch):
    rows, listed, released = Recorded(), [], []
    monkeypatch.setattr(charlm, "windows", lambda words, order, f=charlm.windows: listed.append(len(words)) or f(words, order))
    monkeypatch.setattr(common, "release", lambda: released.append(1))
    charlm.gram_counts(rows, "lang", "text")
    words = ["".join("abcdefghij"[int(d)] for d in str(n)) for n in range(50_000)]
    batches = pa.table({"class": ["aa", "aa"], "text": pa.array([" ".join(words).encode(), " ".join(words[:9]).encode()])}).to_batches()
    found = collections.Counter()
    for b in rows.task(iter(batches)):
        for r in b.to_pylist():
            found[r["gram"]] += r["n"]
    padded = [f"   {w}   " for w in [*words, *words[:9]]]
    assert found == collections.Counter(w[i : i + 4] for w in padded for i in range(len(w) - 5))
    assert sum(listed) == 50_000 and max(listed) <= 20_000, "n-grams of a whole vocabulary are never listed at once"
    assert released == [1], "a task gives its memory back when its rows are out"


def test_a_task_gives_memory_back_to_the_system():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon"))

    pins = []

    def task(batches):
        yield from batches
        blocks = [bytes(1000) for _ in range(200_000)]
        pins.append(bytes(1000))  # what outlives the task stands above what it used
        del blocks

    before = held()
    list(common.lean(task)(iter([])))
    assert held() - before < 60_000, "200 MB were used"
