"""Mixing sources to target weights in fixed-length blocks.

Each source's words, its documents one after another (by a hash of id and text,
then by id), are cut into blocks of ``block`` words.  A source's target becomes a number of slots; these are dealt
to output shards of ``shard`` slots by multinomial draws that keep each source's
total (multivariate hypergeometric, along a binary tree, so every shard finds its
own counts).  Slot t of a source takes block perm(t mod blocks), with a keyed
pseudorandom permutation per source and pass, so no block is taken twice more
than another; drawn blocks are joined to the documents by index.

All draws come from the seed and the sources' names: reruns agree.

Defined cases: null text has size 0 and is never taken; a null source is a source
of its own, last in order; equal rows lie side by side and count one by one; with
no words at all every target is 0; an empty table has no rows; texts of any length
are cut like others; other columns, whatever their names, pass through unread.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, saved, small_batches

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
DEALS = 1024  # parts in which a source's documents are put in order


def sizes_of(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc_id, source, size, sum64): number of words, and the text's hash."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        df[source_col].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("sum64"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, place, source_size, target): weights repeat over the sources by code point, null last.

    A target stops at ``most`` times its source's size; the excess is reshared
    by weight until none is above.
    """
    per = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ordered = per.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()  # sorted and numbered in parts
    rows = ordered.map(lambda x: (x[0]["source"], x[1], x[0]["source_size"], weights[x[1] % len(weights)]))
    placed = saved(sizes.sparkSession.createDataFrame(rows, "source string, place long, source_size long, weight int"), "placed")
    whole = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, rate = whole[0] or 0, 0.0
    while total:
        full = F.col("source_size") * most <= rate * F.col("weight")
        capped, open_ = placed.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        now = (total - capped) / open_ if open_ else rate
        if now <= rate:
            break
        rate = now
    target = F.least(F.col("source_size") * float(most), F.lit(float(rate)) * F.col("weight"))
    return placed.select("source", "place", "source_size", target.cast("double").alias("target"))


def positioned(sizes: DataFrame) -> DataFrame:
    """Adds ``start``, the words of the source before the document."""
    dealt = sizes.withColumn("deal", F.pmod(F.xxhash64("doc_id", "sum64"), F.lit(DEALS)))
    inside = Window.partitionBy("source", "deal").orderBy("doc_id", "size", "sum64").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("source", "deal").agg(F.sum("size").alias("words"))
    parts = parts.select(F.col("source").alias("s"), F.col("deal").alias("d"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    ordered = dealt.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(parts, ordered["source"].eqNullSafe(parts["s"]) & (ordered["deal"] == parts["d"]))
    return joined.select("doc_id", "source", "size", "sum64", (F.col("base") + F.col("own")).alias("start"))


# ---------------------------------------------------------------------- draws


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` drawn without replacement are good, by inversion around the mode; no number is too large.

    The window leaves out what lies more than 12 deviations from the mean (below 1e-30).
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    u = rng.random()
    if low == high:
        return low
    mean = n * good // total
    spread = 12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) + 12
    low, high = max(low, mean - int(spread)), min(high, mean + int(spread))
    k = np.arange(high - low, dtype=np.float64)
    # log of P(x + 1) / P(x) for x = low + k
    ratio = np.log((good - low) - k) + np.log((n - low) - k) - np.log((low + 1) + k) - np.log((bad - n + low + 1) + k)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(cdf, u * cdf[-1]))


def _split(counts: np.ndarray, part: int, key: list[int]) -> np.ndarray:
    """How many of each source's slots fall to the first ``part`` of all: a draw that keeps the totals."""
    rng, left, out = np.random.default_rng(key), int(counts.sum()), np.zeros_like(counts)
    for i, n in enumerate(counts.tolist()):
        left -= n
        out[i] = hypergeometric(n, left, part, rng) if part else 0
        part -= int(out[i])
    return out


def shard_counts(quotas: np.ndarray, shard: int, number: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots before, slots) per source of one output shard."""
    total = int(quotas.sum())
    low, high = 0, -(-total // shard)
    before, counts = np.zeros_like(quotas), quotas
    while high - low > 1:
        mid = (low + high) // 2
        left = _split(counts, (mid - low) * shard, [seed, low, high])
        if number < mid:
            counts, high = left, mid
        else:
            before, counts, low = before + left, counts - left, mid
    return before, counts


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(b"%d:%d" % (key, r), digest_size=8).digest(), "little")) for r in range(4)]

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    x = rounds(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = rounds(x[out])
    return x.astype(np.int64)


def draws(target_rows: DataFrame, block: int, shard: int, most: int, seed: int) -> DataFrame:
    """(place, block, times): how often each block of each source is taken."""
    spark = target_rows.sparkSession
    table = target_rows.where("source_size > 0").orderBy("place").collect()  # two numbers a source
    sizes = np.array([r["source_size"] for r in table], np.int64)
    blocks = -(-sizes // block)
    quotas = np.array([min(most * int(n), round(r["target"] * int(n) / r["source_size"])) for r, n in zip(table, blocks, strict=True)], np.int64)
    places = np.array([r["place"] for r in table], np.int64)
    names = [int.from_bytes(hashlib.blake2b(repr(r["source"]).encode(), digest_size=6).digest(), "little") for r in table]
    shards = -(-int(quotas.sum()) // shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number in b.column(0).to_pylist():
                before, counts = shard_counts(quotas, shard, number, seed)
                for i in np.flatnonzero(counts).tolist():
                    slot = np.arange(before[i], before[i] + counts[i])
                    for turn in np.unique(slot // blocks[i]).tolist():
                        own = slot[slot // blocks[i] == turn] % blocks[i]
                        taken = permuted(own, int(blocks[i]), names[i] * 8 + turn + seed)
                        cols = [pa.array(np.full(len(taken), places[i])), pa.array(taken)]
                        yield pa.RecordBatch.from_arrays(cols, names=["place", "block"])

    slots = spark.range(0, shards, 1, max(1, min(shards, 4096))).mapInArrow(lean(run), "place long, block long")
    return slots.groupBy("place", "block").agg(F.count("*").alias("times"))


def mixed(
    df: DataFrame, block: int = 64, shard: int = 1 << 16, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 11,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", with_blocks: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, sum64.

    with_blocks adds ``blocks``: (first word, words, times) of its part of each taken block.
    """
    sizes = saved(sizes_of(df, id_col, source_col, text_col), "sizes")
    goal = saved(targets(sizes, weights, most), "targets")
    named = positioned(sizes).join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = saved(named, "positions")
    some = whole.where("size > 0").select("place", "start", "size")
    ends = F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")
    spans = some.select("place", "start", "size", F.explode(ends).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")
    # both sides grow with the words: estimates from compressed files must not make one a broadcast
    hit = spans.hint("merge").join(draws(goal, block, shard, most, seed), ["place", "block"])
    hit = hit.select("place", "start", first.alias("first"), (last - first).alias("words"), "times")
    extra: list[Column] = [F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("blocks")] if with_blocks else []
    # (place, start) names a document that has words
    taken = hit.groupBy("place", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), *extra)
    found = whole.join(taken.withColumn("some", F.lit(True)), ["place", "start"], "left")
    real = F.col("size") > 0
    columns = ["doc_id", "source", "size", "source_size", "target", F.when(real, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), "sum64"]
    if with_blocks:
        columns.append(F.when(real, F.col("blocks")).alias("blocks"))
    return found.select(*columns)


_WORDS = re.compile(WORD)


def copies(text: str, blocks: list[dict]) -> list[str]:
    """The texts that a document gives to the mix: one per pass, from the blocks taken that often."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    out = []
    for turn in range(1, max((b["times"] for b in blocks), default=0) + 1):
        runs: list[list[int]] = []
        for b in blocks:
            if b["times"] >= turn:
                if runs and runs[-1][1] == b["first"]:
                    runs[-1][1] += b["words"]
                else:
                    runs.append([b["first"], b["first"] + b["words"]])
        if runs == [[0, len(spans)]]:
            out.append(text)
        elif runs:
            out.append("\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in runs))
    return out


def mix_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixture itself: rows like the documents', a row for each pass over what is taken of a document."""
    small_batches(df.sparkSession)
    plan = mixed(df, id_col=id_col, source_col=source_col, text_col=text_col, with_blocks=True, **options)
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))  # noqa: E731  equal rows: any order
    # the row goes through in one piece, whatever its columns are named
    docs = df.select(
        F.struct("*").alias("row"), df[id_col].cast("long").alias("k0"), df[source_col].cast("string").alias("k1"),
        F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))).alias("k2"),
    )
    docs = docs.withColumn("n", number("k0", "k1", "k2"))
    taken = plan.where("taken > 0").select(F.col("doc_id").alias("p0"), F.col("source").alias("p1"), F.col("sum64").alias("p2"), "blocks")
    taken = taken.withColumn("m", number("p0", "p1", "p2"))
    same = [docs[f"k{i}"].eqNullSafe(taken[f"p{i}"]) for i in range(3)] + [docs["n"] == taken["m"]]
    joined = docs.join(taken, same).select(F.col(f"row.`{text_col}`").cast("string").alias("text"), "blocks", "row")
    schema = df.select(F.struct("*").alias("row")).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                made = [(i, t) for i in range(at, min(at + 256, len(texts))) for t in copies(texts[i], blocks[i])]
                rows = pa.array([i for i, _ in made], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(2).take(rows), pa.array([t for _, t in made], pa.string())], names=["row", "text"])

    made = joined.mapInArrow(lean(run), schema)
    return made.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns))
