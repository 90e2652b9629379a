"""Exact top-k inner products by distributed histogram selection.

Vectors are quantised to integers, so scores are exact and can be binned.  For
a block of queries every candidate is scored; the scores' histogram over all
candidates locates the bin that holds the k-th best value, and is refined inside
that bin until the value itself is known.  Rows above it, and of the ties at it
the smallest ids, are the answer.  Only histograms (queries x bins) and at most
k rows per query and task are ever shuffled, however many candidates tie.

Queries are taken in blocks of ``block`` rows, so what is sent to the executors
is bounded by block x dimensions whatever the table's size.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part; vectors of unequal length are compared as if padded with zeros;
rows with the query's own id are its own; a repeated query id is answered once,
for its smallest vector; repeated candidate rows count one by one; null ids take
no part; scores beyond 64 bits are clamped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEAST, MOST = -(2**63), 2**63 - 1


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id long, vec array<double> of integers): rows that take no part are gone."""
    xs = F.col("xs")
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("xs"))
    usable = xs.isNotNull() & F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def floor(x: Column) -> Column:
        # floor() of a double is a long and would overflow; from 2**52 on every double is whole
        y = F.lit(float(scale)) * x
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return rows.where(F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform(xs, floor).alias("vec"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows padded with zeros to ``dims``; components beyond it meet only zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        out[i, : min(n, dims)] = flat[end - n : end - n + min(n, dims)]
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, rows by queries."""
    if not rows.size or not queries.size:
        return np.zeros((len(rows), len(queries)), np.int64)
    top = np.abs(queries).max() * np.abs(rows).max() * queries.shape[1]
    if top < 2.0**53:
        return (rows @ queries.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    exact = whole(rows) @ whole(queries).T
    return np.array([[min(max(x, LEAST), MOST) for x in r] for r in exact], dtype=np.int64)


class Block:
    """A block of queries with, for each, the score range that still holds its k-th best."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bins: int):
        self.ids, self.vectors, self.k, self.bins = ids, vectors, k, bins
        self.low = np.full(len(ids), 0, np.int64)
        self.span = np.ones(len(ids), object)  # width of the range; the k-th best is known where it is 1
        self.wanted = np.full(len(ids), k, np.int64)  # how many from the top of the range on

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, scores, own): chunks of candidates against all queries."""
        dims = self.vectors.shape[1]
        for b in batches:
            ids = b.column(0).to_numpy()
            rows = _matrix(b.column(1), dims)
            for at in range(0, len(ids), 2048):
                part = slice(at, at + 2048)
                yield ids[part], scores(self.vectors, rows[part]), ids[part][:, None] == self.ids[None, :]


def _bounds(block: Block, candidates: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, many = np.full(len(block.ids), MOST), np.full(len(block.ids), LEAST), np.zeros(len(block.ids), np.int64)
        for _, s, own in block.scored(batches):
            low = np.minimum(low, np.where(own, MOST, s).min(axis=0, initial=MOST))
            high = np.maximum(high, np.where(own, LEAST, s).max(axis=0, initial=LEAST))
            many += (~own).sum(axis=0)
        q = np.flatnonzero(many)
        cols = [pa.array(x, pa.int64()) for x in (q, low[q], high[q], many[q])]
        yield pa.RecordBatch.from_arrays(cols, names=["q", "low", "high", "n"])

    found = candidates.mapInArrow(run, "q long, low long, high long, n long")
    return found.groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def _histogram(block: Block, candidates: DataFrame) -> DataFrame:
    """(q, bin, n) of the scores inside each query's range, summed over all candidates."""
    step = np.array([max(1, -(-int(w) // block.bins)) for w in block.span], np.uint64)
    live = np.flatnonzero([w > 1 for w in block.span])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(live) * block.bins, np.int64)
        low, width = block.low[live], np.array([int(block.span[i]) - 1 for i in live], np.uint64)
        for _, s, own in block.scored(batches):
            s, own = s[:, live], own[:, live]
            off = (s.view(np.uint64) - low.view(np.uint64)[None, :])  # modulo 2**64, right for s >= low
            inside = (s >= low) & (off <= width) & ~own
            at = (off // step[live]).astype(np.int64) + np.arange(len(live)) * block.bins
            seen += np.bincount(at[inside], minlength=len(seen))
        at = np.flatnonzero(seen)
        cols = [pa.array(x, pa.int64()) for x in (live[at // block.bins], at % block.bins, seen[at])]
        yield pa.RecordBatch.from_arrays(cols, names=["q", "bin", "n"])

    return candidates.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _located(histogram: DataFrame, block: Block) -> DataFrame:
    """Per query the bin that holds its k-th best, and how many are still wanted from it."""
    wanted = F.element_at(F.lit(block.wanted.tolist()), (F.col("q") + 1).cast("int"))
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    upto = histogram.withColumn("upto", F.sum("n").over(down))
    return upto.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select(
        "q", "bin", (wanted - F.col("upto") + F.col("n")).alias("left")
    )


def _answer(block: Block, candidates: DataFrame) -> DataFrame:
    """At most k rows per query and task: those above the k-th value and the first ties at it."""
    k = block.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 3), np.int64)  # q, score, id
        for ids, s, own in block.scored(batches):
            row, q = np.nonzero((s >= block.low) & ~own)
            if not len(row):
                continue
            kept = np.concatenate([kept, np.stack([q, s[row, q], ids[row]], 1)])
            order = np.lexsort((kept[:, 2], np.invert(kept[:, 1]), kept[:, 0]))
            kept = kept[order]
            first = np.searchsorted(kept[:, 0], kept[:, 0])
            kept = kept[np.arange(len(kept)) - first < k]
        cols = [pa.array(x, pa.int64()) for x in (block.ids[kept[:, 0]], kept[:, 2], kept[:, 1])]
        yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    found = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = 2048,
    bins: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own.

    is_query is a condition over the column vec_id.
    """
    spark = df.sparkSession
    rows = saved(quantised(df, id_col, vector_col), "quantised")  # every round of every block reads it
    asked = saved(rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id"), "queries")
    out, after = [], LEAST
    while True:
        part = asked.where(F.col("vec_id") > after) if out else asked
        rows_now = part.orderBy("vec_id").limit(block).collect()
        if not rows_now:
            break
        after = rows_now[-1]["vec_id"]
        dims = max(len(r["vec"]) for r in rows_now)
        vectors = np.array([r["vec"] + [0.0] * (dims - len(r["vec"])) for r in rows_now]).reshape(len(rows_now), dims)
        out.append(_answered(Block(np.array([r["vec_id"] for r in rows_now], np.int64), vectors, k, bins), rows))
        if len(rows_now) < block:
            break
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found.select("query_id", "rank", "vec_id", "score")


def _answered(block: Block, candidates: DataFrame) -> DataFrame:
    for r in _bounds(block, candidates).collect():
        block.low[r["q"]] = r["low"]
        block.wanted[r["q"]] = min(block.k, r["n"])
        block.span[r["q"]] = r["high"] - r["low"] + 1
    while any(w > 1 for w in block.span):
        for r in _located(_histogram(block, candidates), block).collect():
            q = r["q"]
            step = max(1, -(-int(block.span[q]) // block.bins))
            start = int(block.low[q]) + r["bin"] * step
            block.span[q] = min(step, int(block.low[q]) + int(block.span[q]) - start)
            block.low[q] = start
            block.wanted[q] = r["left"]
    return saved(_answer(block, candidates), "answers")
