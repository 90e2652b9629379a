"""A hidden Markov language model over whole texts, trained by Baum-Welch.

A token's observation is its class.  A word with at least one in ``own`` of all
training tokens is a class of its own (there can't be more than ``own``); other
words share classes by a hash of their last bytes; the end token is a class.  A
latent state emits classes, and a class emits its tokens by add-one counts (with
one place for unseen ones), so the model is a distribution over all texts:
P(text) = sum over state paths of start * transitions * class emissions, times
the product of P(token | class).

Counts are exact and distributed: a pass over the texts replaces tokens by
numbers local to a chunk of documents and hands on each chunk's distinct tokens
(64-bit hashes) with their counts; chunks' tokens meet by hash range, and the
sums return to their chunks.  The vocabulary is never in one place.

Baum-Welch is stepwise (incremental EM): the training tokens, cut into segments of
``segment`` tokens, are dealt into ``slices``; a round takes the expected counts
(states x classes, summed across partitions) of one slice and moves the running
counts towards them, by less from round to round.  Every slice is read equally
often, so all training tokens count alike at every size of the corpus.  Scoring is
the scaled forward recursion over whole texts, exact whatever their length.

Defined cases: null text is empty text, which is one end token; null ids are in
the training fold by the empty text's crc32; repeated rows count one by one;
with nothing to learn from, counts are zero and all states alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH, forget, id_text, release, saved, width

END = b"\n"  # no word holds white space
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ------------------------------------------------------------------ indexing


def class_of(word: bytes, classes: int) -> int:
    """Words that end alike share one of ``classes`` classes; the end token has class 0 for itself."""
    import zlib

    return 0 if word == END else 1 + zlib.crc32(word[-4:].rstrip(b".,")) % (classes - 1)


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    """A batch's rows one by one: its binary values as views of the batch, not copies."""
    columns = [_views(c) if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else (x.as_py() for x in c) for c in batch.columns]
    return map(list, zip(*columns, strict=True))


def _views(column: pa.Array) -> Iterator[pa.Buffer]:
    _, ends, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else []
    data = pa.py_buffer(b"") if data is None else data
    return (data.slice(s, e - s) for s, e in zip(at, at[1:], strict=False))


def _index(classes: int, rows_per_chunk: int, bytes_per_chunk: int):
    """Chunks of documents: ids, folds and token numbers; the distinct tokens with hashes, classes and counts."""
    import uuid

    import xxhash

    def emit(chunk: list[tuple]) -> pa.RecordBatch:
        place: dict[bytes, int] = {END: 0}
        get = place.setdefault
        numbers = [np.array([get(w, len(place)) for w in t.lower().split()] + [0], np.int32) for _, _, t in chunk]
        flat = np.concatenate(numbers)
        sizes = np.array([len(x) for x in numbers], np.int64)
        train = np.repeat(np.array([h is False for _, h, _ in chunk]), sizes)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in place], np.uint64)
        kinds = np.array([class_of(w, classes) for w in place], np.int32)
        counts = np.bincount(flat[train], minlength=len(place))
        order = np.argsort(hashes, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        blobs = [back[flat].tobytes(), hashes[order].tobytes(), kinds[order].tobytes(), counts[order].astype(np.int64).tobytes()]
        cols = [
            pa.array([f"{xxhash.xxh64_hexdigest(blobs[0])}-{uuid.uuid4().hex}"]),
            pa.array([[d for d, _, _ in chunk]], pa.list_(pa.int64())),
            pa.array([[h for _, h, _ in chunk]], pa.list_(pa.bool_())),
            pa.array([sizes.tolist()], pa.list_(pa.int64())),
            pa.array([int(counts.sum())], pa.int64()),
            *(pa.array([x], pa.binary()) for x in blobs),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in CHUNK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for b in batches:
            for row in zip(*((x.as_py() for x in c) for c in b.columns), strict=True):
                chunk.append(row)
                size += len(row[2])
                if len(chunk) >= rows_per_chunk or size >= bytes_per_chunk:
                    yield emit(chunk)
                    chunk, size = [], 0
                    release()
        if chunk:
            yield emit(chunk)
        chunk = None
        release()

    return run


CHUNK = "chunk string, ids array<long>, held array<boolean>, sizes array<long>, trained long, tokens binary, hashes binary, kinds binary, counts binary"


#: Bytes of a stored value that travel in one row; a chunk's rows follow each other.  The JVM gives arrays from half
#: a MB up regions of their own (G1, heaps below 4 GB), and its heap grows with each that finds none.
PIECE = 1 << 18
PIECES = "chunk", "what", "part", "ids", "held", "sizes", "blob"


def _pieces(chunks: DataFrame, *columns: str) -> DataFrame:
    """Rows PIECES of stored chunks: their lists (what 0), then pieces of each column (what 1 and on); no shuffle."""
    kept = [F.struct(F.lit(0).alias("what"), "ids", "held", "sizes", F.lit(b"").alias("blob"))]
    empty = [F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in PIECES[3:6]]
    kept += [F.struct(F.lit(i).alias("what"), *empty, F.col(c).alias("blob")) for i, c in enumerate(columns, 1)]
    rows = chunks.select("chunk", F.explode(F.array(*kept)).alias("x")).select("chunk", "x.*")
    last = F.greatest(F.length("blob") - 1, F.lit(0))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(last / PIECE).cast("int"))))
    return rows.select(*PIECES[:-1], F.substring(F.col("blob"), F.col("part") * PIECE + 1, F.lit(PIECE)).alias("blob"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Chunks of their pieces: ids, held, sizes, then each column's bytes."""
    name, lists, blobs = None, None, {}

    def whole() -> list:
        return [*lists, *(b"".join(blobs[i]) for i in sorted(blobs))]

    for b in batches:
        for chunk, what, _, ids, held, sizes, blob in _rows(b):
            if chunk != name:
                if name is not None:
                    yield whole()
                name, blobs = chunk, {}
            if what:
                blobs.setdefault(what, []).append(blob)
            else:
                lists = ids, held, sizes
    if name is not None:
        yield whole()


def _each(make):
    """A batch out of each chunk; what it took is given back before the next is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _joined(batches):
            made = make(*x)
            x = None  # noqa: PLW2901
            release()
            yield made
            del made

    return run


BLOBS = ("hashes", "kinds", "counts")


def _deal(ranges: int):
    """A chunk's distinct tokens by hash range, still sorted."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, *blobs in _rows(b):
                h, k, n = map(memoryview, blobs)
                hashes = np.frombuffer(h, np.uint64)
                cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
                some = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
                part = lambda raw, size: pa.array([raw[cuts[i] * size : cuts[i + 1] * size] for i in some], pa.binary())  # noqa: B023, E731
                cols = [pa.array(some, pa.int32()), pa.array([chunk] * len(some)), part(h, 8), part(k, 4), part(n, 8)]
                yield pa.RecordBatch.from_arrays(cols, names=["range", "chunk", "hashes", "kinds", "counts"])
            b = chunk = blobs = h = k = n = hashes = cols = None  # noqa: PLW2901
            release()

    return run


def _sum_range(own: int, trained: int):
    """Corpus counts of one hash range, returned to its chunks; of the rows without chunk,
    range -1 has totals per class and -2 the frequent tokens (hash, class, count)."""

    def run(rows: pa.Table) -> pa.Table:
        number = rows["range"][0].as_py()
        parts = [tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.uint64, np.int32, np.int64), strict=True)) for row in zip(*(rows[c] for c in BLOBS), strict=True)]
        # a chunk's tokens are distinct and sorted, so each chunk finds its places by itself
        hashes = np.concatenate([h for h, _, _ in parts])
        hashes.sort()
        hashes = hashes[np.r_[True, hashes[1:] != hashes[:-1]]] if len(hashes) else hashes
        total, kinds = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32)
        for h, k, n in parts:
            at = np.searchsorted(hashes, h)
            total[at] += n
            kinds[at] = k
        out = [(chunk, number, total[np.searchsorted(hashes, h)].tobytes()) for chunk, (h, _, _) in zip(rows["chunk"].to_pylist(), parts, strict=True)]
        known = total > 0
        by_class = np.bincount(kinds[known], total[known]), np.bincount(kinds[known])
        both = np.zeros((2, max(map(len, by_class))), np.int64)
        for i, x in enumerate(by_class):
            both[i, : len(x)] = x
        out.append((None, -1, both.tobytes()))
        often = (total.astype(float) * own > trained) & (kinds > 0)
        found = np.stack([hashes[often].view(np.int64), kinds[often], total[often]])
        out.append((None, -2, found.astype(np.int64).tobytes()))
        kinds_of = (pa.string(), pa.int32(), pa.binary())
        del parts, hashes, kinds, total, known, often
        made = pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_of, strict=True)], names=["chunk", "range", "totals"])
        del out
        release()
        return made

    return run


def _in_turn(make):
    """A group's table made of its table, both in batches of a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(pa.Table.from_batches(batches))
        yield from made.to_batches(max_chunksize=max(1, made.num_rows * BATCH // max(made.nbytes, 1)))
        del made
        release()

    return run


class Classes:
    """Classes of tokens: shared ones first, then one for each frequent token."""

    def __init__(self, shared: int, often: np.ndarray):
        """often: frequent tokens' hashes, by rising hash."""
        self.shared, self.often = shared, often

    def of(self, hashes: bytes, kinds: bytes) -> np.ndarray:
        h, found = np.frombuffer(hashes, np.uint64), np.frombuffer(kinds, np.int32)
        if not len(self.often):
            return found
        at = np.minimum(np.searchsorted(self.often, h), len(self.often) - 1)
        return np.where(self.often[at] == h, self.shared + at, found).astype(np.int32)


# --------------------------------------------------------------------- model


class Hmm:
    def __init__(self, states: int, classes: int, class_tokens: np.ndarray, class_types: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.class_tokens, self.class_types = class_tokens, class_types  # N and V of each class
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(self.move, 0.95 if states > 1 else 1.0)
        base = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
        self.emit = base[None, :] * rng.uniform(0.5, 1.5, (states, classes))
        self.emit /= self.emit.sum(axis=1, keepdims=True)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Maximise with a small prior, so nothing gets probability zero."""
        base = (self.class_tokens + 0.5) / (self.class_tokens + 0.5).sum()
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 1) / (move + 1).sum(axis=1, keepdims=True)
        self.emit = emit + base[None, :] * 50 + 1e-3
        self.emit /= self.emit.sum(axis=1, keepdims=True)

    def token_log10(self, counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """log10 P(token | class) by add-one counts."""
        return np.log10((counts + 1) / (self.class_tokens[kinds] + self.class_types[kinds] + 1))

    def expected(self, obs: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """E-step over equally long segments (rows of obs, ``many`` tokens of each are real)."""
        rows, steps = obs.shape
        states = len(self.start)
        many = np.full(rows, steps) if many is None else many
        live = np.arange(steps)[None, :] < many[:, None]
        e = np.where(live[:, :, None], self.emit.T[obs], 1.0)
        alpha, scale = np.empty((steps, rows, states)), np.empty((steps, rows))
        a = self.start * e[:, 0]
        for t in range(steps):
            if t:
                a = (a @ self.move) * e[:, t]
            scale[t] = a.sum(axis=1)
            a = a / scale[t][:, None]
            alpha[t] = a
        beta = np.ones((rows, states))
        move = np.zeros_like(self.move)
        gamma = np.empty((steps, rows, states))
        for t in range(steps - 1, -1, -1):
            gamma[t] = alpha[t] * beta
            if t:
                # steps past a segment's end count nothing
                b = e[:, t] * beta / scale[t][:, None]
                move += (alpha[t - 1] * live[:, t][:, None]).T @ b
                beta = b @ self.move.T
        gamma *= live.T[:, :, None]
        emit = np.stack([np.bincount(obs.T.ravel(), gamma[:, :, k].ravel(), self.emit.shape[1]) for k in range(states)])
        return gamma[0].sum(axis=0), move * self.move, emit

    def log10_classes(self, docs: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion over whole sequences of classes, all documents at once."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        sizes = np.array([len(docs[i]) for i in order])
        flat = np.concatenate([docs[i] for i in order])
        starts = np.cumsum(sizes) - sizes
        total = np.zeros(len(docs))
        emit = np.ascontiguousarray(self.emit.T)
        a = self.start * emit[flat[starts]]
        for t in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, "left"))  # sizes > t
            if t:
                a = (a[:live] @ self.move) * emit[flat[starts[:live] + t]]
            scale = a.sum(axis=1)
            a /= scale[:, None]
            total[:live] += np.log10(scale)
        out = np.empty(len(docs))
        out[order] = total
        return out


# ------------------------------------------------------------------ training

SLICED = "slice int, sizes array<long>, classes binary"


def _slices(classes_of: Classes, slices: int, segment: int):
    """Training segments of chunks, dealt into slices: a row per chunk and slice."""

    def of(_: list, held: list, sizes: list, tokens: bytes, hashes: bytes, kinds: bytes) -> pa.RecordBatch:
        obs = classes_of.of(hashes, kinds).astype(np.uint16)[np.frombuffer(tokens, np.int32)]
        ends = np.cumsum(sizes)
        cuts = [(s, min(s + segment, e)) for h, e, n in zip(held, ends.tolist(), sizes, strict=True) if not h for s in range(e - n, e, segment)]
        parts = [cuts[i::slices] for i in range(slices)]
        some = [i for i in range(slices) if parts[i]]
        cols = [
            pa.array(some, pa.int32()),
            pa.array([[e - s for s, e in parts[i]] for i in some], pa.list_(pa.int64())),
            pa.array([np.concatenate([obs[s:e] for s, e in parts[i]]).tobytes() for i in some], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["slice", "sizes", "classes"])

    return _each(of)


def _expected(shared):
    """Expected counts of a partition's segments: rows (kind, number, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = shared.value
        sums = None
        for b in batches:
            for sizes, classes in _rows(b):
                obs, many = np.frombuffer(classes, np.uint16), np.array(sizes)
                starts = np.cumsum(many) - many
                order = np.argsort(many, kind="stable")
                for at in range(0, len(order), 512):
                    part = order[at : at + 512]
                    rows = np.zeros((len(part), int(many[part].max())), np.int32)
                    for i, j in enumerate(part.tolist()):
                        rows[i, : many[j]] = obs[starts[j] : starts[j] + many[j]]
                    found = model.expected(rows, many[part])
                    sums = found if sums is None else [x + y for x, y in zip(sums, found, strict=True)]
        release()
        if sums is not None:
            start, move, emit = sums
            rows = [(0, 0, start), *((1, i, x) for i, x in enumerate(move)), *((2, i, x) for i, x in enumerate(emit.T) if x.any())]
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
            cols.append(pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "number", "values"])

    return run


def train(sliced: DataFrame, model: Hmm, rounds: int, slices: int) -> Hmm:
    """Stepwise Baum-Welch over stored slices; round n reads slice n modulo slices."""
    spark, states, running = sliced.sparkSession, len(model.start), None
    for n in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # states x classes numbers
        parts = sliced.where(F.col("slice") == n % slices).select("sizes", "classes")
        parts = parts.mapInArrow(_expected(shared), "kind int, number int, values array<double>")
        sums = parts.groupBy("kind", "number").agg(*(F.sum(F.col("values")[k]).alias(f"v{k}") for k in range(states)))
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
        for r in sums.collect():  # 1 + states + classes rows at most
            into = (start, move[r["number"]] if r["kind"] == 1 else None, emit[:, r["number"]] if r["kind"] == 2 else None)[r["kind"]]
            into += np.array(r[2:])
        step = (n + 1) ** -0.6
        fresh = [x * slices for x in (start, move, emit)]
        running = fresh if running is None else [(1 - step) * old + step * new for old, new in zip(running, fresh, strict=True)]
        model.update(*running)
        shared.unpersist()
    return model


def score_texts(
    df: DataFrame,
    held_out: Column,
    states: int = 8,
    classes: int = 4096,
    rounds: int = 12,
    slices: int = 6,
    segment: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_rows: int = 4000,
    chunk_bytes: int = 8 << 20,
    range_bytes: int = 32 << 20,
) -> DataFrame:
    """doc_id, held_out, counts, the add-one unigram base and the model's log10 probability.

    held_out is a condition over doc_id; half of the classes are for frequent words.
    """
    spark, own = df.sparkSession, classes // 2
    rows = id_text(df, id_col, text_col).select("doc_id", held_out.alias("held"), "text")
    chunks = saved(rows.mapInArrow(_index(classes - own, chunk_rows, chunk_bytes), CHUNK), "chunks", large=True)
    trained, distinct = chunks.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum(F.length("hashes")), F.lit(0))).first()
    # a range holds about range_bytes of hashes, classes and counts
    ranges = max(2 * width(spark), -(-distinct * 5 // (2 * range_bytes)))
    dealt = chunks.select("chunk", "hashes", "kinds", "counts").mapInArrow(
        _deal(ranges), "range int, chunk string, hashes binary, kinds binary, counts binary"
    )
    sums = saved(dealt.groupBy("range").applyInArrow(_in_turn(_sum_range(own, trained)), "chunk string, range int, totals binary"), "counts", large=True)
    totals, often = np.zeros((2, classes), np.int64), [np.zeros((3, 0), np.int64)]
    for r in sums.where("chunk IS NULL").select("range", "totals").toLocalIterator():  # classes and frequent tokens, both bounded
        found = np.frombuffer(r["totals"], np.int64)
        if r["range"] == -1:
            totals[:, : len(found) // 2] += found.reshape(2, -1)
        else:
            often.append(found.reshape(3, -1))
    hashes, kinds, many = np.concatenate(often, axis=1)
    order = np.argsort(hashes.view(np.uint64))
    known = Classes(classes - own, hashes.view(np.uint64)[order])
    # frequent words leave their shared classes
    np.subtract.at(totals[0], kinds, many)
    np.subtract.at(totals[1], kinds, 1)
    frequent = slice(classes - own, classes - own + len(order))
    totals[0, frequent], totals[1, frequent] = many[order], 1
    model = Hmm(states, classes, *totals.astype(float))
    stored = _pieces(chunks, "tokens", "hashes", "kinds")
    cut = stored.mapInArrow(_slices(known, slices, segment), SLICED)
    sliced = saved(cut, "slices", "slice", large=True)
    model = train(sliced, model, rounds, slices)
    forget(sliced)
    n, v = (int(x) for x in totals.sum(axis=1))
    # totals come after a chunk's own pieces; nothing travels in rows longer than a piece or a range's part
    empty = [F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in PIECES[3:6]]
    returned = sums.where("chunk IS NOT NULL").select("chunk", F.lit(4).alias("what"), F.col("range").alias("part"), *empty, F.col("totals").alias("blob"))
    met = stored.union(returned).repartition(width(spark), "chunk").sortWithinPartitions("chunk", "what", "part")
    shared = spark.sparkContext.broadcast((model, known))

    def score(ids: list, held: list, sizes: list, tokens: bytes, hashes: bytes, kinds: bytes, totals: bytes) -> pa.RecordBatch:
        model, known = shared.value
        counts = np.frombuffer(totals, np.int64)
        kind, token = known.of(hashes, kinds), np.frombuffer(tokens, np.int32)
        starts = np.cumsum(sizes) - sizes
        of = (np.log10((counts + 1) / (n + v + 1)), model.token_log10(counts, kind), (counts > 0).astype(float))
        base, inner, seen = (np.add.reduceat(x[token], starts) for x in of)
        seq = kind[token]
        docs = [seq[s : s + m] for s, m in zip(starts.tolist(), sizes, strict=True)]
        total = inner + model.log10_classes(docs)
        cols = [
            pa.array(ids, pa.int64()), pa.array(held), pa.array(sizes, pa.int64()), pa.array(seen.astype(np.int64)),
            pa.array(np.full(len(ids), n)), pa.array(base), pa.array(total),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return met.mapInArrow(_each(score), SCHEMA)
