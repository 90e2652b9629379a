"""Document fingerprints from closed syncmers, and their likeness by positions.

A k-mer of code points is an anchor if the least hash among its inner s-mers
lies at one of its two edges: a property of the k-mer alone, so equal passages
give equal anchors wherever they stand, and every k - s + 1 neighbouring k-mers
hold one.  A fingerprint keeps the anchors whose hash is below a fixed threshold
(one in ``share``, so their number grows with the text), the ``floor`` least ones
at any rate, each with its first position; its first entry holds the number of all
distinct anchors and a digest of all of them with their positions, so a change
anywhere in the text shows.

Two fingerprints are compared over the hashes up to which both are complete: an
anchor is shared if both hold it and another shared anchor confirms its shift of
position (within ``drift``), so that common syllables in unrelated texts don't
count.  The likeness is Dice's coefficient; it is 1 for equal fingerprints alone.

Defined cases: null text is empty and has the empty fingerprint, which is like
itself alone; texts shorter than k, or without an anchor, have one anchor made
from the whole; repeated ids are ordered by their texts' digests; null ids come
first; a table of one row is followed by itself; an empty table has no rows;
texts of any length are read whole; other columns stay out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import width

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ENTRY = np.dtype([("hash", "<u4"), ("at", "<u4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def anchors(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all closed syncmers in a run of code points, and the k-mers' hashes there."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = np.zeros(len(codes) - s + 1, np.uint64)
    for i in range(s):
        inner = inner * np.uint64(0x100000001B3) + codes[i : i + len(inner)]
    inner = _mix(inner)
    w = k - s + 1
    least, span = inner, 1
    while span < w:  # sliding minimum by doubling
        step = min(span, w - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    n = len(least)
    at = np.flatnonzero((least == inner[:n]) | (least == inner[w - 1 : w - 1 + n]))
    whole = np.zeros(len(at), np.uint64)
    for i in range(0, k - s + 1, s):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + inner[at + i]
    return at, _mix(whole + inner[at + w - 1])


def fingerprints(texts: list[str], k: int = 10, s: int = 5, floor: int = 48, share: int = 16) -> list[np.ndarray]:
    """Of each text: an entry about all anchors, then the kept ones by rising hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    at, hashes = anchors(codes, k, s)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    low, high = np.searchsorted(at, starts), np.searchsorted(at, ends - k, "right")
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    out = []
    for text, start, i, j in zip(texts, starts.tolist(), low.tolist(), high.tolist(), strict=True):
        if i < j:
            every = _first(keys[i:j], start)
            below = int(np.searchsorted(every["hash"], np.uint32(2**32 // share)))
            head = np.array([(zlib.crc32(every.tobytes()), len(every))], ENTRY)
            out.append(np.concatenate([head, every[: max(below, floor)]]))
        elif text:
            digest = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little")
            out.append(np.array([(digest, 1), (digest, 0)], ENTRY))
        else:
            out.append(np.zeros(0, ENTRY))
    return out


def _first(keys: np.ndarray, start: int) -> np.ndarray:
    keys = np.sort(keys)
    hashes = (keys >> np.uint64(32)).astype(np.uint32)
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    out = np.empty(int(new.sum()), ENTRY)
    out["hash"] = hashes[new]
    out["at"] = (keys[new] & np.uint64(0xFFFFFFFF)) - np.uint64(start)
    return out


def text_of(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.tobytes()).decode()


def parsed(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ENTRY)


def _complete(kept: np.ndarray, every: int, floor: int, share: int) -> int:
    """The hash up to which the kept anchors are all that the text has."""
    return 2**32 - 1 if len(kept) == every else max(int(kept["hash"][-1]), 2**32 // share - 1)


def likeness(x: np.ndarray, y: np.ndarray, floor: int = 48, share: int = 16, drift: int = 32) -> float:
    """0 to 1 from the fingerprints alone; equal ones, and no others, are at 1."""
    if len(x) == len(y) and x.tobytes() == y.tobytes():
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    upto = min(_complete(f[1:], int(f["at"][0]), floor, share) for f in (x, y))
    a, b = (f[1:][: np.searchsorted(f["hash"][1:], np.uint32(upto), "right")] for f in (x, y))
    both, i, j = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    shift = np.sort(a["at"][i].astype(np.int64) - b["at"][j])
    if min(len(a), len(b)) > 3 and len(shift):
        near = np.diff(shift) <= drift
        shift = shift[np.r_[near, False] | np.r_[False, near]]
    most = 1 - 1 / (2 + max(int(x["at"][0]), int(y["at"][0])))  # all that is kept may agree
    return min(most, 2 * len(shift) / max(1, len(a) + len(b)))


def edited(text: str, after: str) -> str:
    """The last quarter replaced by the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def chained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lead, doc_id, text): ranges of ids in order, one per partition, each followed by the first rows of the next.

    Texts are shuffled once.  Only the ranges' bounds and first ids reach the driver.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    ids = rows.select(key.alias("key"))
    parts = width(spark)
    cuts = ids.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in cuts})
    number = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    firsts = ids.select("key", number.alias("part")).groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()
    placed = rows.select("doc_id", "text", key.alias("key")).withColumn("part", number)
    own = F.struct("part", F.lit(0).alias("lead"))
    if firsts:
        before = {r["first"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}
        to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("key")]
        where = F.when(to.isNull(), F.array(own)).otherwise(F.array(own, F.struct(to.alias("part"), F.lit(1).alias("lead"))))
    else:
        where = F.array(own)
    placed = placed.select("doc_id", "key", "text", F.explode(where).alias("to"))
    placed = placed.select(F.col("to.part").alias("part"), F.col("to.lead").alias("lead"), "key", "doc_id", "text")
    placed = placed.repartitionById(max(parts, 1), F.col("part"))
    return placed.withColumn("sha", F.sha1(F.col("text").cast("binary"))).sortWithinPartitions("lead", "key", "sha").select("lead", "doc_id", "text")


def with_next(
    df: DataFrame, k: int = 10, s: int = 5, floor: int = 48, share: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to the edited and the next one's."""

    def block(rows: list[tuple], after: tuple[str, np.ndarray], prints: list[np.ndarray]) -> pa.RecordBatch:
        following = [*zip((t for _, t in rows[1:]), prints[1:], strict=True), after]
        changed = [edited(t, x) for (_, t), (x, _) in zip(rows, following, strict=True)]
        new = fingerprints(changed, k, s, floor, share)
        cols = [
            pa.array([d for d, _ in rows], pa.int64()),
            pa.array([len(t) for _, t in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(map(text_of, prints), pa.string()),
            pa.array(map(text_of, new), pa.string()),
            pa.array([likeness(a, b, floor, share) for a, b in zip(prints, new, strict=True)], pa.float64()),
            pa.array([likeness(a, b, floor, share) for a, (_, b) in zip(prints, following, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        prints: list[np.ndarray] = []
        for part, is_lead in _parts(batches):
            fresh = fingerprints([t for _, t in part], k, s, floor, share)
            rows, own = held + part, prints + fresh
            if is_lead:
                if held:
                    yield block(held, (part[0][1], fresh[0]), prints)
                return
            # the last row waits for the one that follows it
            if len(rows) > 1:
                yield block(rows[:-1], (rows[-1][1], own[-1]), own[:-1])
            held, prints = rows[-1:], own[-1:]

    return chained(df, id_col, text_col).mapInArrow(run, SCHEMA)


def _parts(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[tuple[list[tuple], bool]]:
    """Rows in groups of about ``chars`` characters; a following range's rows come one by one."""
    part, size = [], 0
    for b in batches:
        for lead, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if lead:
                if part:
                    yield part, False
                    part, size = [], 0
                yield [(doc, text)], True
                continue
            part.append((doc, text))
            size += len(text)
            if size >= chars:
                yield part, False
                part, size = [], 0
    if part:
        yield part, False
