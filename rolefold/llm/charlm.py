"""Character language models with interpolated Kneser-Ney smoothing.

Models of several classes (languages) share one set of sorted hash arrays: per
order the hashes of all n-grams seen in any class, with one column of
log-probabilities per class, and the hashes of their contexts with back-off
weights.  Words are scored on their own, padded with spaces, so a word's score
is a constant that callers may keep.

Every n-gram of every row counts: counts, continuation counts, contexts' totals
and the numbers of n-grams seen once or twice are sums over the whole corpus,
none is left out or cut off.  An n-gram's place is a hash of ``BITS`` bits, which
bounds the arrays however large the corpus is (at most 2**BITS places per order,
12 bytes a place and 4 more per class); n-grams that share a place pool their
counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, saved

ORDER = 4
BITS = 22
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    """The word in lower case without what isn't a letter."""
    low = word.lower()
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_OTHER = bytes(x for x in range(128) if not chr(x).isalpha() and x not in b" \t\n\r\x0b\x0c")


def plain(text: bytes) -> bytes:
    """The text without the ASCII letters' case and ASCII characters that aren't letters or white space: letters() of
    its words are those of the text's words, empty ones apart, and far fewer words differ."""
    # a capital sigma's lower case depends on what stands beside it
    return text if b"\xce\xa3" in text else text.translate(_LOWER, _OTHER)


def windows(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the padded words as rows of code points, and each one's word number."""
    pad = " " * (order - 1)
    text = pad + pad.join(words) + pad if words else ""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    # a word of n letters has n + 1 n-grams: its letters and the end
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1) + np.repeat(starts, sizes + 1)
    return codes[first[:, None] + np.arange(order)], owner


def _mixed(grams: np.ndarray) -> np.ndarray:
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for column in grams.T:
        h = (h ^ column.astype(np.uint64)) * _PRIME
        h ^= h >> np.uint64(29)
    return h


def hashed(grams: np.ndarray) -> np.ndarray:
    """Places of n-grams in the arrays."""
    return _mixed(grams) >> np.uint64(64 - BITS)


def place(gram: str) -> int:
    """hashed() of a single n-gram."""
    h, prime = len(gram), int(_PRIME)
    for c in gram:
        h = ((h ^ ord(c)) * prime) & ((1 << 64) - 1)
        h ^= h >> 29
    return h >> (64 - BITS)


# ------------------------------------------------------------------ counting


#: Distinct words whose n-grams are listed at once: each takes a hundred bytes and more.
SLICE = 20_000


def gram_counts(rows: DataFrame, class_col: str, text_col: str, order: int = ORDER) -> DataFrame:
    """(class, gram, n): n-gram counts of all rows' words.

    text_col is binary UTF-8.  Tasks count distinct words first and hand on
    n-grams, so frequent words and large classes cost no more than their grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        total: dict[str, Counter] = {}

        def settle(name: str) -> None:
            words: Counter = Counter()
            for word, n in held.pop(name).items():
                if known := letters(word.decode("utf-8", "replace")):
                    words[known] += n
            into, left = total.setdefault(name, Counter()), iter(words.items())
            while some := list(islice(left, SLICE)):
                grams, owner = windows([w for w, _ in some], order)
                weights = np.array([n for _, n in some], np.int64)[owner]
                keys, first, inverse = np.unique(_mixed(grams), return_index=True, return_inverse=True)
                sums = np.bincount(inverse, weights, len(keys)).astype(np.int64).tolist()
                for g, n in zip(grams[first].tolist(), sums, strict=True):
                    into["".join(map(chr, g))] += n

        def spill(name: str) -> pa.RecordBatch:
            grams = total.pop(name)
            cols = [pa.array([name] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["class", "gram", "n"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = held.setdefault(name, Counter())
                words.update(plain(text).split())
                if len(words) > 200_000:
                    settle(name)
                    if len(total[name]) > 500_000:  # hand on what was counted: sums meet in the shuffle
                        yield spill(name)
        for name in list(held):
            settle(name)
        for name in list(total):
            yield spill(name)

    counted = rows.select(F.col(class_col).cast("string"), text_col).mapInArrow(lean(run), "class string, gram string, n long")
    return counted.groupBy("class", "gram").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(class, size, gram, n) for all orders: plain counts at the top, numbers of left neighbours below."""
    now = saved(counts.select("class", F.lit(order).alias("size"), "gram", "n"), "grams")
    every = now
    for size in range(order - 1, 0, -1):
        now = now.groupBy("class", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        now = now.select("class", F.lit(size).alias("size"), "gram", "n")
        every = every.union(now)
    return every


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each gram and of its context."""
    for b in batches:
        sizes = b.column(1).to_numpy()
        grams = b.column(2).to_pylist()
        place, context = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            codes = _codes([grams[i] for i in at], size)
            place[at], context[at] = hashed(codes), hashed(codes[:, :-1])
        cols = [*b.columns, pa.array(place), pa.array(context)]
        yield pa.RecordBatch.from_arrays(cols, names=["class", "size", "gram", "n", "place", "context"])


def _codes(grams: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, size)


def _of_size(rows: pa.Table, size: int, number: dict[str, int]) -> dict[str, np.ndarray]:
    """The rows of an order as columns, classes by number."""
    some = rows.filter(pc.equal(rows["size"], size))
    cols = {name: some[name].to_numpy() for name in some.column_names if name != "class"}
    return cols | {"class": np.array([number[c] for c in some["class"].to_pylist()], np.int64)}


def learned(counts: DataFrame, order: int = ORDER) -> KneserNey:
    """The model of gram_counts()."""
    every = saved(levels(counts, order).mapInArrow(lean(_placed), "class string, size int, gram string, n long, place long, context long"), "placed")
    by_place = every.groupBy("class", "size", "place").agg(F.sum("n").alias("n"), F.min("gram").alias("gram"))
    by_context = every.groupBy("class", "size", "context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    ones, twos = (F.count(F.when(F.col("n") == x, 1)).alias(f"n{x}") for x in (1, 2))
    ends = every.groupBy(F.expr("right(gram, 1)")).count().count()
    model = KneserNey(
        *(x.toArrow() for x in (by_place, by_context, every.groupBy("class", "size").agg(ones, twos))),  # bounded by places x classes
        alphabet=max(2, ends + 1),
        order=order,
    )
    forget(every)
    return model


# -------------------------------------------------------------------- model


class KneserNey:
    """names: the classes in code-point order; grams() gives log-probabilities per class.

    grams: (class, size, place, n, gram); contexts: (class, size, context, n,
    kinds); seen: (class, size, n1, n2), how many grams were seen once and twice.
    """

    def __init__(self, grams: pa.Table, contexts: pa.Table, seen: pa.Table, alphabet: int = 2, order: int = ORDER):
        self.order, self.names, self.alphabet = order, sorted(set(grams["class"].to_pylist())), alphabet
        self.keys: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.context: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        number = {name: i for i, name in enumerate(self.names)}
        discounts = {(number[r["class"]], r["size"]): r["n1"] / (r["n1"] + 2 * r["n2"]) for r in seen.to_pylist() if r["n1"] and r["n2"]}
        top: dict[str, np.ndarray] = {}
        for size in range(1, order + 1):
            top, around = _of_size(grams, size, number), _of_size(contexts, size, number)
            discount = np.array([discounts.get((i, size), 0.5) for i in range(len(self.names))])
            self._add(size, top, around, discount)
        which, n = top["class"], top["n"].astype(np.float64)
        cost = -self.grams(_codes(top["gram"].tolist(), order))[np.arange(len(n)), which] if len(n) else np.zeros(0)
        total = np.maximum(np.bincount(which, n, len(self.names)), 1)
        #: mean and variance of an n-gram's cost under its own class, in nats
        self.mean = np.bincount(which, n * cost, len(self.names)) / total
        self.variance = np.bincount(which, n * (cost - self.mean[which]) ** 2, len(self.names)) / total

    def _add(self, size: int, own: dict[str, np.ndarray], around: dict[str, np.ndarray], discount: np.ndarray) -> None:
        which, held, n = own["class"], around["class"], own["n"].astype(np.float64)
        keys, first, at = np.unique(own["place"], return_index=True, return_inverse=True)
        contexts, where = np.unique(around["context"], return_inverse=True)
        total, kinds = np.zeros((2, len(contexts), len(self.names)))
        total[where, held], kinds[where, held] = around["n"], around["kinds"]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.backoff[size] = np.where(total > 0, np.log(discount * kinds / total), 0.0)
        self.context[size], self.keys[size] = contexts, keys
        codes = _codes(own["gram"][first].tolist(), size)
        mine = np.searchsorted(contexts, hashed(codes[:, :-1]).astype(np.int64))
        lower = self.grams(codes[:, 1:], size - 1) if size > 1 else np.full((len(codes), len(self.names)), -np.log(self.alphabet))
        self.logp[size] = p = self.backoff[size][mine] + lower
        share = np.maximum(n - discount[which], 0) / np.maximum(total[mine[at], which], n)
        p[at, which] = np.log(np.exp(p[at, which]) + share)
        self.logp[size], self.backoff[size] = p.astype(np.float32), self.backoff[size].astype(np.float32)

    def grams(self, codes: np.ndarray, n: int | None = None) -> np.ndarray:
        """log P(last character | the others) per class, for rows of n characters."""
        n = self.order if n is None else n
        if n == 0:
            return np.full((len(codes), len(self.names)), -np.log(self.alphabet))
        keys, h = self.keys[n], hashed(codes).astype(np.int64)
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        out = np.empty((len(codes), len(self.names)))
        out[known] = self.logp[n][at[known]]
        if not known.all():
            rest = codes[~known]
            weight = np.zeros((len(rest), len(self.names)))
            if len(self.context[n]):
                c = hashed(rest[:, :-1]).astype(np.int64)
                at = np.minimum(np.searchsorted(self.context[n], c), len(self.context[n]) - 1)
                hit = self.context[n][at] == c
                weight[hit] = self.backoff[n][at[hit]]
            out[~known] = weight + self.grams(rest[:, 1:], n - 1)
        return out

    def one(self, gram: str) -> float:
        """grams() of a single n-gram under the first class."""
        n = len(gram)
        if n == 0:
            return -math.log(self.alphabet)
        keys, h = self.keys[n], place(gram)
        at = int(keys.searchsorted(h))
        if at < len(keys) and keys[at] == h:
            return float(self.logp[n][at, 0])
        contexts, h = self.context[n], place(gram[:-1])
        at = int(contexts.searchsorted(h))
        weight = float(self.backoff[n][at, 0]) if at < len(contexts) and contexts[at] == h else 0.0
        return weight + self.one(gram[1:])

    def words(self, words: list[str]) -> np.ndarray:
        """Sum of log-probabilities of each word (letters only) and its end, per class."""
        codes, owner = windows(words, self.order)
        p = self.grams(codes)
        return np.stack([np.bincount(owner, p[:, i], len(words)) for i in range(p.shape[1])], 1) if p.shape[1] else np.zeros((len(words), 0))
