"""Toxicity scoring behind a noisy-channel decoder.

Words that look disguised (digits or symbols among letters, separators, runs of
one character) and runs of single letters become character lattices; a Viterbi
search under a Kneser-Ney character model, with a price for every reading that
isn't literal, picks the likeliest words.  These join the text's own words, and
the text is scored by a small lexicon of words and word beginnings: a logistic
rule weighs the strongest one found, how many are found and in how long a text.

The character model's counts cover the whole corpus.  The lexicon and its rule are
fitted on all labelled texts, one of each set of equal or nearly equal texts (those
that share the least hash of their five-word shingles), so a group of copies can't
bring in its ordinary words.

Defined cases: null text is empty text and scores the base rate; null ids are
never learned from; null labels are ignored; repeated labels of an id count once
(the largest); if nothing was learned every text scores the base rate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charlm import KneserNey, gram_counts, learned, letters
from .common import forget, id_text, lean, saved, small_batches

#: Fixed readings of look-alike characters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "§": "s", "¡": "i",
}
SEPARATORS = ".-_*~·•,:;'’\"/\\^=#​‌‍­"
SWAP, DROP, SQUEEZE, SPLIT = 1.0, 0.3, 0.3, 1.0  # prices in nats of what the channel may have done
_ODD = re.escape("".join(LOOKALIKES))
_DISGUISED = re.compile(rf"[^\W\d_][{_ODD}]|[{_ODD}][^\W\d_]|(.)\1\1|[^\W\d_][{re.escape(SEPARATORS)}]+[^\W\d_]", re.S)
_SPACED = re.compile(rb"(?<!\S)\S{1,2}(?:[ \t\n\r\x0b\x0c]\S{1,2}){3,}(?!\S)")


_TRIPLE = re.compile(r"(.)\1\1", re.S)


def disguised(word: str) -> bool:
    return _DISGUISED.search(word) is not None


# ------------------------------------------------------------------- decoder


class Decoder:
    """Viterbi search for the likeliest letters behind a disguised string."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.memo: dict[str, float] = {}

    def logp(self, context: str, char: str) -> float:
        key = context + char
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            found = self.memo[key] = self.model.one(key) if self.model.names else -1.0
        return found

    def lattice(self, text: str, split: bool) -> list[list[tuple[str, float]]]:
        """Per position the readings with their prices; equal neighbours are one position."""
        out = []
        for m in re.finditer(r"(.)\1*", text.lower(), re.S):
            char, many = m[1], len(m[0])
            if char.isalpha():
                if many < 3:
                    out += [[(char, 0.0)] for _ in range(many)]
                else:
                    out.append([(char, SQUEEZE), (char * 2, SQUEEZE)])
            elif char in LOOKALIKES:
                each = [(c, SWAP) for c in LOOKALIKES[char]] + [("", 2 * SWAP)]
                out += [each for _ in range(min(many, 2))]
            elif not char.isspace():
                out.append([("", DROP)])
        if split:
            out = [[*at, *((" " + c, p + SPLIT) for c, p in at if c)] if n else at for n, at in enumerate(out)]
        return out

    def starts(self, text: str, n: int = 3) -> set[str]:
        """The first n letters of all readings."""
        done, now = set(), {""}
        for at in self.lattice(text, False):
            now = {x + reading for x in now for reading, _ in at}
            done |= {x[:n] for x in now if len(x) >= n}
            now = {x for x in now if len(x) < n}
            if not now:
                break
        return done

    def decode(self, text: str, split: bool = False) -> list[str]:
        """The words of the cheapest path."""
        width = self.model.order - 1
        start = " " * width
        best: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
        for at in self.lattice(text, split):
            after: dict[str, tuple[float, tuple | None]] = {}
            for context, (cost, path) in best.items():
                for reading, price in at:
                    now, total = context, cost + price
                    for c in reading:
                        total -= self.logp(now, c)
                        now = start if c == " " else (now + c)[-width:]
                    if now not in after or total < after[now][0]:
                        after[now] = (total, (reading, path) if reading else path)
            best = after
        _, (_, path) = min(((c - self.logp(s, " "), s), (c, p)) for s, (c, p) in best.items())
        parts = []
        while path:
            parts.append(path[0])
            path = path[1]
        return "".join(reversed(parts)).split()


# ------------------------------------------------------------------ features


def features(word: str) -> list[str]:
    """A word of letters as a whole and by its beginnings."""
    return [f"={word}", *(f"{word[:n]}" for n in (4, 5, 6) if len(word) > n)] if len(word) > 2 else []


def spaced(text: bytes) -> Iterator[str]:
    """Runs of at least four single characters between spaces."""
    for m in _SPACED.finditer(text):
        run: list[str] = []
        for token in [*m[0].split(), b"--"]:
            char = token.decode("utf-8", "replace")
            if len(char) == 1:
                run.append(char)
            else:
                if len(run) > 3:
                    yield "".join(run)
                run = []


@dataclass
class Lexicon:
    """Features with (toxic texts, texts) that hold them, the toxic rate, and a logistic rule over what is found."""

    hits: dict[str, tuple[int, int]] = field(default_factory=dict)
    rate: float = 0.01
    rule: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        self.heads = {f.removeprefix("=")[:3] for f in self.hits}

    def of(self, word: str, seen: int | None = None) -> float:
        """Log-odds of the word's best feature, 0.0 if it has none; seen: leave out one text with this label."""
        best = 0.0
        for f in features(word):
            if f in self.hits:
                toxic, n = self.hits[f]
                if seen is not None:
                    toxic, n = toxic - seen, n - 1
                share = (toxic + self.rate) / (n + 1)
                best = max(best, math.log(share / (1 - share)), 1e-9)
        return best


def summary(found: list[float], words: int) -> list[float]:
    """What the rule weighs: the strongest word, how many there are, and in how long a text."""
    if not found:
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    return [1.0, 1.0, max(found), math.log(len(found)), math.log(1 + words)]


class Scorer:
    """Scores texts; what a word adds is remembered, up to ``most`` words."""

    def __init__(self, lexicon: Lexicon, decoder: Decoder, most: int = 400_000):
        self.lexicon, self.decoder, self.most = lexicon, decoder, most
        self.known: dict[bytes, float] = {}

    def word(self, word: bytes, seen: int | None = None) -> float:
        plain = word.decode("utf-8", "replace").lower()
        core, heads = plain.strip(".,"), self.lexicon.heads
        if core.isalpha():
            found = self.lexicon.of(core, seen) if core[:3] in heads else 0.0
            if not _TRIPLE.search(core):
                return found
        else:
            found = self.lexicon.of(letters(plain), seen)
        # a reading counts only if it starts like something in the lexicon
        if disguised(plain) and not heads.isdisjoint(self.decoder.starts(plain)):
            found = max([found, *(self.lexicon.of(w, seen) for w in self.decoder.decode(plain))])
        return found

    def found(self, text: bytes, seen: int | None = None) -> list[float]:
        words, known = set(text.split()), self.known
        if len(known) > self.most:
            known.clear()
        for w in words.difference(known):
            known[w] = self.word(w)
        if seen is not None:  # a word without a feature has none whatever is left out
            out = [self.word(w, seen) for w in words if known[w]]
        else:
            out = list(map(known.__getitem__, words))
        for run in spaced(text):
            out += [self.lexicon.of(w, seen) for w in self.decoder.decode(run, split=True)]
        return [x for x in out if x]

    def score(self, text: bytes) -> float:
        if self.lexicon.rule is None:
            return self.lexicon.rate
        x = summary(self.found(text), len(text.split()))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, sum(map(float.__mul__, self.lexicon.rule, x))))))


# ------------------------------------------------------------------ fitting


def _evidence(hits: int, n: int, base: float) -> float:
    """Nats by which the share hits/n beats the base rate; 0 if it doesn't."""
    p = hits / n if n else 0.0
    if p <= base:
        return 0.0
    return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


_WORDS, _BITS = 1 << 20, 64


def _sieve(rows: DataFrame, key: str) -> np.ndarray:
    """Bits at the hashes of the keys: a bounded filter for rows to be joined, which may let others through."""
    h = F.xxhash64(key)
    bits = rows.select(h.bitwiseAND(F.lit(_WORDS - 1)).alias("word"), F.pmod(F.shiftright(h, 20), F.lit(_BITS)).cast("int").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # at most _WORDS rows
    out = np.zeros(_WORDS, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _passes(sieve: np.ndarray, hashes: pa.Array) -> np.ndarray:
    h = hashes.to_numpy()
    return (sieve[h & (_WORDS - 1)] >> ((h >> 20) % _BITS)) & 1 == 1


def _labelled(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(toxic, sha, one, two) of the texts with a mark; only texts' digests and sketches move to their marks."""
    shared = texts.sparkSession.sparkContext.broadcast(_sieve(marks, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            b = b.filter(pa.array(_passes(shared.value, b.column(1))))
            both = np.array([_sketch(t, words) for t in b.column(3).to_pylist()], np.int64).reshape(-1, 2)
            cols = [b.column(0), b.column(2), pa.array(both[:, 0]), pa.array(both[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "sha", "one", "two"])

    rows = texts.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id"), F.sha1("text"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, sha string, one long, two long").join(marks, "doc_id").select("toxic", "sha", "one", "two")


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(toxic, text) of each sha in ``wanted`` (sha, toxic); a task hands on equal texts once."""
    shared = texts.sparkSession.sparkContext.broadcast(_sieve(wanted, "sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            b = b.filter(pa.array(_passes(shared.value, b.column(0))))
            fresh = []
            for sha in b.column(1).to_pylist():
                fresh.append(sha not in seen)
                seen.add(sha)
            b = b.filter(pa.array(fresh, pa.bool_()))
            yield pa.RecordBatch.from_arrays(b.columns[1:], names=["sha", "text"])

    rows = texts.select(F.sha1("text").alias("sha"), "text").select(F.xxhash64("sha"), "sha", "text")
    found = rows.mapInArrow(lean(run), "sha string, text binary").join(wanted, "sha")
    return found.groupBy("sha").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")


def fit_lexicon(texts: DataFrame, marks: DataFrame, decoder_model: KneserNey, least: float = 7.0) -> Lexicon:
    """texts: (doc_id, text binary); marks: (doc_id, toxic 0 or 1), one row per id, those allowed to learn from.

    A feature needs ``least`` nats of evidence, or one more than the log of the
    number of texts if that is more.
    """
    spark = texts.sparkSession
    wanted = saved(_apart(_labelled(texts, marks)), "wanted")
    kept = saved(_texts_of(texts, wanted), "kept")
    shared = spark.sparkContext.broadcast(decoder_model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, sides = Decoder(shared.value), (Counter(), Counter())
        words = WordFeatures(decoder)

        def settled() -> pa.RecordBatch:
            names = list(sides[0].keys() | sides[1].keys())
            cols = [pa.array(names, pa.string()), *(pa.array([side[n] for n in names], pa.int64()) for side in sides)]
            for side in sides:
                side.clear()
            return pa.RecordBatch.from_arrays(cols, names=["feature", "clean", "toxic"])

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = set().union(*map(words.__getitem__, set(text.split())))
                for run in spaced(text):
                    found.update(*map(features, decoder.decode(run, split=True)))
                sides[toxic].update(found)
                if len(sides[0]) + len(sides[1]) > 500_000:  # sums meet in the shuffle
                    yield settled()
        yield settled()

    sizes = {r["toxic"]: r["n"] for r in kept.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, every = sizes.get(1, 0), sum(sizes.values())
    if not bad:
        forget(wanted, kept)
        return Lexicon(rate=1 / (every + 2))
    rate = min(bad / every, 0.5)
    least = max(least, math.log(every) + 1)
    counts = kept.mapInArrow(lean(count), "feature string, clean long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3 AND toxic >= 4 * clean")
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    counts = counts.where(n * (p * F.log(p / rate) + rest) >= least - 1e-6)  # _evidence() decides
    table = {r["feature"]: (r["toxic"], r["clean"] + r["toxic"]) for r in counts.collect()}  # the lexicon
    table = {f: x for f, x in table.items() if _evidence(*x, rate) >= least}
    lexicon = Lexicon(table, rate)
    rows = saved(kept.mapInArrow(lean(_summaries(lexicon, shared)), "toxic int, x array<double>"), "summaries")
    rule = _logistic(rows, len(summary([], 0)))
    forget(wanted, kept, rows)
    return Lexicon(table, rate, tuple(rule.tolist()))


class WordFeatures(dict):
    """Word (UTF-8) -> its features and those that only the decoder finds; emptied once it holds ``most`` words."""

    def __init__(self, decoder: Decoder, most: int = 200_000):
        super().__init__()
        self.decoder, self.most = decoder, most

    def __missing__(self, word: bytes) -> list[str]:
        if len(self) >= self.most:
            self.clear()
        plain = word.decode("utf-8", "replace")
        found = features(letters(plain))
        if not plain.isalpha() or _TRIPLE.search(plain):
            if disguised(plain):
                found += [f for w in self.decoder.decode(plain) for f in features(w)]
        self[word] = found
        return found


def _summaries(lexicon: Lexicon, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, Decoder(shared.value))
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            xs = [summary(scorer.found(text, toxic), len(text.split())) for toxic, text in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _logistic(rows: DataFrame, size: int, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method with a small ridge on stored (toxic, x); a round sums the slopes of all rows."""
    w = np.zeros(size)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            up, bend = np.zeros(size), np.zeros((size, size))
            for b in batches:
                y, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, size)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                up += x.T @ (y - p)
                bend += x.T @ (x * (p * (1 - p))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([[*up, *bend.ravel()]], pa.list_(pa.float64()))], names=["sums"])

        sums = np.sum([r["sums"] for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)  # a row a task
        step = np.linalg.solve(sums[size:].reshape(size, size) + ridge * np.eye(size), sums[:size] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


class WordHashes(dict):
    """Word -> 64-bit hash; emptied once it holds ``most`` words."""

    def __init__(self, most: int = 300_000):
        import xxhash

        super().__init__()
        self.most, self.hash = most, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.hash(word)
        return found


def _sketch(text: bytes, known: WordHashes) -> tuple[int, int]:
    """Least hashes of the five-word shingles under two mixers: near copies share one or both."""
    words = text.lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    many = max(1, len(h) - 4)
    shingles = np.zeros(many, np.uint64)
    for i in range(min(5, len(h))):
        shingles = (shingles ^ h[i : i + many]) * np.uint64(0x9E3779B97F4A7C15)
        shingles ^= shingles >> np.uint64(29)
    mixed = ((shingles ^ np.uint64(n)) * np.uint64(n) for n in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    return tuple(int((x ^ x >> np.uint64(32)).min().view(np.int64)) for x in mixed)


def _apart(found: DataFrame) -> DataFrame:
    """(sha, toxic) of one text of each group that shares a sketch, a toxic one if there is one."""
    for key, other in (("one", "two"), ("two", "one")):
        found = found.groupBy(key).agg(F.min(F.struct((-F.col("toxic")).alias("order"), "sha", "toxic", other)).alias("x"))
        found = found.select("x.toxic", "x.sha", key, F.col(f"x.{other}").alias(other))
    return found.select("sha", "toxic")


def fit(
    df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[Lexicon, KneserNey]:
    """Character model from all texts; lexicon from labelled rows that satisfy ``learn`` (over doc_id)."""
    texts = id_text(df, id_col, text_col)
    model = learned(gram_counts(texts.select(F.lit("all").alias("class"), "text"), "class", "text"))
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
    marks = marks.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learn).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return fit_lexicon(texts, marks, model), model


def score(df: DataFrame, lexicon: Lexicon, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per document."""
    shared = df.sparkSession.sparkContext.broadcast((lexicon, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        scorer = Scorer(lexicon, Decoder(model))
        for b in batches:
            found = pa.array([scorer.score(t) for t in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["doc_id", "score"])

    return id_text(df, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double")


def keep(df: DataFrame, lexicon: Lexicon, model: KneserNey, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``limit``, with all their columns; no shuffle."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((lexicon, model))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        scorer = Scorer(lexicon, Decoder(model))
        for b in batches:
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array([scorer.score((t or "").encode()) < limit for t in texts], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)
