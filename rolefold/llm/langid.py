"""Language identification by Kneser-Ney character models, one per language.

The language with the lowest cross-entropy per character wins.  Rejection is
calibrated: texts known to be of a language show how their cross-entropy is
spread around its mean (``Band``: a part that longer texts average out and a part
that they don't), and a text is rejected if its own lies above its language's by
more of these standard deviations than nearly all known texts do.  A text
without a letter is rejected too.  The score is the chance of the language
against the others times the chance of not being rejected, so a rejected text
scores under one half.

Defined cases: null and letterless texts are ``und`` with score 0; ties go to
the language that comes first by code point; if nothing was learned everything
is ``und``; languages with a null name are not learned; repeated rows count;
texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charlm import KneserNey, gram_counts, learned, letters, plain
from .common import forget, id_text, lean, saved, small_batches
from .ranks import quantiles

SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
UNKNOWN = "und"


@dataclass
class Band:
    """Where the cross-entropy of a language's own texts lies."""

    mean: float
    between: float  # variance among texts of any length
    within: float  # variance of one character
    limit: float  # in standard deviations

    def above(self, cost: float | np.ndarray, chars: float | np.ndarray) -> float | np.ndarray:
        return (cost - self.mean) / np.sqrt(self.between + self.within / chars)


@dataclass
class Identifier:
    model: KneserNey
    bands: list[Band]


class WordScores(dict):
    """Word (UTF-8) -> row of ``table``: characters, then the log-probability under each language."""

    def __init__(self, model: KneserNey, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most
        self._fresh()

    def _fresh(self) -> None:
        self.clear()
        self.table = np.zeros((1024, 1 + len(self.model.names)))
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        row = self[word] = len(self)
        return row

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The words' rows of the table; new words are learned first."""
        if len(self) > self.most:
            self._fresh()
        start = len(self)
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        while len(self.table) < len(self):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(0, len(self.new), 50_000):
            known = [letters(w) for w in b" ".join(self.new[at : at + 50_000]).decode("utf-8", "replace").split(" ")]
            sizes = np.fromiter(map(len, known), np.int64, len(known))
            rows, some = self.table[start + at : start + at + len(known)], sizes > 0
            rows[:, 0] = np.where(some, sizes + 1, 0)
            rows[:, 1:] = np.where(some[:, None], self.model.words(known), 0)
        self.new = []
        return self.table[found]


def totals(texts: list[bytes], scores: WordScores, most: int = 1 << 20) -> np.ndarray:
    """Characters and log-probabilities of whole texts; about ``most`` bytes of texts are looked up at once."""
    out = np.zeros((len(texts), scores.table.shape[1]))
    words: list[bytes] = []
    ends, size, first = [], 0, 0
    for n, text in enumerate(texts, 1):
        words += plain(text).split()
        ends.append(len(words))
        size += len(text)
        if size >= most or n == len(texts):
            # a last row of zeros, so that empty texts at the end have a place to start
            rows = np.concatenate([scores.rows(words), np.zeros((1, out.shape[1]))])
            starts = np.array([0, *ends[:-1]])
            out[first:n] = np.where((np.diff(ends, prepend=0) > 0)[:, None], np.add.reduceat(rows, starts), 0)
            words, ends, size, first = [], [], 0, n
    return out


def identify(df: DataFrame, known: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, cross_entropy (nats a character), rejected."""
    shared = df.sparkSession.sparkContext.broadcast(known)  # bounded by charlm's places, see there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scores = WordScores(known.model)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for total in totals(b.column(1).to_pylist(), scores):
                for into, x in zip(out, judged(known, total), strict=True):
                    into.append(x)
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            cols = [b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return id_text(df, id_col, text_col).mapInArrow(lean(run), SCHEMA)


def judged(known: Identifier, total: np.ndarray) -> tuple[str, float, float | None, bool]:
    chars, names = total[0], known.model.names
    if not chars or not names:
        return UNKNOWN, 0.0, None, True
    costs = -total[1:]
    best = int(np.argmin(costs))
    cost, band = costs[best] / chars, known.bands[best]
    # neighbouring n-grams overlap: the text weighs as much as half as many independent ones
    certain = 1 / np.exp(np.maximum(costs[best] - costs, -1400) / 2).sum()
    over = band.above(cost, chars) - band.limit
    return names[best], float(certain / (1 + np.exp(np.clip(over, -50, 50)))), float(cost), bool(over > 0)


def fit(
    df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least: float = 5.0, room: float = 2.0, share: float = 0.001,
) -> Identifier:
    """Learn from all rows that satisfy ``learn`` (a condition over doc_id) and name a language.

    Counts and the limits of rejection are of all these rows: ``room`` times what
    all but ``share`` of a language's regular texts keep to, and ``least`` standard
    deviations at least.
    """
    rows = df.select(
        df[id_col].cast("long").alias("doc_id"),
        df[lang_col].cast("string").alias("lang"),
        F.encode(F.coalesce(df[text_col].cast("string"), F.lit("")), "UTF-8").alias("text"),
    ).where(learn & F.col("lang").isNotNull())
    model = learned(gram_counts(rows, "lang", "text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, number = WordScores(shared.value), {n: i for i, n in enumerate(shared.value.names)}
        for b in batches:
            found = []
            for lang, total in zip(b.column(0).to_pylist(), totals(b.column(1).to_pylist(), scores), strict=True):
                if lang in number and total[0]:
                    found.append((number[lang], total[0], -total[1 + number[lang]] / total[0]))
            cols = list(zip(*found, strict=True)) if found else [(), (), ()]
            kinds = (pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "chars", "cost"])

    costs = saved(rows.select("lang", "text").mapInArrow(lean(run), "lang long, chars double, cost double"), "costs")
    bands = fitted(costs, model, least, room, share)
    forget(costs)
    return Identifier(model, bands)


def fitted(costs: DataFrame, model: KneserNey, least: float, room: float, share: float) -> list[Band]:
    """Bands from all texts' (lang, chars, cost); the middle ones decide, so odd texts among them don't widen a band."""
    bands = [Band(float(m), 0.01, 2 * float(v), least) for m, v in zip(model.mean, model.variance, strict=True)]  # neighbouring n-grams overlap
    columns = lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns]
    middle = {i: at for i, (n, [at]) in quantiles(costs, lambda b: columns(b)[:2], [0.5]).items() if n >= 30}
    least_chars = np.array([middle.get(i, np.inf) for i in range(len(bands))])

    def long(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Two groups a language: costs and lengths of its longer texts."""
        lang, chars, cost = columns(b)
        some = chars >= least_chars[lang]
        return np.concatenate([2 * lang[some], 2 * lang[some] + 1]), np.concatenate([cost[some], chars[some]])

    found = quantiles(costs, long, [0.16, 0.5, 0.84]) if middle else {}
    for i in middle:
        (_, (low, at, high)), (_, (_, chars, _)) = found[2 * i], found[2 * i + 1]
        bands[i].mean, bands[i].between = at, max(((high - low) / 2) ** 2 - bands[i].within / chars, 1e-4)
    mean, between, within = np.array([(x.mean, x.between, x.within) for x in bands]).reshape(-1, 3).T

    def regular(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lang, chars, cost = columns(b)
        z = Band(mean[lang], between[lang], within[lang], least).above(cost, chars)
        return lang[z < 4 * least], z[z < 4 * least]

    for i, (_, [at]) in quantiles(costs, regular, [1 - share]).items():
        bands[i].limit = max(least, room * at)
    return bands


def keep(df: DataFrame, known: Identifier, text_col: str = "text") -> DataFrame:
    """The rows whose text isn't rejected, with all their columns; no shuffle."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(known)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scores = WordScores(known.model)
        for b in batches:
            texts = [(text or "").encode() for text in b.column(at).to_pylist()]
            held = [not judged(known, total)[3] for total in totals(texts, scores)]
            yield b.filter(pa.array(held, pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)
