"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokenising is one pass over the texts.  Packing works on the histogram of piece
lengths, which has at most ``capacity`` entries however large the corpus is: a
bin-completion branch-and-bound chooses *patterns* (how many pieces of which
length share a sequence) with multiplicities, and every piece then finds its
place from its rank among the pieces of its length.  Nothing that grows with
the corpus reaches the driver.

Defined cases: null text is empty text; an empty document is its end token
alone; rows with equal ids are separate documents; a null id is carried as null;
texts of any length are tokenised whole and cut into full pieces and a last one; an
empty table has no rows; other columns stay out.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, lean, saved, width

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


# ---------------------------------------------------------------- tokenising


class WordTokens(dict):
    """UTF-8 word -> its token ids as little-endian 32-bit integers.

    The tokenizer drops white space and never joins over it, so a text's ids
    are those of its words, and a word's are those of its pieces.  Two generations
    of at most ``most`` / 2 words are kept: once the younger is full the older is
    forgotten, but for words that were asked for since.
    """

    def __init__(self, path: str, most: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.tokens = PieceTokens(self.tokenizer.model.tokenize, most)

    def __missing__(self, word: bytes) -> bytes:
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = self._ids(word)
        self[word] = found
        return found

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self.tokens[word.lower()]
        text = word.decode("utf-8", "replace")
        if (not word.isascii() and max(text) > "ɏ") or "<|" in text:
            # composition, special tokens, other scripts: the whole tokenizer
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.tokens.__getitem__, self.pieces(text.lower())))


class PieceTokens(dict):
    """Piece between the tokenizer's own cuts -> its token ids; two generations like those of words."""

    def __init__(self, tokenize: Callable, most: int):
        super().__init__()
        self.tokenize, self.most = tokenize, most
        self.older: dict = {}
        self.visible = _visible_bytes()

    def __missing__(self, piece: str | bytes) -> bytes:
        """ASCII pieces may be asked for as bytes."""
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        if found is None:
            text = piece.decode() if isinstance(piece, bytes) else piece
            shown = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.visible)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(shown)])
        self[piece] = found
        return found


#: The tokenizer's cuts in lower-case ASCII without control characters and special tokens.
_ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+").findall
_UNUSUAL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]|<\|").search


def _visible_bytes() -> dict[int, str]:
    """Byte-level alphabets show printable Latin-1 as itself and move the rest up."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def _words(path: str) -> WordTokens:
    return WordTokens(path)


def token_bytes(text: bytes, words: WordTokens, end_id: int) -> bytes:
    if text.isascii() and not _UNUSUAL(text):
        found = map(words.tokens.__getitem__, _ASCII_PIECES(text.lower()))
    else:
        found = map(words.__getitem__, text.split())
    return b"".join(found) + end_id.to_bytes(4, "little")


def tokenize_pieces(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens; with_ids adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path)
        step = 4 * capacity
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            ids: list = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = token_bytes(text, words, end_id)
                for n, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for into, x in zip(rows, (doc, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        into.append(x)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return id_text(df, id_col, text_col).mapInArrow(lean(run), schema)


# ------------------------------------------------------------------- packing

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # sequences, ((length, pieces each), ...)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: sequences with equal contents stay one group."""
    free: dict[int, list[tuple[int, tuple]]] = {}
    order: list[int] = []

    def put(room: int, many: int, held: tuple) -> None:
        if many:
            if room not in free:
                free[room] = []
                bisect.insort(order, room)
            free[room].append((many, held))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                room, many, held = capacity, -(-left // (capacity // length)), ()
            else:
                room = order[at]
                many, held = free[room].pop()
                if not free[room]:
                    del free[room]
                    order.pop(at)
            each = room // length
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            rest = min(rest, each)
            put(room - each * length, full, (*held, (length, each)))
            if rest:
                put(room - rest * length, 1, (*held, (length, rest)))
            put(room, many - full - bool(rest), held)
            left -= full * each + rest
    return [(many, held) for groups in free.values() for many, held in groups if held]


def lower_bound(counts: dict[int, int], capacity: int, most: int = 64) -> int:
    """The best of three kinds of bounds: by sums, by pieces that can't share a sequence, and by dual feasible functions.

    For every floor f, pieces above capacity - f are alone, those above one half
    take a sequence each, and what lies from f to one half must fit beside them.
    The function u_k maps a piece x to floor((k + 1) x / capacity) / k (x itself where
    that is whole): no sequence's pieces exceed 1 in sum, so it also sees that no
    more than k pieces of some kind fit together.
    """
    lengths = np.array(sorted(counts), np.int64)
    number = np.array([counts[x] for x in lengths.tolist()], object)  # whole numbers of any size
    upto = lambda values: np.concatenate([[0], np.cumsum(values)])
    many, mass = upto(number), upto(number * lengths)
    least = -(-int(mass[-1]) // capacity)
    middle = int(np.searchsorted(lengths, capacity / 2, "right"))  # first above one half
    for at in range(middle + 1):
        floor = int(lengths[at]) if at < middle else 0
        high = int(np.searchsorted(lengths, capacity - floor, "right"))
        alone, half = many[-1] - many[high], many[high] - many[middle]
        room = half * capacity - (mass[high] - mass[middle])
        small = mass[middle] - mass[at] if at < middle else mass[middle]
        least = max(least, int(alone + half + max(0, -(-(small - room) // capacity))))
    for k in range(1, most + 1):
        scaled = (k + 1) * lengths
        whole = scaled % capacity == 0
        values = np.where(whole, k * lengths, capacity * (scaled // capacity))  # of k * capacity
        least = max(least, -(-int((values.astype(object) * number).sum()) // (k * capacity)))
    return least


def fillings(counts: dict[int, int], capacity: int, allowed: int, look: int) -> list[tuple]:
    """All undominated ways to fill a sequence around the largest piece, least waste first (of those met in ``look`` steps).

    A filling is dropped if a larger unused piece fits where one of its pieces
    (or a pair of them) stands, or if it wastes more than ``allowed``.
    """
    largest = max(counts)
    stock = dict(counts)
    stock[largest] -= 1
    lengths = sorted((x for x, c in stock.items() if c and x <= capacity - largest), reverse=True)
    found: list[tuple[int, tuple]] = []
    seen = 0
    smallest = lengths[-1] if lengths else capacity + 1

    def dominated(held: list[tuple[int, int]], waste: int) -> bool:
        used = dict(held)
        spare = [x for x in lengths if stock[x] > used.get(x, 0)]
        spare.reverse()
        singles = [x for x, _ in held]
        pairs = [x + y for i, (x, n) in enumerate(held) for y in ([x] if n > 1 else []) + singles[i + 1 :]]
        for x, least in [(x, x + 1) for x in singles] + [(x, x) for x in pairs]:
            at = bisect.bisect_left(spare, least)
            if at < len(spare) and spare[at] <= x + waste:
                return True
        return False

    # (place in lengths, pieces of it still to try or None, room, held)
    stack: list[tuple[int, int | None, int, list]] = [(0, None, capacity - largest, [])]
    while stack and seen < look:
        at, many, room, held = stack.pop()
        seen += 1
        if many is None:
            while at < len(lengths) and lengths[at] > room:
                at += 1
            if at == len(lengths):
                used = dict(held)
                full = room < smallest or all(stock[x] <= used.get(x, 0) for x in lengths if x <= room)
                if full and room <= allowed and not dominated(held, room):
                    found.append((room, tuple(held)))
                continue
            many = min(stock[lengths[at]], room // lengths[at])
        if many:
            stack.append((at, many - 1, room, held))
        x = lengths[at]
        stack.append((at + 1, None, room - many * x, [*held, (x, many)] if many else held))
    found.sort(key=lambda f: (f[0], [-x for x, _ in f[1]]))
    out = []
    for waste, held in found:
        whole = dict(held)
        whole[largest] = whole.get(largest, 0) + 1
        out.append((waste, tuple(sorted(whole.items(), reverse=True))))
    return out


def bin_completion(
    counts: dict[int, int], capacity: int, nodes: int = 96, look: int = 2000
) -> list[Pattern]:
    """Branch-and-bound over patterns, from the best-fit incumbent towards the bound.

    The problem is hard, so ``nodes`` and ``look`` bound the search's effort, never
    the input: the best complete solution met is returned.  It is known to be the
    best of all if ``size`` of it is ``lower_bound`` or the search ended by itself.
    """
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    size = lambda plan: sum(many for many, _ in plan)
    best = best_fit(counts, capacity)
    bound, total = lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    spent = 0
    stack: list[tuple[dict, list, int]] = [(counts, [], 0)]
    while stack and size(best) > bound and spent < nodes:
        left, chosen, waste = stack.pop()
        spent += 1
        allowed = (size(best) - 1) * capacity - total - waste
        if allowed < 0:
            continue
        if not left:
            best = chosen if size(chosen) < size(best) else best
            continue
        rest = best_fit(left, capacity)
        if size(chosen) + size(rest) < size(best):
            best = chosen + rest
        children = []
        for lost, held in fillings(left, capacity, allowed, look):
            most = min(left[x] // n for x, n in held)
            if lost:
                most = max(1, min(most, allowed // lost))
            for many in dict.fromkeys((most, 1)):
                after = dict(left)
                for x, n in held:
                    after[x] -= n * many
                    if not after[x]:
                        del after[x]
                children.append((after, [*chosen, (many, held)], waste + lost * many))
        stack.extend(reversed(children))
    return best


class Slots:
    """Where the r-th piece of each length goes; at most a few rows per pattern."""

    def __init__(self, plan: list[Pattern]):
        rows, taken, first = [], {}, 0
        for many, held in sorted(plan, key=lambda p: p[1], reverse=True):
            at = 0
            for length, each in held:
                start = taken.get(length, 0)
                rows.append((length, start, each, at, first))
                taken[length] = start + many * each
                at += length * each
            first += many
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 5).T
        self.length, self.start, self.each, self.at, self.first = cols
        self.key = (self.length << 44) + self.start

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        n = rank - self.start[i]
        return self.first[i] + n // self.each[i], self.at[i] + n % self.each[i] * length


def pack_pieces(pieces: DataFrame, capacity: int = 4096, **effort: int) -> DataFrame:
    """Add sequence_id and offset to stored pieces (read three times: pass a table)."""
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width(pieces.sparkSession))))
    groups = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(bin_completion(counts, capacity, **effort))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["length", "deal"])
    ranked = ranked.select(*(c.split()[0] for c in PIECES.split(", ")), (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, at = slots.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            cols = [*b.columns[:5], pa.array(where, pa.int64()), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PLACED.split(", ")])

    return ranked.mapInArrow(lean(run), PLACED)


def pack_documents(
    df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise once into a shared table, then place every piece."""
    pieces = tokenize_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col)
    return pack_pieces(saved(pieces, "pieces"), capacity)
