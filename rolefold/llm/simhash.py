"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct 64-bit fingerprints are dealt into cells by the population counts of
their two halves.  Flipping d bits moves the counts by at most d in sum, so only
cells within the radius are compared, each pair of them in a task of its own;
inside a task both sides are cut again by the counts of their four quarters, tile
pairs farther apart than the radius are skipped, and the rest is compared in full
with exclusive-or and bit counts.  Cells above ``tile`` fingerprints are cut into
slices, and each pair of slices meets once.  A task hands on only the links that
join two of its groups, so a group of n mutual copies yields n - 1 rows.

``similar`` finds texts whose *sets* of shingles have a Jaccard coefficient of
``least`` or more.  Equal sets are one from the start.  Each set has ``PARTS``
fingerprints of 64 bits; sets are dealt into cells by size (sizes of linked sets
differ by at most the factor ``least``), compared tile by tile in the same way, and
pairs within the (wide) radius are candidates.  Tasks hand on forests of candidates
alone; inside each group that these join, the sets themselves are compared, all with
all, through the postings of their shingles, and linked where they reach ``least``.
Groups beyond ``TILE`` shingles are cut into slices of which each pair meets once, and
again only forests of links leave a task: no list of pairs is ever made.

Defined cases: null text is empty text; texts without words have fingerprint
zero and link like any other; equal ids stay separate rows; a null id counts as
no id when a group's smallest id is taken; texts of any length are read whole;
an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, id_text, lean, saved, width
from .components import components

SEED = 42


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """64 bits: one is set if more than half of the shingles' XXH64 have it set."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.array(list(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles)), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return id_text(df, id_col, text_col).mapInArrow(lean(run), "doc_id long, fp long")


# ---------------------------------------------------------------- tiles


def _counts(fps: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of equal parts of each fingerprint, one row each."""
    kind = {2: np.uint32, 4: np.uint16}[parts]
    return np.bitwise_count(np.ascontiguousarray(fps).view(kind).reshape(-1, parts)).astype(np.int16)


class Cells:
    """Slices of each cell; a task compares two slices that are within reach, or one with itself."""

    def __init__(self, sizes: dict[int, int], tile: int, near: Callable[[int, int], bool]):
        self.slices = {c: -(-n // tile) for c, n in sorted(sizes.items())}
        self.first, at = {}, 0
        for c, n in self.slices.items():
            self.first[c] = at
            at += n
        self.total = at
        self.reach = {c: [d for d in self.slices if d != c and near(c, d)] for c in self.slices}

    def alone(self, task: int) -> bool:
        return task // self.total == task % self.total

    def deal(self, cell: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, tasks, visitors): where rows of some cells go; a task's visitors belong to its later slice."""
        for c in np.unique(cell).tolist():
            rows = np.flatnonzero(cell == c)
            n = self.slices[c]
            home = self.first[c] + (key[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n
            others = [self.first[c] + i for i in range(n)] + [self.first[d] + i for d in self.reach[c] for i in range(self.slices[d])]
            for other in others:
                later = home > other
                yield rows, np.where(later, other * self.total + home, home * self.total + other), later


class Forest:
    """Union-find over positions; ``grown`` holds the links that joined two groups."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.grown: list[tuple[int, int]] = []

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[at]
            if np.array_equal(up, at):
                return at
            self.up[at] = self.up[up]
            at = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        differ = a != b
        if not differ.any():
            return
        for x, y in np.unique(np.stack([a[differ], b[differ]], 1), axis=0).tolist():
            while self.up[x] != x:
                x = int(self.up[x])
            while self.up[y] != y:
                y = int(self.up[y])
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.grown.append((x, y))


class Tiles:
    """Fingerprints sorted by their quarters' population counts, cut where these change."""

    def __init__(self, fps: np.ndarray):
        counts = _counts(fps, 4)
        key = counts.astype(np.int64) @ np.array([32768, 1024, 32, 1])
        order = np.argsort(key, kind="stable")
        self.fps = fps[order]
        key = key[order]
        self.at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        self.counts = counts[order][self.at]
        self.end = np.r_[self.at[1:], len(key)]


def link(a: Tiles, b: Tiles, forest: Forest, shift: int, radius: int, side: int = 1024) -> None:
    """Join what is within the radius; positions of b in the forest start at ``shift`` (0: a and b are one)."""
    same = a is b
    for row in range(0, len(a.at), 256):
        apart = np.abs(a.counts[row : row + 256, None, :] - b.counts[None, :, :]).sum(axis=2)
        for i, j in zip(*np.nonzero(apart <= radius), strict=True):
            i += row
            if same and j < i:
                continue
            for x in range(a.at[i], a.end[i], side):
                p = a.fps[x : min(x + side, a.end[i])]
                for y in range(b.at[j], b.end[j], side):
                    if same and y + side <= x:
                        continue
                    q = b.fps[y : min(y + side, b.end[j])]
                    near = np.bitwise_count(p[:, None] ^ q[None, :]) <= radius
                    m, n = np.nonzero(near)
                    if same and i == j:
                        keep = m + x < n + y
                        m, n = m[keep], n[keep]
                    if len(m):
                        one = np.unique(m, return_index=True)[1]  # first one link a row, then what still joins groups
                        forest.join(x + m[one], shift + y + n[one])
                        forest.join(x + m, shift + y + n)


def compare(rows: Iterator[tuple[int, np.ndarray, np.ndarray]], radius: int, alone: Callable[[int], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """rows: (task, home fingerprints, visitors); a task's home rows come first, in one or more parts."""
    task, home, tiles = None, [], None

    def out(forest: Forest, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if forest.grown:
            grown = np.array(forest.grown)
            yield names[grown[:, 0]], names[grown[:, 1]]

    def settle() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal tiles
        tiles = Tiles(np.concatenate(home) if home else np.zeros(0, np.uint64))
        if alone(task):
            forest = Forest(len(tiles.fps))
            link(tiles, tiles, forest, 0, radius)
            yield from out(forest, tiles.fps)

    for number, own, visitors in rows:
        if number != task:
            if task is not None and tiles is None:
                yield from settle()
            task, home, tiles = number, [], None
        if len(own):
            home.append(own)
        if len(visitors):
            if tiles is None:
                yield from settle()
            if len(tiles.fps):
                guests = Tiles(visitors)
                forest = Forest(len(tiles.fps) + len(visitors))
                link(tiles, guests, forest, len(tiles.fps), radius)
                yield from out(forest, np.concatenate([tiles.fps, guests.fps]))
    if task is not None and tiles is None:
        yield from settle()


def halves(fps: np.ndarray) -> np.ndarray:
    """Cells of fingerprints: the population counts of both halves."""
    n = _counts(fps, 2).astype(np.int64)
    return n[:, 0] * 64 + n[:, 1]


def within(radius: int) -> Callable[[int, int], bool]:
    return lambda c, d: abs(c // 64 - d // 64) + abs(c % 64 - d % 64) <= radius


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Runs of equal tasks: (task, visitor, the other columns)."""
    for b in batches:
        task, visitor = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        rest = [c.to_numpy() for c in b.columns[2:]]
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                yield int(task[i]), visitor[i:j], [c[i:j] for c in rest]


def links(distinct: DataFrame, radius: int = 3, tile: int = 1 << 17) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp) within the radius, a forest per task."""
    cells = distinct.select(
        (F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))) * 64 + F.bit_count(F.shiftrightunsigned("fp", 32))).alias("cell")
    )
    sizes = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # 33 * 33 rows at most
    plan = Cells(sizes, tile, within(radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for rows, task, visitor in plan.deal(halves(fps.view(np.uint64)), fps):
                yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(visitor), pa.array(fps[rows])], names=["task", "visitor", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((task, x[0].view(np.uint64)[~guest], x[0].view(np.uint64)[guest]) for task, guest, x in _by_task(batches))
        for u, v in compare(rows, radius, plan.alone):
            cols = [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["u", "v"])

    dealt = distinct.select("fp").mapInArrow(lean(deal), "task long, visitor boolean, fp long")
    dealt = dealt.repartition(width(distinct.sparkSession), "task").sortWithinPartitions("task", "visitor")
    return dealt.mapInArrow(lean(run), "u long, v long")


def near_duplicates(
    df: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = 1 << 17
) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest id reachable over links."""
    fps = saved(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, radius, tile))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with each class's smallest id, with all its columns."""
    return keep_least(df, near_duplicates(df, radius, words, id_col, text_col), id_col, text_col)


def keep_least(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``found`` (doc_id, component_id) names by their class's smallest id.

    Of rows with that id the one with the least text digest stays; a class without
    any id keeps its rows.
    """
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = kept.withColumnRenamed("doc_id", "kept")
    # the row goes through in one piece, whatever its columns are named
    rows = df.select(F.struct("*").alias("row"), df[id_col].cast("long").alias("id"), F.sha1(df[text_col].cast("string").cast("binary")).alias("sum"))
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["kept"]))
    single = rows.where("kept IS NULL OR rows = 1").select("row.*")
    order = Window.partitionBy("kept").orderBy("sum", F.to_json("row"))
    several = rows.where("kept IS NOT NULL AND rows > 1").withColumn("place", F.row_number().over(order)).where("place = 1")
    return single.union(several.select("row.*"))


# ------------------------------------------------------- sets of shingles

#: Jaccard coefficient of a link, as a fraction.
LEAST = (4, 5)
#: Fingerprints per set, and how many of all their bits, and of the first one's, a candidate pair may differ in.
#: At a Jaccard coefficient of 0.8 bits differ with a chance of 0.15: 39 of 256 on average, with a deviation of 6.
PARTS, RADIUS, FIRST = 4, 76, 25
SETS = "doc_id long, sum64 long, key long, n long, " + ", ".join(f"f{i} long" for i in range(PARTS))


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 of the shingles of lower-cased words (fewer words: of the whole)."""
    import xxhash

    found = text.decode("utf-8", "replace").lower().split()
    if len(found) < words:
        parts = [" ".join(found)] if found else []
    else:
        parts = map(" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.unique(np.array(list(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts)), np.uint64))


def set_bits(hashes: np.ndarray, parts: int = PARTS) -> list[int]:
    """Fingerprints of a set, of its hashes mixed anew for each, as signed longs."""
    out = []
    for part in range(parts):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            x = hashes[at : at + (1 << 16)]
            if part:
                x = (x ^ np.uint64(part * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(31)
                x *= np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(29)
            ones += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def sets_of(texts: DataFrame, words: int = 5, with_shingles: bool = False) -> DataFrame:
    """Per text (doc_id, text, sum64) its set's key (equal sets have equal keys), size and fingerprints; or key, size and shingles."""
    schema = "key long, n long, shingles array<long>" if with_shingles else SETS
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows, sets = [], []
                for text in b.column(1).slice(at, 500):
                    found = shingle_set(text.as_py(), words)
                    key = int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))
                    if with_shingles:
                        sets.append(found.view(np.int64))
                        rows.append((key, len(found)))
                    else:
                        rows.append((key, len(found), *set_bits(found)))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                cols = [*cols, pa.array(sets, pa.list_(pa.int64()))] if with_shingles else [b.column(0).slice(at, 500), b.column(2).slice(at, 500), *cols]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts.mapInArrow(lean(run), schema)


class SetTiles:
    """Sets sorted by size: keys, sizes, fingerprints, and population counts of all bits."""

    def __init__(self, columns: list[np.ndarray]):
        key, n, *bits = columns
        order = np.argsort(n, kind="stable")
        self.key, self.n = key[order], n[order]
        self.bits = [x[order].view(np.uint64) for x in bits]
        self.ones = sum(np.bitwise_count(x).astype(np.int32) for x in self.bits)


def candidates(a: SetTiles, b: SetTiles, least: tuple[int, int], side: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that sizes and fingerprints allow."""
    num, den = least
    same = a is b
    for x in range(0, len(a.key), side):
        one = slice(x, min(x + side, len(a.key)))
        low = np.searchsorted(b.n, -(-int(a.n[one][0]) * num // den))
        high = np.searchsorted(b.n, int(a.n[one][-1]) * den // num, "right")
        for y in range(max(low, x) if same else low, high, side):
            two = slice(y, min(y + side, high))
            p, q = a.ones[one], b.ones[two]
            if p.min() - q.max() > RADIUS or q.min() - p.max() > RADIUS:
                continue
            i, j = np.nonzero(np.bitwise_count(a.bits[0][one][:, None] ^ b.bits[0][two][None, :]) <= FIRST)
            i, j = i + x, j + y
            if same:
                ahead = i < j
                i, j = i[ahead], j[ahead]
            fits = np.minimum(a.n[i], b.n[j]) * den >= np.maximum(a.n[i], b.n[j]) * num
            i, j = i[fits], j[fits]
            near = sum(np.bitwise_count(u[i] ^ v[j]).astype(np.int32) for u, v in zip(a.bits, b.bits, strict=True)) <= RADIUS
            if near.any():
                yield i[near], j[near]


def candidate_links(sets: DataFrame, least: tuple[int, int], tile: int = 1 << 16) -> DataFrame:
    """(u, v): keys of candidates among sets (key, n, f0...), a forest per task."""
    num, den = least
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    counts = {r["cell"]: r["m"] for r in sets.groupBy(size.alias("cell")).agg(F.count("*").alias("m")).collect()}  # a row per order of size
    plan = Cells(counts, tile, lambda c, d: abs(c - d) <= 1)
    names = ["key", "n", *(f"f{i}" for i in range(PARTS))]
    schema = "task long, visitor boolean, " + ", ".join(f"{n} long" for n in names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, task, visitor in plan.deal(b.column(len(names)).to_numpy(), b.column(0).to_numpy()):
                cols = [pa.array(task), pa.array(visitor), *(b.column(i).take(pa.array(rows)) for i in range(len(names)))]
                yield pa.RecordBatch.from_arrays(cols, names=["task", "visitor", *names])

    def found(a: SetTiles, b: SetTiles) -> pa.RecordBatch:
        shift = 0 if a is b else len(a.key)
        forest = Forest(shift + len(b.key))
        for i, j in candidates(a, b, least):
            forest.join(i, shift + j)
        return _grown(forest, a.key if a is b else np.concatenate([a.key, b.key]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, home, guests in _both_sides(_by_task(batches)):  # two slices at most
            if home:
                a = SetTiles([np.concatenate(c) for c in zip(*home, strict=True)])
                if plan.alone(number):
                    yield found(a, a)
                elif guests:
                    yield found(a, SetTiles([np.concatenate(c) for c in zip(*guests, strict=True)]))

    dealt = sets.select(*names, size.alias("cell")).mapInArrow(lean(deal), schema)
    dealt = dealt.repartition(width(sets.sparkSession), "task").sortWithinPartitions("task", "visitor")
    return dealt.mapInArrow(lean(run), "u long, v long")


def _both_sides(runs: Iterator[tuple]) -> Iterator[tuple]:
    """(task, parts of its home rows, parts of its visitors) from runs of equal tasks."""
    task, home, guests = None, [], []
    for number, visitor, columns in runs:
        if number != task:
            if task is not None:
                yield task, home, guests
            task, home, guests = number, [], []
        for side, mine in ((home, ~visitor), (guests, visitor)):
            if mine.any():
                side.append([c[mine] for c in columns])
    if task is not None:
        yield task, home, guests


def _grown(forest: Forest, keys: np.ndarray) -> pa.RecordBatch:
    """A forest's links as rows."""
    pairs = np.array(forest.grown, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(keys[pairs[:, 0]]), pa.array(keys[pairs[:, 1]])], names=["u", "v"])


#: Shingles per slice of a group whose sets are compared in full.
TILE = 1 << 22


def set_links(sets: DataFrame, least: tuple[int, int], tile: int = TILE) -> DataFrame:
    """(u, v): links between sets (key, n, shingles) of one group that reach ``least``, a forest per pair of slices."""
    num, den = least
    large = sets.groupBy("group").agg((F.floor(F.sum("n") / tile) + 1).cast("int").alias("slices")).where("slices > 1")
    large = saved(large, "large")  # at most one per tile of all shingles
    rows = sets.join(large, "group", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
    low, high = F.least("home", "other"), F.greatest("home", "other")
    rows = rows.select("group", low.alias("a"), high.alias("b"), (F.col("home") > F.col("other")).alias("visitor"), "key", "shingles")
    rows = rows.repartition(width(sets.sparkSession), "group", "a", "b").sortWithinPartitions("group", "a", "b", "visitor")

    def found(home: list, guests: list, alone: bool) -> Iterator[pa.RecordBatch]:
        keys, own = [k for k, _ in home], [s for _, s in home]
        if not own or (alone and len(own) < 2):
            return
        sizes = np.array([len(s) for s in own])
        values, owner = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        visitors = home if alone else guests
        forest = Forest(len(own) + (0 if alone else len(guests)))
        for i, (_, mine) in enumerate(visitors):
            at, end = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            many = end - at
            places = np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())
            both = np.bincount(owner[places], minlength=len(own))
            near = np.flatnonzero(both * den >= (len(mine) + sizes - both) * num)
            near = near[near > i] if alone else near
            if len(near):
                forest.join(np.full(len(near), i if alone else len(own) + i), near)
        yield _grown(forest, np.array(keys if alone else keys + [k for k, _ in guests], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [])
        for batch in batches:
            group, a, b, key = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            guest, sets_ = batch.column(3).to_pylist(), batch.column(5)
            for i in range(batch.num_rows):
                if (group[i], a[i], b[i]) != task:
                    if task is not None:
                        yield from found(*sides, task[1] == task[2])
                    task, sides = (group[i], a[i], b[i]), ([], [])
                sides[guest[i]].append((key[i], sets_[i].values.to_numpy().copy()))
        if task is not None:
            yield from found(*sides, task[1] == task[2])

    return rows.mapInArrow(lean(run), "u long, v long")


def similar(
    df: DataFrame, least: tuple[int, int] = LEAST, words: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = 1 << 16, set_tile: int = TILE
) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest id reachable over links."""
    texts = id_text(df, id_col, text_col).withColumn("sum64", F.xxhash64("text"))
    whole = saved(sets_of(texts, words), "sets")
    bits = [f"f{i}" for i in range(PARTS)]
    distinct = whole.where("n > 0").groupBy("key").agg(F.any_value("n").alias("n"), *(F.any_value(f).alias(f) for f in bits))
    distinct = saved(distinct, "distinct")
    groups = saved(components(candidate_links(distinct, least, tile)).select(F.col("node").alias("key"), F.col("root").alias("group")), "groups")
    # only texts whose set is in a group are cut into shingles again; a text that shares their hash alone has another key
    wanted = whole.join(groups, "key", "left_semi").groupBy("key").agg(F.min("sum64").alias("sum64")).select("sum64").distinct()
    again = sets_of(texts.join(wanted, "sum64", "left_semi").select("doc_id", "text", "sum64"), words, True)
    held = again.join(groups, "key").groupBy("key").agg(F.any_value("group").alias("group"), F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles"))
    held = saved(held, "held")
    roots = components(set_links(held, least, set_tile))
    named = whole.groupBy("key").agg(F.min("doc_id").alias("least"))
    member = saved(named.join(roots, named["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root")), "members")
    least_ids = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    forget(distinct, groups, held)
    return whole.select("doc_id", "key").join(least_ids, "key").select("doc_id", "component_id")


def keep_one_similar(df: DataFrame, least: tuple[int, int] = LEAST, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with each group's smallest id, with all its columns."""
    return keep_least(df, similar(df, least, words, id_col, text_col), id_col, text_col)
