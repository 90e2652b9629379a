"""Exact quantiles of groups too large for one place, by counting.

Doubles sort like the unsigned integers made of their bits (negative ones turned
round), so each round settles sixteen more bits of the values asked for: tasks
count the next sixteen bits of the values that agree so far, and the sums say in
which count a rank lies.  Four rounds end at the value itself.  At most 65,536
counts for each group and rank reach the driver, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Group numbers and values of a batch's rows that take part.
Keyed = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]

ROUNDS, BITS = 4, 16


def sortable(values: np.ndarray) -> np.ndarray:
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)  # no negative zero
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def value_of(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counts(rows: DataFrame, keyed: Keyed, wanted: dict[int, list[int]] | None, at: int) -> dict[int, dict[int, int]]:
    """Per group, how many values share their first bits; wanted: the bits that were settled before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, values = keyed(b)
            top = sortable(values) >> np.uint64(64 - BITS * (at + 1))
            if wanted is not None:
                above, held = top >> np.uint64(BITS), np.zeros(len(top), bool)
                for g, known in wanted.items():
                    held |= (group == g) & np.isin(above, np.array(known, np.uint64))
                group, top = group[held], top[held]
            pairs, many = np.unique(np.stack([group.astype(np.int64), top.view(np.int64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(many.astype(np.int64))], names=["group", "top", "n"])

    found: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(run, "group long, top long, n long").groupBy("group", "top").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["group"], {})[r["top"] % (1 << 64)] = r["n"]
    return found


def quantiles(rows: DataFrame, keyed: Keyed, shares: list[float]) -> dict[int, tuple[int, list[float]]]:
    """Per group the number of its values and their quantiles, between two values in proportion; no NaN may take part."""
    counts = _counts(rows, keyed, None, 0)
    sizes = {g: sum(found.values()) for g, found in counts.items()}
    places = {g: [(int(s * (n - 1)), s * (n - 1) % 1) for s in shares] for g, n in sizes.items()}
    # (group, rank) -> first bits, rank among the values that have them
    now = {(g, r): (0, r) for g, found in places.items() for x, _ in found for r in (x, min(x + 1, sizes[g] - 1))}
    for at in range(ROUNDS):
        if at:
            wanted: dict[int, list[int]] = {}
            for (g, _), (bits, _) in now.items():
                wanted.setdefault(g, []).append(bits)
            counts = _counts(rows, keyed, wanted, at)
        ordered = {g: sorted(found.items()) for g, found in counts.items()}
        for (g, r), (bits, left) in now.items():
            for top, n in ordered[g]:
                if at and top >> BITS != bits:
                    continue
                if left < n:
                    now[g, r] = top, left
                    break
                left -= n
    value = {k: value_of(bits) for k, (bits, _) in now.items()}
    between = lambda g, x, rest: value[g, x] + rest * (value[g, min(x + 1, sizes[g] - 1)] - value[g, x])
    return {g: (sizes[g], [between(g, x, rest) for x, rest in found]) for g, found in places.items()}
