"""Whether one value or fact says at least as much as another."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import window


def time_value(text: Column, precision: Column, calendar: Column) -> Column:
    """lo, hi and precision of a time literal; parts below the precision may be written as 00."""
    lo, hi = window(text, precision, calendar)
    return F.struct(lo.alias("lo"), hi.alias("hi"), precision.cast("int").alias("precision"))


def time_refines(a: Column, b: Column) -> Column:
    return (a["lo"] >= b["lo"]) & (a["hi"] <= b["hi"]) & (a["precision"] >= b["precision"])


def quantity(amount: Column, unit: Column, lower: Column, upper: Column) -> Column:
    """Bounds default to the amount itself."""
    number = lambda x: x.cast("decimal(38,18)")
    return F.struct(unit.alias("unit"), F.coalesce(number(lower), number(amount)).alias("lo"), F.coalesce(number(upper), number(amount)).alias("hi"))


def quantity_refines(a: Column, b: Column) -> Column:
    return (a["unit"] == b["unit"]) & (a["lo"] >= b["lo"]) & (a["hi"] <= b["hi"])


def geo(lat: Column, lon: Column, precision: Column, globe: Column) -> Column:
    number = lambda x: x.cast("decimal(38,18)")
    return F.struct(number(lat).alias("lat"), number(lon).alias("lon"), number(precision).alias("precision"), globe.alias("globe"))


def geo_refines(a: Column, b: Column) -> Column:
    """The same point and cell, or a finer cell of the same globe whose point lies in the other's."""
    near = lambda x: F.abs(a[x] - b[x]) * 2 <= b["precision"]
    same = (a["precision"] == b["precision"]) & (a["lat"] == b["lat"]) & (a["lon"] == b["lon"])
    return (a["globe"] == b["globe"]) & (same | ((a["precision"] < b["precision"]) & near("lat") & near("lon")))


def facts_refining(bindings: DataFrame, wanted: Sequence[tuple[str, str | None]], frozen: Sequence[str] = ()) -> DataFrame:
    """(fact_id) of facts that refine a described one; None stands for an unknown filler.

    Per role every described value must be matched by a binding of its own;
    roles in ``frozen`` must have no more bindings than described.
    """
    roles = sorted({r for r, _ in wanted})
    checks = [F.lit(True)]
    for (role, value), n in Counter(wanted).items():
        if value is not None:
            checks.append(F.count_if((F.col("role") == role) & (F.col("ident") == value)) >= n)
    for role, n in Counter(r for r, _ in wanted).items():
        held = F.count_if(F.col("role") == role)
        checks.append(held == n if role in frozen else held >= n)
    met = bindings.where(F.col("role").isin(*roles)).groupBy("fact_id").agg(*(c.alias(f"m{i}") for i, c in enumerate(checks[1:])))
    for i in range(len(checks) - 1):
        met = met.where(f"m{i}")
    return met.select("fact_id")


def matching(a: list, b: list, fits) -> bool:
    """Whether every element of b has an element of a of its own that fits it (augmenting paths)."""
    owner: dict[int, int] = {}

    def place(j: int, tried: set[int]) -> bool:
        for i in range(len(a)):
            if i not in tried and fits(a[i], b[j]):
                tried.add(i)
                if i not in owner or place(owner[i], tried):
                    owner[i] = j
                    return True
        return False

    return all(place(j, set()) for j in range(len(b)))
