"""Instants, precision windows and the four-bound validity of facts, as BIGINT columns.

An instant is a whole second: the Julian day number times 86400 plus the time of
day.  Open sides are sentinels, so every comparison stays an integer one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
OPEN = 1 << 62  # the open future; -OPEN is the open past
UNIX_EPOCH_JDN = 2440588

TIME_PATTERN = r"^([+-])([0-9]{4,16})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})Z$"


def floor_div(x: Column, n: int) -> Column:
    """Division that rounds down; ``div`` alone rounds towards zero."""
    return _div(x - F.pmod(x, F.lit(n).cast("long")), n)


def _div(x: Column, n: int) -> Column:
    return F.call_function("div", x, F.lit(n).cast("long"))


def julian_day(year: Column, month: Column, day: Column, calendar: Column) -> Column:
    """Day number of a date with an astronomical year, in the Gregorian or the Julian calendar."""
    shift = _div(F.lit(14).cast("long") - month, 12)  # 1 for January and February
    y, m = year + 4800 - shift, month + 12 * shift - 3
    base = day + _div(153 * m + 2, 5) + 365 * y + floor_div(y, 4)
    return F.when(calendar == "julian", base - 32083).otherwise(base - floor_div(y, 100) + floor_div(y, 400) - 32045)


def astronomical(year: Column) -> Column:
    """Written years have no year 0: 1 BCE is -1 in writing and 0 here."""
    return F.when(year < 0, year + 1).otherwise(year)


def day_instant(ts: Column) -> Column:
    """The instant at which a timestamp's day starts."""
    return (F.unix_date(F.to_date(ts)).cast("long") + UNIX_EPOCH_JDN) * DAY


def parse_time(text: Column) -> dict[str, Column]:
    """Signed written year and the other parts of a time literal; nulls where it isn't one."""
    part = lambda i: F.regexp_extract(text, TIME_PATTERN, i).try_cast("long")
    sign = F.when(F.regexp_extract(text, TIME_PATTERN, 1) == "-", -1).otherwise(1)
    names = ("month", "day", "hour", "minute", "second")
    return {"year": sign * part(2)} | {n: part(i) for i, n in enumerate(names, 3)}


def window(text: Column, precision: Column, calendar: Column) -> tuple[Column, Column]:
    """[lo, hi) in instants of a time literal: seconds to days fixed, months and longer by calendar.

    Millennia (6) and centuries (7) are ordinal; decades (8) and 5 to 0 floor the astronomical year.
    """
    # The parts are bound once by a one-element array: inlined, they would outgrow a generated method.
    parts = parse_time(text) | {"precision": precision.cast("int"), "calendar": calendar}
    bound = F.transform(F.array(F.struct(*(c.alias(n) for n, c in parts.items()))), _period)
    found = F.transform(bound, _window_of_period)[0]
    return found["lo"], found["hi"]


def _period(p: Column) -> Column:
    """First year, its successor and the months in which they start; fixed sizes keep the exact day."""
    year, precision = astronomical(p["year"]), p["precision"]
    case = lambda table, other: reduce(lambda c, x: c.when(precision == x[0], x[1]), table[1:], F.when(precision == table[0][0], table[0][1])).otherwise(other)
    unit = case([(8, F.lit(10)), (7, F.lit(100)), (6, F.lit(1000)), *((n, F.lit(10 ** (9 - n))) for n in range(6))], F.lit(1)).cast("long")
    size = case([(14, F.lit(1)), (13, F.lit(60)), (12, F.lit(3600))], F.lit(DAY)).cast("long")
    nth = F.call_function("div", F.abs(p["year"]) + unit - 1, unit)
    ordinal = F.when(p["year"] > 0, unit * nth - unit + 1).otherwise(1 - unit * nth)
    first = F.when(precision >= 10, year).when(precision.isin(6, 7), ordinal).otherwise(year - F.pmod(year, unit))
    one, short = F.lit(1).cast("long"), precision >= 10
    turn = (precision == 10) & (p["month"] == 12)
    return F.struct(
        precision.alias("precision"), p["calendar"].alias("calendar"), size.alias("size"),
        first.alias("year"), F.when(short, p["month"]).otherwise(one).alias("month"), F.when(precision >= 11, p["day"]).otherwise(one).alias("day"),
        (p["hour"] * 3600 + p["minute"] * 60 + p["second"]).alias("time"),
        F.when(turn, first + 1).when(precision == 10, first).otherwise(first + unit).alias("next_year"),
        F.when((precision == 10) & ~turn, p["month"] + 1).otherwise(one).alias("next_month"),
    )


def _window_of_period(x: Column) -> Column:
    lo = julian_day(x["year"], x["month"], x["day"], x["calendar"]) * DAY + F.when(x["precision"] >= 11, x["time"]).otherwise(0)
    end = julian_day(x["next_year"], x["next_month"], F.lit(1).cast("long"), x["calendar"]) * DAY
    return F.struct(lo.alias("lo"), F.when(x["precision"] >= 11, lo + x["size"]).otherwise(end).alias("hi"))


def bounds(start_kind: Column, start: tuple[Column, Column], end_kind: Column, end: tuple[Column, Column]) -> dict[str, Column]:
    """s_lo, s_hi, e_lo, e_hi of an interval fact; kinds are literal, somevalue, novalue or null (absent)."""
    low, high = F.lit(-OPEN), F.lit(OPEN)
    e_hi = F.when(end_kind == "literal", end[1]).otherwise(high)
    s_lo = F.when(start_kind == "literal", start[0]).otherwise(low)
    return {
        "s_lo": s_lo,
        "s_hi": F.when(start_kind == "literal", start[1]).when(start_kind == "novalue", low).otherwise(e_hi),
        "e_lo": F.when(end_kind == "literal", end[0]).when(end_kind == "somevalue", s_lo).otherwise(high),
        "e_hi": e_hi,
    }


def holds(instant: Column | int, mode: str = "definite") -> Column:
    """Whether a fact row holds at an instant, surely or possibly."""
    t = F.lit(instant) if isinstance(instant, int) else instant
    lo, hi = ("s_hi", "e_lo") if mode == "definite" else ("s_lo", "e_hi")
    return (F.col(lo) <= t) & (t < F.col(hi))


def overlap(a: str, b: str, mode: str = "definite") -> Column:
    """Whether the validities of aliases a and b have an instant in common."""
    lo, hi = ("s_hi", "e_lo") if mode == "definite" else ("s_lo", "e_hi")
    return F.greatest(f"{a}.{lo}", f"{b}.{lo}") < F.least(f"{a}.{hi}", f"{b}.{hi}")
