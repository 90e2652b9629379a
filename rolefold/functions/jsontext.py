"""Strict JSON: what standard parsers let pass is named, and values have one canonical text."""

from __future__ import annotations

import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

MOST_INT, DEEPEST = 2**53 - 1, 256


class Refused(ValueError):
    """A text that isn't strict JSON; args[0] is the code."""


def _pairs(items: list[tuple]) -> dict:
    out: dict = {}
    for k, v in items:
        if k in out:
            raise Refused("J003")
        out[k] = v
    return out


def _constant(_: str):
    raise Refused("J004")


def _int(text: str) -> int:
    if len(text) > 20 or abs(int(text)) > MOST_INT:
        raise Refused("J006")
    return int(text)


def _check(value, depth: int = 1) -> None:
    if depth > DEEPEST:
        raise Refused("J001")
    if isinstance(value, str):
        if any("\ud800" <= c <= "\udfff" for c in value):
            raise Refused("J005")
    elif isinstance(value, dict):
        for k, v in value.items():
            _check(k, depth)
            _check(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            _check(v, depth + 1)


def _float(text: str) -> float:
    """A number too large for a double is infinity, which JSON doesn't have."""
    if math.isinf(value := float(text)):
        raise Refused("J004")
    return value


def strict(text: str) -> dict:
    """The object in a text; Refused with J001 syntax or depth, J002 byte-order mark, J003 repeated key,
    J004 NaN or infinity, J005 lone surrogate, J006 large integer, J007 not an object."""
    if text.startswith("﻿"):
        raise Refused("J002")
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant, parse_int=_int, parse_float=_float)
    except Refused:
        raise
    except (ValueError, RecursionError):
        raise Refused("J001") from None
    _check(value)
    if not isinstance(value, dict):
        raise Refused("J007")
    return value


def _number(x: float | int) -> str:
    """The shortest text that reads back the same, as ECMAScript writes it."""
    if isinstance(x, int):
        return str(x)
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = f"{x!r}".partition("e")
    if not exponent:
        return digits
    n = int(exponent)
    if -7 < n < 0:
        sign, plain = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return f"{sign}0.{'0' * (-n - 1)}{plain.replace('.', '')}"
    return f"{digits.removesuffix('.0')}e{n:+d}"


def canonical(value) -> str:
    """Keys in code-point order, no white space, normal form C, shortest numbers."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value), ensure_ascii=False)
    if isinstance(value, list):
        return f"[{','.join(map(canonical, value))}]"
    named = {unicodedata.normalize("NFC", k): v for k, v in value.items()}
    return "{" + ",".join(f"{canonical(k)}:{canonical(named[k])}" for k in sorted(named)) + "}"


def _parse(text: str | None) -> tuple[str | None, str | None]:
    if text is None:
        return None, "J001"
    try:
        return canonical(strict(text)), None
    except Refused as e:
        return None, e.args[0]


@F.pandas_udf(StructType().add("canonical", StringType()).add("code", StringType()))
def strict_parse(text: pd.Series) -> pd.DataFrame:
    """(canonical, code): the canonical text, or why it is refused.  Used once, at ingest."""
    return pd.DataFrame([_parse(t) for t in text], columns=["canonical", "code"])
