"""Canonical values, digests and text measures."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def quoted(text: Column) -> Column:
    """A string as canonical JSON (short escapes for the usual controls)."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def digest(domain: str, canonical: Column) -> Column:
    """sha256:<hex> of the domain, a line feed and the canonical text."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(domain + "\n"), canonical), 256))


def json_array(items: Column) -> Column:
    """An array of canonical texts as one canonical JSON array."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def canonical_decimal(text: Column) -> Column:
    """Signed decimal without leading or trailing zeros: '+007.50' is '7.5', '-0.0' is '0'."""
    sign = F.when(F.regexp_extract(text, r"^([+-]?)", 1) == "-", "-").otherwise("")
    whole = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), r"^0+", "")
    part = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)$", 1), r"0+$", "")
    whole = F.when(whole == "", "0").otherwise(whole)
    out = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return F.when(out == "0", "0").otherwise(F.concat(sign, out))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    out = F.translate(F.lower(text), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    out = F.regexp_replace(out, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda x: x != "")


def multiset_common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of token precision and recall; 1 for two empty answers, 0 for one."""
    x, y = tokens(a), tokens(b)
    common = multiset_common(x, y)
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(empty, (F.size(x) == F.size(y)).cast("double")).otherwise(2.0 * common / (F.size(x) + F.size(y)))


def text_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def span(text: Column, start: Column | int, end: Column | int) -> Column:
    """The code points from start up to end, counted from 0."""
    a = F.lit(start) if isinstance(start, int) else start
    b = F.lit(end) if isinstance(end, int) else end
    return F.substring(text, a + 1, b - a)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Normalization form C; Spark has no such function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def iri_encode(text: Column) -> Column:
    """Percent-encoding of everything but unreserved characters; form encoding differs in three of them."""
    out = F.url_encode(text)
    for form, percent in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(percent))
    return out


def iri_decode(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
