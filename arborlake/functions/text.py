"""Scalar functions as column expressions: tokens, derived ids, hashes and text helpers. All but nfc() stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"  # fixed value: base32 in lower case
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # as conv() writes it
SEPARATOR = "\x1f"


def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode normal form C; only texts beyond Latin-1 leave the JVM for it."""
    return F.when(c.rlike(r"^[\x00-ÿ]*$"), c).otherwise(F.pandas_udf(_nfc, "string")(c))


def tokens(label: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def derived_id(tag: str, *segments: Column) -> Column:
    """tag and the first 16 bytes of the SHA-256 of the joined segments, in lower-case base32 (26 characters).

    60 bits at a time are written to base 32, then its digits are replaced; the last 8 bits are followed by zeros.
    """
    part = lambda hexes, n: F.lpad(F.conv(hexes, 16, 32), n, "0")

    def letters(digits: Column) -> Column:
        last = F.substring(part(F.concat(F.substring(digits, 31, 2), F.lit("000")), 4), 1, 2)
        return F.concat(F.lit(tag), F.translate(F.concat(part(F.substring(digits, 1, 15), 12), part(F.substring(digits, 16, 15), 12), last), BASE32, ALPHABET))

    digits = F.sha2(F.concat_ws(SEPARATOR, *segments), 256)
    return F.get(F.transform(F.array(digits), letters), 0)  # the digits are computed once, not for each part


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over the code points of a text, as eight hex digits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda a, x: F.pmod(a.bitwiseXOR(x) * F.lit(0x01000193), F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def slug(c: Column) -> Column:
    """A heading as a link target: lower case, marks dropped, spaces to dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s-]", ""), r"\s", "-")


def excerpt(c: Column, most: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def namespace_of(key: Column) -> Column:
    return F.when(F.instr(key, ":") > 0, F.substring_index(key, ":", 1))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def timestamp_ms(c: Column) -> Column:
    """Milliseconds from an ISO time or from seconds since 1970, written as text."""
    return F.coalesce(F.try_to_timestamp(c).cast("double") * 1000, c.try_cast("double") * 1000).cast("long")
