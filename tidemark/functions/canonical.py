"""Canonical JSON (RFC 8785) as a column, and the hashes and ids made from it.

The text is built from the schema at plan time: names sorted by UTF-16 code units, strings escaped, numbers as shortest
ECMAScript text. Longs and decimals keep their digits. Doubles that are integral or short stay in the JVM; the rest
needs the shortest round-trip text, which ``number_text`` gives in an Arrow UDF.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "tidemark|v1|"
#: Short escapes of JSON strings.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def utf16(name: str) -> bytes:
    return name.encode("utf-16-be", "surrogatepass")


def es_number(v: float) -> str:
    """ECMAScript's text of a double."""
    if not math.isfinite(v):
        raise ValueError("canonical JSON has no NaN or infinity")
    if v == 0:
        return "0"
    mantissa, _, exponent = f"{v!r}".replace("E", "e").partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + ("e+" if e >= 0 else "e-") + str(abs(e))


def number_text(c: Column) -> Column:
    """Shortest round-trip text, in Arrow batches; the function is made when a session is there."""

    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or x != x else es_number(float(x)))

    return text(c)


def double_text(c: Column, inner: bool = False) -> Column:
    """Integral doubles below 2**53 are long texts; others go through Arrow.

    Inside arrays and maps Spark allows no Arrow function, so there the JVM's own digits are laid out; before Java 19
    these are now and then one digit longer than the shortest.
    """
    plain = (c == F.floor(c)) & (F.abs(c) < 9007199254740992.0)
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    other = laid_out(c) if inner else number_text(c)
    return F.when(bad, F.raise_error(F.lit("canonical JSON has no NaN or infinity"))).when(plain, c.cast("long").cast("string")).otherwise(other)


def laid_out(c: Column) -> Column:
    """ECMAScript's layout of the digits and exponent of Java's text."""
    text = F.abs(c).cast("string")
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"\.(\d+)", 1)
    all_digits = F.concat(whole, part)
    digits = F.regexp_replace(F.regexp_replace(all_digits, "^0+", ""), "0+$", "")
    point = F.length(whole) + exponent - (F.length(all_digits) - F.length(F.regexp_replace(all_digits, "^0+", "")))
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)))
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(F.lit(""))
    e = point - 1
    far = F.concat(F.left(digits, F.lit(1)), tail, F.when(e >= 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(e).cast("string"))
    out = (
        F.when((n <= point) & (point <= 21), F.concat(digits, zeros(point - n)))
        .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(400))))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
        .otherwise(far)
    )
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), out)


def string_text(c: Column) -> Column:
    out = c
    for raw, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rest = out
    for code in range(0x20):
        if chr(code) not in ESCAPES:
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rest).otherwise(out), F.lit('"'))


def canonical(c: Column, kind: T.DataType, ignore_nulls: bool = False, inner: bool = False) -> Column:
    """Canonical JSON text of a column of the given type."""
    return F.coalesce(_text(c, kind, ignore_nulls, inner), F.lit("null"))


def _text(c: Column, kind: T.DataType, skip: bool, inner: bool) -> Column:
    if isinstance(kind, T.StructType):
        members = []
        for f in sorted(kind.fields, key=lambda f: utf16(f.name)):
            name = json.dumps(f.name, ensure_ascii=False) + ":"
            value = _text(c[f.name], f.dataType, skip, inner)
            members.append(F.concat(F.lit(name), value) if skip else F.concat(F.lit(name), F.coalesce(value, F.lit("null"))))
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        parts = F.transform(c, lambda x: canonical(x, kind.elementType, skip, True))
        return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(F.encode(e["key"], "UTF-16BE").alias("o"), F.concat(string_text(e["key"]), F.lit(":"), canonical(e["value"], kind.valueType, skip, True)).alias("t")))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: e["t"]), ","), F.lit("}"))
    if isinstance(kind, T.StringType):
        return string_text(c)
    if isinstance(kind, T.BooleanType):
        return c.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return double_text(c.cast("double"), inner)
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    return string_text(c.cast("string"))


def hash_text(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, in lower-case hex."""
    return F.sha2(c, 256)


def hash_url(c: Column) -> Column:
    """F5."""
    return F.substring(F.sha2(c, 256), 1, 32)


def escaped_part(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def event_id_material(source: Column, partition: Column, identity: Column, version: Column, schema_version: Column, kind: Column, prefix: str = PREFIX) -> Column:
    parts = [escaped_part(x.cast("string")) for x in (source, partition, identity, version, schema_version, kind)]
    return F.concat(F.lit(prefix), F.concat_ws("|", *parts))


def event_id(*parts: Column, prefix: str = PREFIX) -> Column:
    """the same change gives the same id, wherever and however often it is seen."""
    return F.sha2(event_id_material(*parts, prefix=prefix), 256)


def quarantine_id(text: Column) -> Column:
    """F8."""
    return F.concat(F.lit("invalid:"), F.substring(F.sha2(text, 256), 1, 32))
