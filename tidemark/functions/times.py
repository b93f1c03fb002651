"""Durations and timestamps as plain values and as columns."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import ConfigError

#: The units of a duration in milliseconds.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
DURATION = re.compile(r"^(\d+(?:\.\d+)?)(ms|s|m|h|d)$")
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_duration(value: int | float | str, label: str = "duration") -> int | float:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if not math.isfinite(value) or value < 0:
            raise ConfigError(f"{label} must be a finite number of milliseconds from 0 on, got {value}")
        return value
    m = DURATION.match(value) if isinstance(value, str) else None
    if not m:
        raise ConfigError(f"{label} must look like 250ms, 5s, 2m, 6h or 1d, got {value!r}")
    return math.floor(float(m[1]) * UNITS[m[2]] + 0.5)


def format_duration(ms: int) -> str:
    for unit in ("d", "h", "m"):
        if ms and ms % UNITS[unit] == 0:
            return f"{ms // UNITS[unit]}{unit}"
    return f"{ms // 1000}s" if ms % 1000 == 0 else f"{ms}ms"


def duration_ms(c: Column) -> Column:
    """Milliseconds of a duration text; null where it is none."""
    amount = F.regexp_extract(c, DURATION.pattern, 1)
    unit = F.regexp_extract(c, DURATION.pattern, 2)
    table = F.create_map(*(x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))))
    return F.when(unit != "", F.floor(amount.cast("double") * F.try_element_at(table, unit) + 0.5).cast("long"))


def timestamp_ms(c: Column) -> Column:
    """ten digits are seconds, thirteen milliseconds, else an ISO date; null where unparseable.

    The pattern keeps Spark from reading words such as "yesterday".
    """
    iso = F.when(c.rlike(ISO), F.unix_millis(F.try_to_timestamp(c)))
    return F.when(c.rlike(r"^\d{10}$"), c.try_cast("long") * 1000).when(c.rlike(r"^\d{13}$"), c.try_cast("long")).otherwise(iso)


def parse_timestamp(value: str | None) -> int | None:
    if value is None:
        return None
    if re.fullmatch(r"\d{10}", value):
        return int(value) * 1000
    if re.fullmatch(r"\d{13}", value):
        return int(value)
    if not re.match(ISO, value):
        return None
    try:
        t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None
    return math.floor((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000 + 0.5)


def format_timestamp(ms: int, sample: str) -> str:
    """in the form of the sample."""
    if re.fullmatch(r"\d{10}", sample):
        return str(ms // 1000)
    if re.fullmatch(r"\d{13}", sample):
        return str(ms)
    return iso_ms(ms)


def iso_ms(ms: int) -> str:
    t = datetime.fromtimestamp(ms // 1000, UTC)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def iso_column(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_timestamp_column(ms: Column, sample: Column) -> Column:
    seconds = F.floor(ms / 1000).cast("long").cast("string")
    return F.when(sample.rlike(r"^\d{10}$"), seconds).when(sample.rlike(r"^\d{13}$"), ms.cast("string")).otherwise(iso_column(ms))


def compare_timestamps(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(timestamp_ms(a) - timestamp_ms(b)).cast("int")


def max_string(a: Column, b: Column) -> Column:
    """the larger by UTF-16 code units; a null loses."""
    larger = F.when(F.encode(a, "UTF-16BE") >= F.encode(b, "UTF-16BE"), a).otherwise(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(larger)
