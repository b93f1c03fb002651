"""What a feed is: how it is read, what identifies a row, what counts as a change, how it is delivered."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import ConfigError
from tidemark.functions.canonical import canonical, hash_text
from tidemark.functions.times import parse_duration
from tidemark.strategies import KINDS, PAGES, Strategy

NAME = re.compile(r"^[a-zA-Z][a-zA-Z0-9_.-]{0,127}$")


@dataclass(frozen=True)
class Backoff:
    base_ms: int = 1000
    factor: float = 2.0
    max_ms: int = 600_000


@dataclass(frozen=True)
class Schedule:
    min_ms: int = 30_000
    max_ms: int = 300_000
    adaptive: bool = True
    jitter: float = 0.1
    backoff: Backoff = Backoff()
    circuit_failures: int = 5
    probe_every_ms: int = 300_000


@dataclass(frozen=True)
class Delivery:
    attempts: int = 5
    backoff: Backoff = Backoff(max_ms=120_000)
    on_poison: str = "park"
    hold: bool = True
    ordering_key: str = "subject"  # an SQL expression over the event's columns


@dataclass(frozen=True)
class FeedSpec:
    """Columns are SQL expressions over the rows that ``fetch`` returns; they stay inside the plan."""

    name: str
    fetch: Callable[..., DataFrame]
    identity: str
    version: str | None = None
    fingerprint: tuple[str, ...] = ()
    cursor: str = "snapshot"
    cursor_field: str | None = None
    cursor_tie: str | None = None
    overlap_ms: int = 0
    lag_ms: int = 0
    schema_version: int = 1
    on_schema_change: str = "rebaseline"
    retain: str = "hash"
    invalid: str = "quarantine"
    checks: Mapping[str, tuple[str, Column]] = field(default_factory=dict)
    source: str | None = None
    schedule: Schedule = Schedule()
    delivery: Delivery = Delivery()
    partitions: Callable[[], list[str]] | None = None
    partitions_refresh_ms: int = 300_000
    reconcile_every_ms: int | None = None
    reconcile_fetch: Callable[..., DataFrame] | None = None
    cursor_start: str | None = None
    custom: Strategy | None = None
    max_pages: int = PAGES
    budget: str | None = None
    cost: int = 1
    weight: float = 1.0

    def __post_init__(self) -> None:
        if not NAME.match(self.name):
            raise ConfigError(f"a feed's name must match {NAME.pattern}, got {self.name!r}")
        checks = ((self.cursor, tuple(KINDS), "cursor"), (self.on_schema_change, ("rebaseline", "emit"), "on_schema_change"), (self.retain, ("hash", "payload"), "retain"), (self.invalid, ("quarantine", "skip", "fail"), "invalid"), (self.delivery.on_poison, ("park", "halt"), "on_poison"))
        for value, allowed, what in checks:
            if value not in allowed:
                raise ConfigError(f"{what} must be one of {', '.join(allowed)}, got {value!r}")
        if self.cursor == "timestamp" and not self.cursor_field:
            raise ConfigError("a timestamp cursor needs cursor_field")
        if self.cursor == "custom" and not isinstance(self.custom, Strategy):
            raise ConfigError("a custom cursor needs a strategy")
        if self.max_pages < 1 or self.cost < 0 or self.weight <= 0:
            raise ConfigError("max_pages must be 1 or more, cost 0 or more, weight above 0")
        if self.schema_version < 1 or self.delivery.attempts < 1 or self.schedule.circuit_failures < 1:
            raise ConfigError("schema_version, attempts and circuit_failures must be 1 or more")
        if not 0 < self.schedule.min_ms <= self.schedule.max_ms or not 0 <= self.schedule.jitter <= 1:
            raise ConfigError("the schedule needs 0 < min_ms <= max_ms and a jitter from 0 to 1")
        for label in ("overlap_ms", "lag_ms"):
            parse_duration(getattr(self, label), label)

    @property
    def urn(self) -> str:
        return self.source or f"urn:feed:{self.name}"

    def candidates(self, rows: DataFrame, position: str | None = None) -> DataFrame:
        """(identity, version, hash, data, _pos): canonical data of the whole row, hash of the fingerprint."""
        fields = rows.drop(position) if position else rows
        identity = F.expr(self.identity)
        kind = rows.select(identity.alias("i")).schema["i"].dataType
        if not isinstance(kind, (T.StringType, T.IntegralType)):
            raise ConfigError(f"an identity must be a text or an integer, not {kind.simpleString()}")
        whole = F.struct(*fields.columns)
        marked = F.struct(*(F.expr(f).alias(f) for f in self.fingerprint)) if self.fingerprint else whole
        types = rows.select(whole.alias("w"), marked.alias("m")).schema
        known = F.when(identity.isNull(), F.raise_error(F.lit("an identity is null"))).otherwise(identity.cast("string"))
        return rows.select(
            known.alias("identity"),
            (F.expr(self.version).cast("string") if self.version else F.lit(None).cast("string")).alias("version"),
            hash_text(canonical(marked, types["m"].dataType)).alias("hash"),
            canonical(whole, types["w"].dataType).alias("data"),
            (F.col(position) if position else F.lit(0)).alias("_pos"),
        )
