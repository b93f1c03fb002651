"""A source for tests: a data set with listings, faults, entity tags, rate limits and a call log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.engine import Context, Listing
from tidemark.errors import HttpError
from tidemark.functions.times import parse_timestamp

WORD = 0xFFFFFFFF


class Draws:
    """mulberry32: a 32-bit counter, mixed; runs repeat anywhere. The shifts, odd factors and the increment are fixed values."""

    def __init__(self, seed: int):
        self.state = seed & WORD

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & WORD
        x = self.state
        x = ((x ^ (x >> 15)) * (x | 1)) & WORD
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & WORD)) & WORD
        return (x ^ (x >> 14)) / 2**32

    def below(self, n: int) -> int:
        return int(self() * n)

    def between(self, low: int, high: int) -> int:
        """Both ends included."""
        return low + self.below(high - low + 1)

    def chance(self, p: float) -> bool:
        return self() < p

    def pick(self, things: Sequence[Any]) -> Any:
        if not things:
            raise ValueError("there is nothing to pick from")
        return things[self.below(len(things))]

    def shuffle(self, things: Sequence[Any]) -> list[Any]:
        """A new list, each order as likely as any other."""
        out = list(things)
        for last in range(len(out) - 1, 0, -1):
            other = self.below(last + 1)
            out[last], out[other] = out[other], out[last]
        return out

    def fork(self) -> Draws:
        return Draws(self.below(2**32))


def opaque_tag(text: str, seed: int = 0) -> int:
    """cyrb53: 53 bits of a text's UTF-16 code units, for entity tags of the fake source only. Its factors are fixed values."""
    raw = text.encode("utf-16-le")
    lanes = [(0xDEADBEEF ^ seed) & WORD, (0x41C6CE57 ^ seed) & WORD]
    for k in range(0, len(raw), 2):
        unit = int.from_bytes(raw[k : k + 2], "little")
        lanes = [((lane ^ unit) * factor) & WORD for lane, factor in zip(lanes, (2654435761, 1597334677))]
    a, b = lanes
    a = ((a ^ (a >> 16)) * 2246822507 & WORD) ^ ((b ^ (b >> 13)) * 3266489909 & WORD)
    b = ((b ^ (b >> 16)) * 2246822507 & WORD) ^ ((a ^ (a >> 13)) * 3266489909 & WORD)
    return (b & 0x1FFFFF) << 32 | a


@dataclass
class FakeSource:
    spark: SparkSession
    schema: str
    key: str = "id"
    at: str = "updated"
    size: int = 100
    rows: dict[str, dict] = field(default_factory=dict)
    faults: list[tuple[int, int | None]] = field(default_factory=list)
    calls: list[Context] = field(default_factory=list)
    tag: int = 0
    etags: bool = False
    seen: dict[tuple[str, str], int] = field(default_factory=dict)
    limit: tuple[int, int] | None = None  # calls and milliseconds of a rate-limit window
    clock: Callable[[], int] = lambda: 0
    latency: Callable[[], None] = lambda: None

    def put(self, *rows: dict) -> None:
        for r in rows:
            self.rows[str(r[self.key])] = self.rows.get(str(r[self.key]), {}) | r
        self.tag += 1

    def remove(self, key: str) -> bool:
        self.tag += 1
        return self.rows.pop(str(key), None) is not None

    def fail_next(self, status: int, retry_after_ms: int | None = None, times: int = 1) -> None:
        self.faults += [(status, retry_after_ms)] * times

    def etag(self) -> str:
        return f'W/"{opaque_tag(repr(sorted(self.rows.items()))):x}"'

    def frame(self, rows: Sequence[dict] | None = None) -> DataFrame:
        names = [x.split()[0] for x in self.schema.split(", ")]
        some = [r for _, r in sorted(self.rows.items())] if rows is None else rows
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in some], self.schema)

    def _called(self, ctx: Context) -> dict | None:
        """Log the call, fail if told so; the rate limit that goes with the answer."""
        self.calls.append(ctx)
        self.latency()
        if self.faults:
            status, wait = self.faults.pop(0)
            raise HttpError(f"status {status}", status=status, retry_after_ms=wait)
        if self.limit is None:
            return None
        most, window = self.limit
        return {"limit": most, "remaining": max(0, most - len(self.calls) % (most + 1)), "reset_at": self.clock() + window}

    def fetch(self, ctx: Context) -> Listing:
        """All rows as one page, or nothing new."""
        limit = self._called(ctx)
        at = (ctx.partition, ctx.lane)
        if self.etags and self.seen.get(at) == self.tag:
            return Listing(None, not_modified=True, rate_limit=limit)
        self.seen[at] = self.tag
        return Listing(self.frame(), rate_limit=limit)

    def _order(self, r: dict) -> tuple[int, str]:
        return parse_timestamp(r.get(self.at)) or 0, str(r[self.key])

    def fetch_since(self, ctx: Context) -> Listing:
        """Rows from the cursor's time on, or behind it and its tie, a page in the order of time and key."""
        limit = self._called(ctx)
        rows = sorted(self.rows.values(), key=self._order)
        cursor = ctx.cursor or {}
        if cursor.get("ms") is not None:
            behind = (cursor["ms"], cursor["tie"] if cursor.get("tie") is not None else "")
            rows = [r for r in rows if self._order(r) > behind]
        return Listing(self.frame(rows[: self.size]), has_more=len(rows) > self.size, rate_limit=limit)

    def _slice(self, lo: int, limit: dict | None, cursor: Callable[[int], object]) -> Listing:
        rows = [r for _, r in sorted(self.rows.items())]
        more = lo + self.size < len(rows)
        return Listing(self.frame(rows[lo : lo + self.size]), cursor=cursor(lo + self.size) if more else None, has_more=more, rate_limit=limit)

    def fetch_page(self, ctx: Context) -> Listing:
        limit = self._called(ctx)
        return self._slice(((ctx.cursor or {"value": 1})["value"] - 1) * self.size, limit, lambda _: None)

    def fetch_token(self, ctx: Context) -> Listing:
        limit = self._called(ctx)
        token = (ctx.cursor or {}).get("value")
        return self._slice(int(str(token)[1:]) if token else 0, limit, lambda at: f"o{at}")
