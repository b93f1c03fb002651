"""Cursor strategies: where a scan begins, what a fetch is told, how a page moves the cursor, when it ends.

A cursor is a small JSON object or None. ``advance`` gets the page that was read and says whether the cycle is done.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from tidemark.errors import ConfigError
from tidemark.functions.times import format_timestamp

Cursor = dict | None
#: Pages of a cycle at most, for scans from a cursor and for full ones.
PAGES, FULL_PAGES = 50, 10_000


class Strategy:
    """What all strategies have in common; a full scan has no cursor."""

    whole = False
    most_pages = PAGES
    #: Members of a cursor and their types.
    members: dict[str, tuple[type, ...]] = {}

    def initial(self) -> Cursor:
        return None

    def dump(self, cursor: Cursor) -> str:
        return json.dumps(cursor, sort_keys=True)

    def parse(self, text: str | None) -> Cursor:
        """the cursor that was written; TypeError for anything else."""
        if text is None:
            return self.initial()
        try:
            found = json.loads(text)
        except ValueError:
            raise TypeError(f"{text!r} is not a cursor") from None
        return self.checked(found)

    def checked(self, found: object) -> Cursor:
        if found is None:
            return self.initial()
        if not isinstance(found, dict) or any(isinstance(found.get(k), bool) or not isinstance(found.get(k), types) for k, types in self.members.items()):
            raise TypeError(f"{found!r} is not a cursor of this kind")
        return found

    def stored(self, cursor: Cursor) -> object:
        """The cursor as the state has it, and ``restored`` from there."""
        return cursor

    def restored(self, found: object) -> Cursor:
        return self.checked(found)

    def for_fetch(self, cursor: Cursor, first: bool) -> Cursor:
        return cursor

    def advance(self, cursor: Cursor, page: Any) -> tuple[Cursor, bool]:
        return cursor, not page.has_more

    def ended(self, cursor: Cursor, done: bool) -> Cursor:
        """What is stored once the cycle is over."""
        return cursor

    def lag_ms(self, cursor: Cursor, now: int) -> int | None:
        return None

    def reached(self, cursor: Cursor, target: Cursor) -> bool:
        return cursor is not None and cursor == target


@dataclass
class Snapshot(Strategy):
    whole = True
    most_pages = FULL_PAGES

    def advance(self, cursor: Cursor, page: Any) -> tuple[Cursor, bool]:
        """Pages of a full scan are numbered or follow a token, whichever the source gives."""
        if not page.has_more:
            return None, True
        return {"value": page.cursor if page.cursor is not None else (cursor or {}).get("value", 1) + 1}, False

    def stored(self, cursor: Cursor) -> object:
        """A full listing always begins anew, also after one that broke off."""
        return None

    def restored(self, found: object) -> Cursor:
        return None

    def reached(self, cursor: Cursor, target: Cursor) -> bool:
        return True


@dataclass
class Timestamp(Strategy):
    """The cursor has the largest time as written, the same in milliseconds, and the largest tie; it never goes back."""

    overlap_ms: int = 0
    members = {"value": (str, type(None)), "ms": (int, type(None)), "tie": (str, type(None))}

    def for_fetch(self, cursor: Cursor, first: bool) -> Cursor:
        if not (first and self.overlap_ms and cursor and cursor.get("ms") is not None):
            return cursor
        ms = cursor["ms"] - self.overlap_ms
        return {"value": format_timestamp(ms, cursor["value"]), "ms": ms, "tie": None}

    def advance(self, cursor: Cursor, page: Any) -> tuple[Cursor, bool]:
        top = page.top or {}
        at, before = top.get("ms"), (cursor or {}).get("ms")
        if at is None or before is not None and at < before:
            return cursor, not page.has_more
        ties = [t for t in (top.get("tie"), cursor["tie"] if cursor and at == before else None) if t is not None]
        value = cursor["value"] if cursor and at == before else top["value"]
        return {"value": value, "ms": at, "tie": max(ties, default=None, key=lambda t: t.encode("utf-16-be"))}, not page.has_more

    def lag_ms(self, cursor: Cursor, now: int) -> int | None:
        return now - cursor["ms"] if cursor and cursor.get("ms") is not None else None

    def reached(self, cursor: Cursor, target: Cursor) -> bool:
        if target is None or target.get("ms") is None:
            return True
        return cursor is not None and cursor.get("ms") is not None and cursor["ms"] >= target["ms"]


@dataclass
class Token(Strategy):
    start: str | None = None
    members = {"value": (str, int, type(None))}

    def initial(self) -> Cursor:
        return None if self.start is None else {"value": self.start}

    def advance(self, cursor: Cursor, page: Any) -> tuple[Cursor, bool]:
        """No token: the listing is over and the next cycle begins anew. A token without more pages is kept for the next cycle."""
        if page.cursor in (None, ""):
            return self.initial(), True
        return {"value": page.cursor}, page.has_more is False


@dataclass
class Page(Strategy):
    start: int = 1
    members = {"value": (int,)}

    def initial(self) -> Cursor:
        return {"value": self.start}

    def advance(self, cursor: Cursor, page: Any) -> tuple[Cursor, bool]:
        return ({"value": cursor["value"] + 1}, False) if page.has_more else (self.initial(), True)


@dataclass
class Custom(Strategy):
    """``step(cursor, page)`` returns a mapping with ``cursor`` and a boolean ``done``."""

    step: Callable[[Any, Any], dict] | None = None
    first: Any = None
    write: Callable[[Any], str] = json.dumps
    read: Callable[[str], Any] = json.loads

    def initial(self) -> Any:
        return self.first

    def dump(self, cursor: Any) -> str:
        return self.write(cursor)

    def parse(self, text: str | None) -> Any:
        return self.first if text is None else self.read(text)

    def checked(self, found: object) -> Any:
        return self.first if found is None else found

    def stored(self, cursor: Any) -> str:
        return self.write(cursor)

    def restored(self, found: object) -> Any:
        return self.parse(found)

    def advance(self, cursor: Any, page: Any) -> tuple[Any, bool]:
        got = self.step(cursor, page)
        if not isinstance(got, dict) or "cursor" not in got or not isinstance(got.get("done"), bool):
            raise ConfigError("a custom cursor's step must return a cursor and whether it is done")
        return got["cursor"], got["done"]


#: Strategies by the name that a feed gives.
KINDS: dict[str, Callable[[Any], Strategy]] = {
    "snapshot": lambda spec: Snapshot(),
    "timestamp": lambda spec: Timestamp(spec.overlap_ms),
    "token": lambda spec: Token(spec.cursor_start),
    "page": lambda spec: Page(1 if spec.cursor_start is None else int(spec.cursor_start)),
    "custom": lambda spec: spec.custom,
}


def strategy(spec: Any, lane: str = "live") -> Strategy:
    """Of a feed's lane; a reconcile lane always lists everything."""
    if lane == "reconcile":
        return Snapshot()
    if spec.cursor not in KINDS:
        raise ConfigError(f"there is no cursor {spec.cursor!r}; there are {', '.join(KINDS)}")
    made = KINDS[spec.cursor](spec)
    if not isinstance(made, Strategy):
        raise ConfigError("a custom cursor needs a strategy")
    return made
