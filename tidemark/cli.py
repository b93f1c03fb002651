"""Operator commands. Exit codes: 0 done, 1 failed, 2 not understood (API)."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from tidemark.engine import Engine
from tidemark.errors import FeedError, serialize_error

VERBS = ("tick", "inspect", "trigger", "pause", "resume", "backfill", "replay", "reset-cursor", "parked", "retry", "discard")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidemark", exit_on_error=False)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("feed", nargs="?")
    p.add_argument("ids", nargs="*")
    p.add_argument("--partition", default="")
    p.add_argument("--from-ms", type=int)
    p.add_argument("--to-ms", type=int)
    p.add_argument("--force", action="store_true")
    p.add_argument("--clear-snapshot", action="store_true")
    return p


def run(argv: list[str], engine: Engine, write: Callable[[str], None] = print) -> int:
    try:
        a = parser().parse_args(argv)
    except (argparse.ArgumentError, SystemExit):
        return 2
    if a.verb not in ("tick", "inspect") and not a.feed:
        return 2
    try:
        if a.verb == "tick":
            out: object = vars(engine.tick([a.feed] if a.feed else None, a.force))
        elif a.verb == "inspect":
            out = engine.inspect()
        elif a.verb == "backfill":
            out = engine.backfill(a.feed, a.from_ms, a.to_ms, a.partition, a.force)
        elif a.verb == "replay":
            out = {"replayed": engine.replay(a.feed, a.partition, a.from_ms, a.to_ms)}
        elif a.verb == "reset-cursor":
            out = engine.reset_cursor(a.feed, a.partition, clear_snapshot=a.clear_snapshot)
        elif a.verb == "parked":
            out = [r.asDict() for r in engine.parked(a.feed, a.partition).toLocalIterator()]
        elif a.verb in ("retry", "discard"):
            out = {"rows": getattr(engine, f"{a.verb}_parked")(a.feed, a.ids, a.partition)}
        else:
            out = getattr(engine, a.verb)(a.feed, a.partition)
        write(json.dumps(out))
        return 0
    except FeedError as e:
        write(json.dumps(serialize_error(e)))
        return 1
