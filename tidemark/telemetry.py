"""Counters, histograms and spans of an engine, fed by its hooks (A11, A12, API).

``Telemetry().hooks`` goes to ``Engine(hooks=...)``; ``counters`` and ``durations`` are DataFrames for the queries of
``operators.metrics``. A span is what a poll or a delivery was, with its times; an exporter can take it from ``on_span``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The counters.
COUNTERS = ("items.fetched", "items.invalid", "events.emitted", "events.delivered", "events.retried", "events.parked", "errors", "lease.lost", "circuit.opened", "budget.waits")


class Telemetry:
    def __init__(self, on_span: Callable[[dict], None] | None = None, kept: int = 10_000):
        self.counts: Counter[tuple[str, str, str]] = Counter()
        self.times: list[tuple[str, str, float]] = []
        self.spans: list[dict] = []
        self.on_span, self.kept = on_span, kept

    def _add(self, name: str, what: dict, n: int = 1) -> None:
        self.counts[(name, what.get("feed", ""), what.get("partition", ""))] += n

    def _took(self, name: str, feed: str, ms: int) -> None:
        self.times = [*self.times[1 - self.kept :], (name, feed, ms / 1000)]

    def _span(self, name: str, what: dict) -> None:
        span = {"name": name} | what
        self.spans = [*self.spans[1 - self.kept :], span]
        if self.on_span:
            self.on_span(span)

    def _poll(self, **what: Any) -> None:
        self._add("items.fetched", what, what["items"])
        self._add("items.invalid", what, what.get("invalid", 0))
        self._add("events.emitted", what, what["events"])
        self._took("poll.duration", what["feed"], what["duration_ms"])
        self._span("poll", what)

    def _waited(self, **what: Any) -> None:
        self._add("budget.waits", what)
        self._took("budget.wait", what["feed"], what["waited_ms"])

    def _delivered(self, **what: Any) -> None:
        self._add("events.delivered", what, what["events"])
        self._took("deliver.duration", what["feed"], what["duration_ms"])
        self._span("deliver", what)

    @property
    def hooks(self) -> dict[str, Callable[..., None]]:
        one = lambda name: lambda **what: self._add(name, what)
        return {"on_poll": self._poll, "on_budget_wait": self._waited, "on_delivered": self._delivered, "on_retry": one("events.retried"), "on_parked": one("events.parked"), "on_error": one("errors"), "on_lease_lost": one("lease.lost"), "on_circuit": one("circuit.opened")}

    def total(self, name: str) -> int:
        return sum(n for (k, _, _), n in self.counts.items() if k == name)

    def counters(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*k, n) for k, n in sorted(self.counts.items())], "name string, feed string, partition string, value long")

    def durations(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.times, "name string, feed string, seconds double")


def composed(*hooks: dict[str, Callable[..., None]]) -> dict[str, Callable[..., None]]:
    """Several sets of hooks as one; each is called, whatever the others do."""

    def every(name: str) -> Callable[..., None]:
        def call(**what: Any) -> None:
            for h in hooks:
                try:
                    h.get(name, lambda **_: None)(**what)
                except Exception:  # noqa: BLE001  a hook never breaks a run
                    continue

        return call

    return {name: every(name) for h in hooks for name in h}
