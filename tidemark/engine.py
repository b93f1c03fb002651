"""The control plane: one pass over a feed's keys, the operator commands, and delivery.

A cycle reads page after page until the cursor's strategy says that it is done, or the feed's pages or the pass's time
are used up (``truncated``: the next pass goes on at once). A page is one DataFrame plan: validate, dedup, diff against
the stored snapshot, number the events, commit. What a full listing didn't show is deleted at its end, and only then.
A thread renews the lease while a cycle or a delivery runs. Delivery runs on the driver, because handlers have effects
that a retried task would repeat; it reads the eligible rows of the outbox in order through one iterator a pass and
acknowledges each batch with the commit after it.
"""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.control import schedule
from tidemark.control.budget import Manager
from tidemark.errors import ConfigError, FeedError, LeaseLost, PoisonHalt, is_throttle, serialize_error
from tidemark.functions.canonical import hash_text
from tidemark.functions.lineage import settle
from tidemark.functions.times import iso_ms, timestamp_ms
from tidemark.operators import cursors, diff, dispatch, events, validate
from tidemark.sources.http import Client, send
from tidemark.spec import FeedSpec
from tidemark.state.manifest import SCHEMAS, Lease, ManifestStore
from tidemark.strategies import Strategy, strategy

Handler = Callable[[dict], None]
#: Fixed value: keys that failed and have later rows, at most, before delivery reads the outbox again.
BLOCKED = 200_000


@dataclass
class Context:
    """What ``fetch`` is told, and what it may use."""

    cursor: dict | None
    partition: str
    lane: str
    page: int = 1
    attempt: int = 1
    http: Client | None = None


@dataclass
class Listing:
    """What a fetch may return besides plain rows: rows with a next cursor, or nothing new (a 304).

    ``has_more`` None leaves it to the cursor: a token means more, no token means the end.
    """

    rows: DataFrame | None
    cursor: object = None
    has_more: bool | None = None
    not_modified: bool = False
    rate_limit: dict | None = None
    top: dict | None = None  # the watermark of the rows, for timestamp cursors


def pages_of(got: object) -> Iterator[Listing]:
    """A fetch returns one page or any iterable of pages; a page is a Listing or plain rows."""
    if isinstance(got, (Listing, DataFrame)) or got is None:
        yield got if isinstance(got, Listing) else Listing(got)
        return
    for one in got:
        yield from pages_of(one)


class Keeper:
    """M9: renews a lease every third of its time in a thread of its own, until the block ends; tells if it was lost."""

    def __init__(self, store: ManifestStore, key: tuple[str, str], lease: Lease, ttl_ms: int, clock: Callable[[], int]):
        self.store, self.key, self.lease, self.ttl_ms, self.clock = store, key, lease, ttl_ms, clock
        self.over, self.lost = threading.Event(), False
        self.thread = threading.Thread(target=self._keep, daemon=True)

    def _keep(self) -> None:
        while not self.over.wait(self.ttl_ms / 3000):
            try:
                if not self.renew():
                    return
            except Exception:  # noqa: BLE001  a store that can't be reached now may be by the next beat
                continue

    def renew(self) -> bool:
        self.lost = self.lost or not self.store.renew(self.key, self.lease, self.ttl_ms, self.clock())
        return not self.lost

    def check(self) -> None:
        if not self.renew():
            raise LeaseLost("the lease was lost", key=self.key)

    def __enter__(self) -> Keeper:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        self.thread.join()


@dataclass
class TickResult:
    ran: list[dict] = field(default_factory=list)
    delivered: int = 0
    skipped_leased: int = 0
    skipped_not_due: int = 0


class Engine:
    def __init__(self, spark: SparkSession, store: ManifestStore, feeds: list[FeedSpec], clock: Callable[[], int] | None = None, draw: Callable[[], float] | None = None, lease_ms: int = 30_000, batch: int = 1000, hooks: dict[str, Callable] | None = None, budgets: Manager | None = None, sleep: Callable[[int], None] | None = None, base_url: str = "", send: Callable = send):
        if len({f.name for f in feeds}) < len(feeds):
            raise ConfigError("two feeds have the same name")
        for f in feeds:
            if f.budget and (budgets is None or f.budget not in budgets.queues):
                raise ConfigError(f"{f.name} names the budget {f.budget!r}, which isn't there")
        self.spark, self.store, self.feeds = spark, store, {f.name: f for f in feeds}
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.sleep = sleep or (lambda ms: time.sleep(ms / 1000))
        self.draw = draw or random.random
        self.lease_ms, self.batch, self.hooks = lease_ms, batch, hooks or {}
        self.budgets, self.base_url, self.send = budgets, base_url, send
        self.owner = uuid.uuid4().hex
        self.handlers: dict[str, Handler] = {}
        self.known: dict[str, tuple[int, list[str]]] = {}
        self.status = "idle"
        self.ended = threading.Event()

    def _hook(self, name: str, **what: object) -> None:
        try:
            self.hooks.get(name, lambda **_: None)(**what)
        except Exception:  # noqa: BLE001  a hook never breaks a run
            pass

    def on(self, feed: str, handler: Handler) -> Callable[[], None]:
        self._feed(feed)
        if feed in self.handlers:
            raise ConfigError(f"{feed} has a consumer")
        self.handlers[feed] = handler
        return lambda: self.handlers.pop(feed, None)

    def _feed(self, name: str) -> FeedSpec:
        if name not in self.feeds:
            raise ConfigError(f"there is no feed {name!r}")
        return self.feeds[name]

    def partitions(self, spec: FeedSpec) -> list[str]:
        """The list, asked for again once it is ``partitions_refresh_ms`` old; the last one if it can't be had.

        Keys that vanished are paused, not deleted.
        """
        if spec.partitions is None:
            return [""]
        asked, last = self.known.get(spec.name, (None, []))
        if asked is not None and self.clock() - asked < spec.partitions_refresh_ms:
            return last
        try:
            now = list(spec.partitions())
        except Exception as e:  # noqa: BLE001
            self._hook("on_error", feed=spec.name, phase="partitions", error=serialize_error(e))
            return last
        if len(set(now)) < len(now) or "" in now:
            raise ConfigError("partition keys must differ and not be empty")
        for _, p in self.store.keys(spec.name):
            if p not in now and not (self.store.state((spec.name, p)) or {}).get("paused"):
                self.store.save((spec.name, p), {"paused": True}, self.clock())
        self.known[spec.name] = (self.clock(), now)
        return now

    def tick(self, only: list[str] | None = None, force: bool = False, most_ms: int | None = None) -> TickResult:
        """One pass over all keys that are due; ``most_ms`` bounds when its last page begins."""
        out = TickResult()
        deadline = None if most_ms is None else self.clock() + most_ms
        for spec in self.feeds.values():
            if only is not None and spec.name not in only:
                continue
            for p in self.partitions(spec):
                if self.status == "stopping" or deadline is not None and self.clock() >= deadline:
                    return out
                result = self._run((spec.name, p), spec, force, deadline)
                if result == "leased":
                    out.skipped_leased += 1
                elif result == "not-due":
                    out.skipped_not_due += 1
                else:
                    out.ran.append(result)
                    out.delivered += result["delivered"]
        return out

    def start(self, idle_ms: int = 1000) -> None:
        """Passes until ``stop``; run it in a thread of its own. idle, running, stopping, stopped; it can't start twice."""
        if self.status not in ("idle", "stopped"):
            raise FeedError(f"the engine is {self.status}")
        self.status = "running"
        self.ended.clear()
        try:
            while self.status == "running":
                self.tick()
                self.ended.wait(idle_ms / 1000)
        finally:
            self.status = "stopped"
            self.ended.set()

    def stop(self, most_ms: int | None = None) -> bool:
        """No further page or delivery begins; whether the running pass ended within ``most_ms`` (without it, no wait)."""
        if self.status == "running":
            self.status = "stopping"
        deadline = time.monotonic() + (most_ms or 0) / 1000
        while self.status == "stopping" and time.monotonic() < deadline:
            time.sleep(0.01)
        return self.status != "stopping"

    def _schedule(self, state: dict | None, spec: FeedSpec) -> schedule.State:
        return schedule.State(**state["schedule"]) if state and state.get("schedule") else schedule.initial(self.clock(), spec.schedule)

    def _run(self, key: tuple[str, str], spec: FeedSpec, force: bool, deadline: int | None = None):
        now = self.clock()
        state = self.store.state(key)
        if (state or {}).get("paused"):
            return "not-due"
        lane_due = self._lanes(state, spec, now)
        waiting = bool(state and state.get("waiting"))
        if not (force or lane_due or waiting):
            return "not-due"
        lease = self.store.acquire(key, self.owner, self.lease_ms, now)
        if lease is None:
            return "leased"
        try:
            state = self.store.state(key)
            if (state or {}).get("paused"):  # W8: someone paused it meanwhile
                return "not-due"
            with Keeper(self.store, key, lease, self.lease_ms, self.clock) as keeper:
                delivered = self.drain(key, spec, lease, keeper)
                summaries = []
                for lane in self._lanes(self.store.state(key), spec, now) or (["live"] if force else []):
                    summaries.append(self._cycle(key, spec, lease, lane, keeper, deadline))
                    delivered += self.drain(key, spec, lease, keeper)
            return {"feed": key[0], "partition": key[1], "cycles": summaries, "delivered": delivered}
        except LeaseLost as e:
            self._hook("on_lease_lost", feed=key[0], partition=key[1], error=serialize_error(e))
            return "leased"
        finally:
            self.store.release(key, lease)

    def _lanes(self, state: dict | None, spec: FeedSpec, now: int) -> list[str]:
        """W6, W7."""
        lanes = (state or {}).get("lanes", {})
        out = ["live"] if schedule.is_due(self._schedule(state, spec), now) else []
        every = spec.reconcile_every_ms
        if every and now - lanes.get("reconcile", {}).get("last_run_at", -every) >= every:
            out.append("reconcile")
        if lanes.get("backfill") and not lanes["backfill"].get("done"):
            out.append("backfill")
        return out

    def _charge(self, key: tuple[str, str], spec: FeedSpec, lane: str) -> None:
        """M6: wait for the feed's turn in its budget."""
        if spec.budget:
            waited = self.budgets.acquire(spec.budget, self.clock, self.sleep, who="/".join(key), lane=lane, weight=spec.weight, cost=spec.cost)
            if waited:
                self._hook("on_budget_wait", feed=key[0], partition=key[1], budget=spec.budget, waited_ms=waited)

    def _cycle(self, key: tuple[str, str], spec: FeedSpec, lease: Lease, lane: str, keeper: Keeper, deadline: int | None = None) -> dict:
        now = self.clock()
        state = self.store.state(key)
        plan = schedule.begin_probe(self._schedule(state, spec))
        summary = {"lane": lane, "pages": 0, "items": 0, "invalid": 0, "events": 0, "not_modified": False, "truncated": False}
        try:
            limit = self._pages(key, spec, lease, lane, keeper, deadline, summary, now)
            patch: dict = {}
            if lane == "live":
                done, summary["reason"] = schedule.after_success(plan, spec.schedule, now, self.draw, summary["events"] > 0, summary["not_modified"], summary["truncated"], limit)
                patch["schedule"] = done.as_dict()
            self.store.save(key, patch, now, lease)
            for table in ("items", "outbox", "parked", "log"):
                self.store.compact(key, table, lease)
            self._hook("on_poll", feed=key[0], partition=key[1], duration_ms=self.clock() - now, **summary)
            return summary
        except LeaseLost:
            raise
        except Exception as e:  # noqa: BLE001
            error = serialize_error(e)
            details = getattr(e, "details", {})
            if lane == "live":
                failed, summary["reason"] = schedule.after_failure(plan, spec.schedule, now, self.draw, error, is_throttle(details.get("status"), details.get("retry_after_ms")), details.get("retry_after_ms"))
                self.store.save(key, {"schedule": failed.as_dict()}, now, lease)
                if failed.circuit == "open" and plan.circuit == "closed":
                    self._hook("on_circuit", feed=key[0], partition=key[1], state="open")
            else:
                summary["reason"] = "error"
            self._hook("on_error", feed=key[0], partition=key[1], phase="cycle", error=error)
            return summary | {"error": error}

    def _pages(self, key: tuple[str, str], spec: FeedSpec, lease: Lease, lane: str, keeper: Keeper, deadline: int | None, summary: dict, now: int) -> dict | None:
        """Pages until the strategy is done, each committed with its cursor; the last rate limit that was told.

        What decides about the cycle's end: a 304 ends it without deletes; the feed's pages, the pass's deadline or a stop
        truncate it; deletes follow only a full listing that was read to its end (W14).
        """
        steps = strategy(spec, lane)
        whole = steps.whole
        most = max(steps.most_pages, spec.max_pages) if whole else spec.max_pages
        lane_state = dict(((self.store.state(key) or {}).get("lanes", {})).get(lane, {}))
        cursor = steps.restored(lane_state.get("cursor"))
        fetch = spec.reconcile_fetch if lane == "reconcile" and spec.reconcile_fetch else spec.fetch
        client = Client(self.base_url, self.clock, self.send, validators=dict(self.store.record(key)["validators"]), charge=lambda: self._charge(key, spec, lane)) if self.base_url else None
        known = dict(client.validators) if client else {}
        seen: list[DataFrame] = []
        limit, done = None, False
        while not done:
            if client is None:
                self._charge(key, spec, lane)
            context = Context(steps.for_fetch(cursor, summary["pages"] == 0), key[1], lane, summary["pages"] + 1, http=client)
            for page in pages_of(fetch(context)):
                summary["pages"] += 1
                limit = page.rate_limit or limit
                if page.not_modified or page.rows is None:
                    summary["not_modified"], done = True, True
                else:
                    only = whole and not page.has_more and not seen
                    page, tables, counts, more = self._page(key, spec, lane, steps, cursor, page, lane_state, now, only)
                    cursor, done = steps.advance(cursor, page)
                    if lane == "backfill" and steps.reached(cursor, lane_state.get("until")):
                        done = True
                    if whole and not only:
                        seen.append(settle(more))
                    if lane in ("live", "backfill"):
                        lane_state["cursor"] = steps.stored(steps.ended(cursor, True) if done else cursor)
                    self._commit_page(key, lease, lane, lane_state, now, tables, counts, spec, {k: v for k, v in client.validators.items() if known.get(k) != v} if client else {})
                    summary["items"] += counts["items"]
                    summary["events"] += counts["events"]
                    summary["invalid"] += counts["invalid"]
                keeper.check()
                if done:
                    break
            if not done and (summary["pages"] >= most or deadline is not None and self.clock() >= deadline or self.status == "stopping"):
                summary["truncated"] = True
                break
        if seen and done and not summary["not_modified"]:
            summary["events"] += self._deletes(key, spec, lease, lane, lane_state, seen, now)
        lane_state |= {"last_run_at": now}
        if lane == "backfill":
            lane_state["done"] = done
        lanes = dict((self.store.state(key) or {}).get("lanes", {}))
        self.store.save(key, {"lanes": lanes | {lane: lane_state}}, now, lease)
        return limit

    def _commit_page(self, key: tuple[str, str], lease: Lease, lane: str, lane_state: dict, now: int, tables: dict, counts: dict, spec: FeedSpec, validators: dict) -> None:
        state = self.store.state(key) or {}
        lanes = dict(state.get("lanes", {})) | {lane: dict(lane_state)}
        patch = {"lanes": lanes, "sequence": state.get("sequence", 0) + counts["events"], "schema_version": spec.schema_version, "waiting": bool(state.get("waiting")) or counts["events"] > 0}
        self.store.commit(key, lease, patch, now, **tables, validators=validators)

    def _page(self, key: tuple[str, str], spec: FeedSpec, lane: str, steps: Strategy, cursor: dict | None, page: Listing, lane_state: dict, now: int, complete: bool):
        """The page with its watermark, what to commit, its counts, and the identities it shows."""
        rows = page.rows
        position = "_position" if "_position" in rows.columns else None
        if position is None:
            rows, position = rows.withColumn("_position", F.monotonically_increasing_id()), "_position"
        if spec.cursor == "timestamp" and not steps.whole:
            rows, top = self._window(spec, rows, steps.for_fetch(cursor, True), lane_state, lane, now)
            page = replace(page, top=top)
        good, bad = validate.split(rows, spec.checks, spec.invalid) if spec.checks else (rows, None)
        plain = () if spec.fingerprint else ("hash",)  # without a fingerprint it is the data's, made again behind the exchange
        found = diff.last_wins(spec.candidates(good, position).drop(*plain), "identity", "_pos").drop("_pos")
        found = found.withColumns({c: hash_text(F.col("data")) for c in plain})
        force = lane == "backfill" and lane_state.get("force")
        found = settle(found) if force else found
        stored = self.store.read(key, "items")
        told = lambda c: c if c in ("identity", "type") else F.when(F.col("type") != "unchanged", F.col(c)).alias(c)
        every = diff.snapshot_diff(stored, found, spec.schema_version, spec.on_schema_change, deletes=complete)
        changed = settle(every.select(*map(told, every.columns)))
        tally = {r["type"]: r["count"] for r in changed.groupBy("type").count().collect()}
        picked = diff.changes(changed)
        if force:
            again = diff.forced(found, stored, picked).select("identity", F.lit("updated").alias("type"), "version", "hash", "data", F.lit(None).cast("string").alias("previous"))
            picked = picked.unionByName(again)
        some = force or not tally.keys() <= {"unchanged", "rebaselined"}
        tables, n = self._events(key, spec, lane, lane_state, picked, now) if some else ({"upserts": {}, "deletes": {}}, 0)
        if n or not tally.keys() <= {"unchanged", "deleted"}:
            kept = changed.where(F.col("type").isin("created", "updated", "rebaselined"))
            tables["upserts"]["items"] = diff.item_rows(kept, spec.schema_version, F.lit(now), spec.retain)
        invalid = bad.count() if bad is not None else 0
        if invalid:
            tables["upserts"]["parked"] = validate.parked_rows(bad, F.to_json(F.struct(*(c for c in rows.columns if c != "_position"))), F.lit(now))
        if complete and n:
            tables["deletes"]["items"] = changed.where("type = 'deleted'").select("identity")
        items = sum(tally.values()) - tally.get("deleted", 0)
        return page, tables, {"items": items, "events": n, "invalid": invalid}, changed.where("type <> 'deleted'").select("identity")

    def _events(self, key: tuple[str, str], spec: FeedSpec, lane: str, lane_state: dict, picked: DataFrame, now: int) -> tuple[dict, int]:
        """Rows are settled once, when they are numbered; the envelope is made from them as it is written."""
        base = (self.store.state(key) or {}).get("sequence", 0)
        if spec.retain == "hash":
            gone = F.col("type") == "deleted"
            picked = picked.withColumn("previous", F.lit(None).cast("string")).withColumn("data", F.when(~gone, F.col("data")))
        ordered, n = events.ranged(picked, base, F.col("type") == "deleted", diff.code_unit_order(F.col("identity")))
        made = events.enveloped(ordered, spec.name, F.lit(key[1]), spec.urn, spec.schema_version, lane, F.lit(now), F.lit(json.dumps(lane_state.get("cursor"))))
        rows = events.outbox_rows(made, F.lit(now), spec.delivery.ordering_key)
        return {"upserts": {"outbox": rows, "log": rows.select("sequence", "event", "created_at")} if n else {}, "deletes": {}}, n

    def _deletes(self, key: tuple[str, str], spec: FeedSpec, lease: Lease, lane: str, lane_state: dict, seen: list[DataFrame], now: int) -> int:
        """What none of a full listing's pages showed."""
        shown = reduce(DataFrame.unionByName, seen)
        gone = diff.deletes(self.store.read(key, "items"), shown)
        version = F.coalesce("version", "hash")
        picked = settle(gone.select("identity", F.lit("deleted").alias("type"), version.alias("version"), "hash", F.col("payload").alias("data"), F.col("payload").alias("previous")))
        tables, n = self._events(key, spec, lane, lane_state, picked, now)
        if n:
            tables["deletes"]["items"] = picked.select("identity")
            self._commit_page(key, lease, lane, lane_state, now, tables, {"events": n}, spec, {})
        return n

    def _window(self, spec: FeedSpec, rows: DataFrame, cursor: dict | None, lane: dict, name: str, now: int) -> tuple[DataFrame, dict]:
        """The part of the page that the cursor hasn't seen, and the page's watermark."""
        raw = F.col(spec.cursor_field).cast("string")
        tie = spec.cursor_tie
        rows = rows.withColumn("_ms", timestamp_ms(raw))
        if cursor and cursor.get("ms") is not None:
            after = F.lit(cursor["tie"]) if tie and cursor.get("tie") is not None else None
            unseen = cursors.keyset(rows.withColumn("_tie", F.col(tie).cast("string") if tie else F.lit("")), "_ms", "_tie", F.lit(cursor["ms"]), after)
            rows = unseen.drop("_tie").unionByName(rows.where("_ms IS NULL"))
        if name == "backfill":
            inside = cursors.between(rows, "_ms", F.lit(lane["from"]) if lane.get("from") is not None else None, F.lit(lane["target"]) if lane.get("target") is not None else None)
            rows = inside.unionByName(rows.where("_ms IS NULL")) if lane.get("from") is not None or lane.get("target") is not None else inside
        rows = cursors.fresh_enough(rows, F.col("_ms"), now, spec.lag_ms)
        fields = rows.withColumn("_raw", F.col(spec.cursor_field).cast("string")).withColumn("_t", F.col(tie).cast("string") if tie else F.lit(None).cast("string"))
        top = cursors.watermark(fields, "_raw", F.col("_ms"), "_t", "_position").first()
        return rows.drop("_ms"), top.asDict()

    # delivery

    def _waiting(self, key: tuple[str, str], now: int) -> DataFrame:
        """What can be delivered, in order; ``_more`` tells whether its key has a later row."""
        outbox = self.store.read(key, "outbox").withColumn("order_key", F.coalesce("order_key", "subject"))
        free = dispatch.eligible(outbox, self.store.read(key, "parked"), F.lit(now), "order_key")
        return dispatch.followed(free, "order_key").orderBy("sequence")

    def drain(self, key: tuple[str, str], spec: FeedSpec, lease: Lease, keeper: Keeper | None = None) -> int:
        """One at a time per key, in order; a failed event blocks its key, and is parked once attempts are used up.

        The outbox is read and sorted once a pass, however many batches the pass commits. A pass over what the one before
        left follows until nothing can be delivered. Where a retry is due, a pass ends early if it did as much as all
        before it, so that few passes are made however many retries there are.

        M12: with ``halt`` the poison event is parked too, the circuit opens and delivery ends until the probe; what was
        delivered before it is acknowledged with the same commit.
        """
        handler = self.handlers.get(key[0])
        state = self.store.state(key) or {}
        if handler is None or not state.get("waiting") or self._halted(state):
            return 0
        delivered = handled = 0
        while True:
            now = self.clock()
            done, tried, parked, blocked, due = [], [], [], set(), None
            patch: dict = {}
            before, stopped = handled, False

            def flush() -> None:
                nonlocal delivered, handled, done, tried, parked
                if not done and not tried:
                    return
                frame = lambda rows, schema: self.spark.createDataFrame(rows, schema).coalesce(1)
                upserts = {t: frame(r, SCHEMAS[t]) for t, r in (("outbox", tried), ("parked", parked)) if r}
                deletes = {"outbox": frame(done, "event_id string")} if done else {}
                self.store.commit(key, lease, patch, now, upserts, deletes)
                sent = len(done) - len(parked)
                delivered += sent
                handled += len(done) + len(tried)
                if sent:
                    self._hook("on_delivered", feed=key[0], partition=key[1], events=sent, duration_ms=self.clock() - now)
                done, tried, parked = [], [], []

            for row in self._waiting(key, now).toLocalIterator():
                if row["order_key"] in blocked:
                    if not row["_more"]:
                        blocked.discard(row["order_key"])
                    continue
                if self.status == "stopping" or keeper is not None and keeper.lost:
                    stopped = True
                    break
                attempts = row["attempts"] + 1
                try:
                    handler(json.loads(row["event"]) | {"attempt": attempts})
                    done.append((row["event_id"],))
                except Exception as e:  # noqa: BLE001
                    if row["_more"]:
                        blocked.add(row["order_key"])
                    error = serialize_error(e)
                    if attempts < spec.delivery.attempts:
                        wait = schedule.backoff_delay(attempts, spec.delivery.backoff, self.draw)
                        tried.append((row["event_id"], row["subject"], row["sequence"], row["event"], "pending", attempts, now + wait, json.dumps(error), row["created_at"], row["order_key"]))
                        due = now + wait if due is None else min(due, now + wait)
                        self._hook("on_retry", feed=key[0], partition=key[1], event_id=row["event_id"], attempt=attempts)
                    else:
                        done.append((row["event_id"],))
                        parked.append((row["event_id"], "poison", row["event"], None, json.dumps(error), attempts, now, row["order_key"] if spec.delivery.hold else None, row["sequence"]))
                        self._hook("on_parked", feed=key[0], partition=key[1], event_id=row["event_id"], error=error)
                        if spec.delivery.on_poison == "halt":
                            plan = schedule.halted(self._schedule(self.store.state(key), spec), spec.schedule, now, serialize_error(PoisonHalt(str(e))))
                            patch["schedule"] = plan.as_dict()
                            self._hook("on_circuit", feed=key[0], partition=key[1], state="open")
                            break
                if len(done) + len(tried) >= self.batch:
                    flush()
                    now = self.clock()
                    if len(blocked) > BLOCKED or due is not None and due <= now and handled >= 2 * before:
                        break
            flush()
            if patch:
                return delivered
            left = not dispatch.pending(self.store.read(key, "outbox", ["status"])).isEmpty()
            if stopped or handled == before or not left:
                self.store.save(key, {"waiting": left}, self.clock(), lease)
                return delivered

    @staticmethod
    def _halted(state: dict) -> bool:
        plan = state.get("schedule") or {}
        return plan.get("circuit") == "open" and (plan.get("last_error") or {}).get("name") == "PoisonHalt"

    def subscribe(self, feed: str, partition: str = "") -> Iterator[dict]:
        """Events in order, also those that come while it is read; each is acknowledged when the next is asked for, or
        when the loop ends normally. The lease is kept meanwhile; a loop that throws leaves its event unacknowledged."""
        self._feed(feed)
        key = (feed, partition)
        lease = self.store.acquire(key, self.owner, self.lease_ms, self.clock())
        if lease is None:
            return
        acknowledge = lambda row: self.store.commit(key, lease, {}, self.clock(), deletes={"outbox": self.spark.createDataFrame([(row["event_id"],)], "event_id string")})
        try:
            with Keeper(self.store, key, lease, self.lease_ms, self.clock) as keeper:
                found = True
                while found:
                    found = False
                    for row in self._waiting(key, self.clock()).toLocalIterator():
                        found = True
                        keeper.check()
                        yield json.loads(row["event"]) | {"attempt": row["attempts"] + 1}
                        acknowledge(row)
        finally:
            self.store.release(key, lease)

    # operations

    def trigger(self, feed: str, partition: str = "") -> None:
        spec, key = self._feed(feed), (feed, partition)
        plan = schedule.make_due(self._schedule(self.store.state(key), spec), self.clock())
        self.store.save(key, {"schedule": plan.as_dict()}, self.clock())

    def pause(self, feed: str, partition: str = "") -> None:
        self._feed(feed)
        self.store.save((feed, partition), {"paused": True}, self.clock())

    def resume(self, feed: str, partition: str = "") -> None:
        self._feed(feed)
        self.store.save((feed, partition), {"paused": False}, self.clock())
        self.trigger(feed, partition)

    def backfill(self, feed: str, start_ms: int | None, to_ms: int | None = None, partition: str = "", force: bool = False) -> None:
        """A lane of its own from start to target, by default the live cursor."""
        self._feed(feed)
        lanes = dict((self.store.state((feed, partition)) or {}).get("lanes", {}))
        live = lanes.get("live", {}).get("cursor")
        target = to_ms if to_ms is not None else live.get("ms") if isinstance(live, dict) else None
        lanes["backfill"] = {"from": start_ms, "target": target, "until": None if target is None else {"ms": target}, "done": False, "force": force}
        self.store.save((feed, partition), {"lanes": lanes}, self.clock())

    def replay(self, feed: str, partition: str = "", from_ms: int | None = None, to_ms: int | None = None, after: int = 0) -> int:
        """Logged events go to the outbox again, with their ids and new sequences."""
        spec, key, now = self._feed(feed), (feed, partition), self.clock()
        lease = self.store.acquire(key, self.owner, self.lease_ms, now)
        if lease is None:
            raise FeedError("the feed is busy")
        try:
            base = (self.store.state(key) or {}).get("sequence", 0)
            old = cursors.between(self.store.read(key, "log").where(F.col("sequence") > after), "created_at", F.lit(from_ms) if from_ms is not None else None, F.lit(to_ms) if to_ms is not None else None)
            field_of = lambda k: F.get_json_object("event", f"$.{k}")
            new = events.numbered_by_range(old.drop("created_at").withColumnRenamed("sequence", "_old"), base, "_old")
            names = ["id", "type", "source", "subject", "time", "poller", "partition", "cursor", "data", "previous"]
            again = new.select(*(field_of(k).alias(k) for k in names), F.lit("replay").alias("lane"), F.col("sequence"), F.lit(0).alias("attempt"))
            rows = settle(events.outbox_rows(again, F.lit(now), spec.delivery.ordering_key))
            n = rows.count()
            if n:
                self.store.commit(key, lease, {"sequence": base + n, "waiting": True}, now, {"outbox": rows})
            return n
        finally:
            self.store.release(key, lease)

    def reset_cursor(self, feed: str, partition: str = "", to: dict | None = None, clear_snapshot: bool = False) -> None:
        key, spec = (feed, partition), self._feed(feed)
        try:
            steps = strategy(spec)
            to = None if to is None else steps.stored(steps.checked(to))
        except TypeError as e:
            raise ConfigError(str(e)) from e
        lanes = dict((self.store.state(key) or {}).get("lanes", {}))
        lanes["live"] = lanes.get("live", {}) | {"cursor": to}
        self.store.save(key, {"lanes": lanes}, self.clock())
        if clear_snapshot:
            self.store.clear(key, "items")
        self.trigger(feed, partition)

    def parked(self, feed: str, partition: str = "", kind: str | None = None, limit: int | None = None) -> DataFrame:
        """W15."""
        rows = self.store.read((feed, partition), "parked")
        rows = (rows.where(F.col("kind") == kind) if kind else rows).orderBy("parked_at", "id")
        return rows if limit is None else rows.limit(limit)

    def remove_partition(self, feed: str, partition: str) -> None:
        """Forget a partition with its state; one that is listed still begins anew."""
        self._feed(feed)
        self.store.delete((feed, partition))

    def retry_parked(self, feed: str, ids: list[str], partition: str = "") -> int:
        """Poison rows go back with attempts 0 and their sequence; invalid ones stay."""
        key, now = (feed, partition), self.clock()
        rows = self.store.read(key, "parked").where(F.col("id").isin(ids) & (F.col("kind") == "poison")).cache()
        n = rows.count()
        if n:
            back = rows.select(F.col("id").alias("event_id"), F.get_json_object("event", "$.subject").alias("subject"), "sequence", "event", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(now).alias("created_at"), F.coalesce("hold_key", F.get_json_object("event", "$.subject")).alias("order_key"))
            self.store.commit(key, None, {"waiting": True}, now, {"outbox": back}, {"parked": rows})
        return n

    def discard_parked(self, feed: str, ids: list[str], partition: str = "") -> int:
        key = (feed, partition)
        rows = self.store.read(key, "parked").where(F.col("id").isin(ids)).cache()
        n = rows.count()
        if n:
            self.store.commit(key, None, {}, self.clock(), deletes={"parked": rows})
        return n

    def inspect(self) -> list[dict]:
        """Of each key its state and counts."""
        out = []
        for feed, p in self.store.keys():
            r = self.store.record((feed, p))
            s = r["state"] or {}
            cursor = (s.get("lanes", {}).get("live", {}) or {}).get("cursor")
            lag = strategy(self.feeds[feed]).lag_ms(cursor, self.clock()) if feed in self.feeds and isinstance(cursor, dict) else None
            plan = s.get("schedule") or {}
            counts = {t: self.store.read((feed, p), t).count() for t in ("items", "outbox", "parked")}
            out.append({"feed": feed, "partition": p, "paused": s.get("paused", False), "circuit": plan.get("circuit", "closed"), "sequence": s.get("sequence", 0), "cursor": cursor, "lag_ms": lag, "next_due": iso_ms(plan["next_due_at"]) if plan.get("next_due_at") is not None else None, "leased": bool(r["lease"]), **counts})
        return out
