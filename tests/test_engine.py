"""Feeds end to end on a fake source: diffs, ids, retries, parking, replay, fences, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.control import schedule
from tidemark.control.budget import Buckets, Manager, Policy
from tidemark.engine import Engine
from tidemark.errors import BudgetTimeout, ConfigError, LeaseLost
from tidemark.sinks.webhook import webhook
from tidemark.sources.fake import Draws, FakeSource
from tidemark.spec import Delivery, FeedSpec, Schedule
from tidemark.state.manifest import ManifestStore
from tidemark.streaming.feed import follow

T0 = 1_767_225_600_000


class Clock:
    def __init__(self):
        self.now = T0

    def __call__(self):
        return self.now


def world(spark, tmp_path, **more):
    clock = Clock()
    source = FakeSource(spark, "id string, status string, total double, updated string")
    source.put(*({"id": f"o{i}", "status": "open", "total": 10.0, "updated": "2026-01-01T00:00:00Z"} for i in range(4)))
    spec = FeedSpec("orders", source.fetch, "id", **({"retain": "payload", "schedule": Schedule(min_ms=10_000, jitter=0.0)} | more))
    store = ManifestStore(spark, str(tmp_path / "state"))
    engine = Engine(spark, store, [spec], clock, Draws(1))
    return clock, source, spec, store, engine


def test_snapshot_lifecycle(spark, tmp_path):
    clock, source, _, store, engine = world(spark, tmp_path)
    got = []
    engine.on("orders", got.append)
    engine.tick()
    assert [(e["type"], e["subject"], e["sequence"]) for e in got] == [("created", f"o{i}", i + 1) for i in range(4)]
    assert engine.tick().skipped_not_due == 1
    source.remove("o1")
    source.put({"id": "o2", "status": "paid"}, {"id": "o9", "status": "open", "total": 1.5, "updated": "2026-01-02"})
    clock.now += 60_000
    got.clear()
    engine.tick()
    assert sorted((e["type"], e["subject"]) for e in got) == [("created", "o9"), ("deleted", "o1"), ("updated", "o2")]
    changed = next(e for e in got if e["type"] == "updated")
    assert json.loads(changed["previous"])["status"] == "open" and json.loads(changed["data"])["status"] == "paid"
    report = engine.inspect()[0]
    assert (report["items"], report["outbox"], report["sequence"]) == (4, 0, 7)
    assert engine.replay("orders") == 7
    got.clear()
    engine.tick()
    assert len(got) == 7 and {e["lane"] for e in got} == {"replay"} and min(e["sequence"] for e in got) == 8


def test_failed_handler_blocks_its_key_and_parks(spark, tmp_path):
    clock, source, _, _, engine = world(spark, tmp_path, delivery=Delivery(attempts=2))
    got, bad = [], {"o1"}

    def handler(e):
        if e["subject"] in bad:
            raise RuntimeError("no")
        got.append(e["subject"])

    engine.on("orders", handler)
    engine.tick()
    assert got == ["o0", "o2", "o3"]
    clock.now += 60_000
    source.put({"id": "o1", "status": "paid"})
    engine.tick()
    parked = engine.parked("orders").collect()
    assert [(r["kind"], r["attempts"], r["hold_key"]) for r in parked] == [("poison", 2, "o1")]
    assert "o1" not in got
    bad.clear()
    assert engine.retry_parked("orders", [parked[0]["id"]]) == 1
    clock.now += 60_000
    engine.tick()
    assert got[-2:] == ["o1", "o1"]


def test_throttle_backoff_and_circuit(spark, tmp_path):
    clock, source, _, store, engine = world(spark, tmp_path, schedule=Schedule(min_ms=10_000, jitter=0.0, circuit_failures=2, probe_every_ms=60_000))
    source.fail_next(429, 20_000)
    engine.tick()
    plan = store.state(("orders", ""))["schedule"]
    assert (plan["failures"], plan["throttled_until"]) == (0, T0 + 20_000)
    source.fail_next(500, times=2)
    for _ in range(2):
        clock.now += 700_000
        engine.tick()
    assert store.state(("orders", ""))["schedule"]["circuit"] == "open"
    clock.now += 60_000
    engine.tick()
    assert store.state(("orders", ""))["schedule"]["circuit"] == "closed"


def test_timestamp_cursor_keeps_ties_and_late_rows(spark, tmp_path):
    clock, source, _, store, engine = world(spark, tmp_path, cursor="timestamp", cursor_field="updated", cursor_tie="id")
    got = []
    engine.on("orders", got.append)
    engine.tick()
    assert len(got) == 4 and store.state(("orders", ""))["lanes"]["live"]["cursor"]["tie"] == "o3"
    source.put({"id": "o4", "status": "open", "total": 1.0, "updated": "2026-01-01T00:00:00Z"}, {"id": "o5", "status": "x", "total": 1.0, "updated": None})
    clock.now += 60_000
    engine.tick()
    assert [e["subject"] for e in got[4:]] == ["o4", "o5"]
    engine.backfill("orders", None, force=True)
    engine.tick()
    assert {e["lane"] for e in got[6:]} == {"backfill"} and len(got) == 12


def test_quarantine_etags_partitions_and_pause(spark, tmp_path):
    checks = {"must be positive": ("total", F.col("total") > 0)}
    keys = ["a", "b"]
    clock, source, _, store, engine = world(spark, tmp_path, checks=checks, partitions=lambda: keys, partitions_refresh_ms=60_000)
    source.etags = True
    source.put({"id": "bad", "status": "open", "total": -1.0})
    engine.tick()
    assert {k for k in store.keys()} == {("orders", "a"), ("orders", "b")}
    assert [r["kind"] for r in engine.parked("orders", "a").collect()] == ["invalid"]
    clock.now += 60_000
    assert engine.tick().ran[0]["cycles"][0]["not_modified"]
    keys.remove("b")
    clock.now += 200_000
    engine.tick()
    assert store.state(("orders", "b"))["paused"]
    engine.pause("orders", "a")
    clock.now += 600_000
    assert engine.tick().ran == []
    engine.resume("orders", "a")
    assert len(engine.tick().ran) == 1


def test_leases_and_fences(spark, tmp_path):
    store, key = ManifestStore(spark, str(tmp_path)), ("f", "p/1")
    a = store.acquire(key, "a", 1000, 0)
    assert a.epoch == 1 and store.acquire(key, "b", 1000, 500) is None
    b = store.acquire(key, "b", 1000, 1000)
    assert b.epoch == 2 and not store.renew(key, a, 1000, 1001)
    with pytest.raises(LeaseLost):
        store.save(key, {"sequence": 5}, 1, a)
    rows = spark.createDataFrame([("x", "v", "h", 1, None, 1)], "identity string, version string, hash string, schema_version int, payload string, seen_at long")
    with pytest.raises(LeaseLost):
        store.commit(key, a, {}, 1, {"items": rows})
    assert store.read(key, "items").count() == 0
    assert store.commit(key, b, {"sequence": 1}, 1, {"items": rows}, batch=("q", 3))
    assert not store.commit(key, b, {"sequence": 9}, 1, {"items": rows}, batch=("q", 3))
    assert store.compact(key, "items", b, least=1) and store.read(key, "items").count() == 1
    store.commit(key, b, {}, 2, deletes={"items": rows})
    assert store.read(key, "items").count() == 0 and store.state(key)["sequence"] == 1
    assert store.keys("f") == [key]


def test_stream_commits_each_batch_once(spark, tmp_path):
    clock, _, spec, store, _ = world(spark, tmp_path)
    folder = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int").write.parquet(str(folder))
    for _ in range(2):
        stream = spark.readStream.schema("id string, v int").parquet(str(folder))
        follow(stream, spec, store, str(tmp_path / "cp"), clock).start().awaitTermination()
        spark.createDataFrame([("a", 5), ("c", 2)], "id string, v int").write.mode("append").parquet(str(folder))
    follow(spark.readStream.schema("id string, v int").parquet(str(folder)), spec, store, str(tmp_path / "cp"), clock).start().awaitTermination()
    log = [(json.loads(r["event"])["type"], json.loads(r["event"])["subject"]) for r in store.read(("orders", ""), "log").orderBy("sequence").collect()]
    assert log == [("created", "a"), ("created", "b"), ("updated", "a"), ("created", "c")]


def test_budget_and_schedule_arithmetic():
    b, p = Buckets(), Policy(10, 1000, 10)
    assert b.take("x", 10, p, 0) == 0 and b.take("x", 1, p, 0) == 100 and b.take("x", 1, p, 100) == 0
    m = Manager({"x": Policy(1, 1000, 1)})
    for who, lane in (("a", "backfill"), ("b", "live"), ("c", "live")):
        m.ask("x", who, lane)
    assert [w.who for w in m.advance("x", 0)[0]] == ["b"]
    assert [w.who for w in m.order("x")] == ["c", "a"]
    m.ask("x", "d", deadline=10)
    with pytest.raises(BudgetTimeout):
        m.advance("x", 20)
    plan = Schedule(min_ms=1000, max_ms=4000, jitter=0.0)
    s, why = schedule.after_success(schedule.initial(0, plan), plan, 0, lambda: 0.5, False)
    assert (s.interval_ms, why) == (1500, "idle:back-off")
    s, why = schedule.after_success(s, plan, 10, lambda: 0.5, True, rate_limit={"remaining": 0, "reset_at": 9010})
    assert (s.interval_ms, s.next_due_at, why) == (1000, 9010, "paced")


def test_webhook_and_config():
    sent = []
    post = lambda *a: sent.append(a) or (200, {}, b"")
    webhook("https://x", "s", lambda: T0, post)({"id": "1", "source": "s", "poller": "p", "type": "created", "subject": "k", "time": "t", "lane": "live", "sequence": 1, "data": '{"a":1}'})
    assert json.loads(sent[0][3])["data"] == {"a": 1} and sent[0][2]["webhook-signature"].startswith("v1,")
    with pytest.raises(ConfigError):
        FeedSpec("1bad", None, "id")
    with pytest.raises(ConfigError):
        FeedSpec("ok", None, "id", cursor="timestamp")
