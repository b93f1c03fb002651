"""Work that must not grow with the number of batches, ranges or pages: reads of the outbox, shuffles, settled copies."""

from pyspark.sql import functions as F

from tests.test_cycles import world
from tidemark.spec import Delivery


def reads(engine, monkeypatch, table):
    """Of ``table``, the columns that each read asked for, as they happen."""
    seen, read = [], engine.store.read
    monkeypatch.setattr(engine.store, "read", lambda key, t, *more: (seen.append(more) if t == table else None, read(key, t, *more))[1])
    return seen


def test_delivery_reads_the_outbox_once_however_many_batches(spark, tmp_path, monkeypatch):
    _, _, engine = world(spark, tmp_path, 9, "snapshot", engine={"batch": 2}, delivery=Delivery(attempts=1))
    seen, got = reads(engine, monkeypatch, "outbox"), []

    def handler(e):
        if e["subject"] == "o0003":
            raise ValueError("no")
        got.append(e["subject"])

    engine.on("orders", handler)
    engine.tick()
    assert got == [f"o{i:04d}" for i in range(9) if i != 3]
    assert [r["hold_key"] for r in engine.parked("orders").collect()] == ["o0003"]
    assert len([x for x in seen if not x]) == 1
    assert engine.store.read(("orders", ""), "outbox").count() == 0 and not engine.store.state(("orders", ""))["waiting"]


def test_a_failed_key_stays_blocked_over_batches_until_the_next_pass(spark, tmp_path):
    """Without a hold, what was blocked goes out in the pass after, in order."""
    _, _, engine = world(spark, tmp_path, 6, "snapshot", engine={"batch": 1}, retain="payload", delivery=Delivery(attempts=1, hold=False, ordering_key="substring(subject, 5, 1) % 2"))
    tried = []

    def handler(e):
        tried.append(e["subject"])
        if e["subject"] == "o0000":
            raise ValueError("no")

    engine.on("orders", handler)
    engine.tick()
    assert tried == ["o0000", "o0001", "o0003", "o0005", "o0002", "o0004"]


def test_a_due_retry_does_not_wait_for_the_end_of_the_pass(spark, tmp_path):
    clock, _, engine = world(spark, tmp_path, 9, "snapshot", engine={"batch": 2}, delivery=Delivery(attempts=2))
    tried = []

    def handler(e):
        tried.append(e["subject"])
        clock.now += 5_000
        if e["subject"] == "o0000" and e["attempt"] == 1:
            raise ValueError("no")

    engine.on("orders", handler)
    engine.tick()
    assert tried == ["o0000", "o0001", "o0000", *(f"o{i:04d}" for i in range(2, 9))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_log_is_read_as_written_until_rows_are_gone(spark, tmp_path):
    _, _, engine = world(spark, tmp_path, 5, "snapshot", size=2)
    engine.tick()
    key = ("orders", "")
    assert "Exchange" not in plan(engine.store.read(key, "log"))
    rows = [tuple(r) for r in engine.store.read(key, "log").orderBy("sequence").collect()]
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
    engine.store.commit(key, None, {}, 1, deletes={"log": engine.store.read(key, "log").where("sequence = 2")})
    assert [tuple(r) for r in engine.store.read(key, "log").orderBy("sequence").collect()] == [r for r in rows if r[0] != 2]


def test_a_page_settles_its_changes_and_its_events_only(spark, tmp_path, monkeypatch):
    from tidemark import engine as module
    from tidemark.operators import events

    clock, source, engine = world(spark, tmp_path, 5, "snapshot", retain="payload")
    settled, settle = [], events.settle
    for where in (module, events):
        monkeypatch.setattr(where, "settle", lambda df: (settled.append(df.columns), settle(df))[1])
    engine.tick()
    assert len(settled) == 2
    clock.now += 60_000
    source.put({"id": "o0001", "status": "paid"})
    cycle = engine.tick().ran[0]["cycles"][0]
    assert (cycle["items"], cycle["events"], len(settled)) == (5, 1, 4)
    clock.now += 600_000
    cycle = engine.tick().ran[0]["cycles"][0]
    assert (cycle["items"], cycle["events"], len(settled)) == (5, 0, 5)  # nothing changed, nothing is numbered


def test_numbers_by_ranges_are_dealt_once(spark):
    from tidemark.operators.events import numbered_by_range, ranged

    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    for ranges in (None, 5):
        got, n = ranged(rows, 10, F.col("v") % 2 == 0, "v", ranges=ranges)
        assert n == 1000 and "Exchange" not in plan(got) and "Window" not in plan(got)
        want = sorted((r["v"] for r in rows.collect()), key=lambda v: (v % 2 == 0, v))
        assert [(r["sequence"], r["v"]) for r in got.orderBy("sequence").collect()] == [(11 + k, v) for k, v in enumerate(want)]
    none, n = ranged(rows.where("id < 0"), 10, "v")
    assert n == 0 and none.count() == 0 and numbered_by_range(rows.where("id < 0"), 0, "v", name="place").columns == ["id", "v", "place"]


def test_ids_of_odd_identities(spark):
    import hashlib

    from tidemark.functions.canonical import PREFIX, event_id

    odd = ["a|b", "a\\b", "\\|", "|\\", "||", "", "ä$1"]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "k int, v string").select("k", event_id(F.lit("s"), F.lit(""), F.col("v"), F.lit("h"), F.lit(1), F.lit("created")).alias("id")).orderBy("k").collect()
    text = lambda v: v.replace("\\", "\\\\").replace("|", "\\|")
    assert [r["id"] for r in got] == [hashlib.sha256(f"{PREFIX}s||{text(v)}|h|1|created".encode()).hexdigest() for v in odd]
