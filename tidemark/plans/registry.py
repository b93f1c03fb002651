"""All queries of the library with the SQL that says the same. Each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import times, web
from tidemark.functions.canonical import PREFIX
from tidemark.functions.lineage import settle
from tidemark.operators import cursors, diff, dispatch, events, folds, metrics, validate
from tidemark.plans import fixtures as fx
from tidemark.plans.fixtures import DELIV, EVT, NOW, ORD, SOURCE

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.snapshot_diff(fx.stored(spark, d), fx.current(spark, d).drop("k"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    found = diff.changes(_diff(spark, d)).withColumn("_k", F.col("identity").cast("long"))
    return events.enveloped(events.numbered_by_range(found, 0, "_k"), "orders", F.lit(""), SOURCE, 1, "live", F.lit(NOW), F.lit("null"))


EVENTS = "WITH " + ORD + f""", e AS (
  SELECT identity, k, type, CASE WHEN type = 'deleted' THEN old_hash ELSE new_hash END AS version,
         CASE WHEN type = 'deleted' THEN old_data ELSE new_data END AS data, CASE WHEN type <> 'created' THEN old_data END AS previous,
         row_number() OVER (ORDER BY k) AS sequence FROM d WHERE type <> 'unchanged'
), ev AS (
  SELECT *, sha256('{PREFIX}{SOURCE}||' || identity || '|' || version || '|1|' || type) AS id FROM e
)"""
CE = f"""'{{"specversion":"1.0","id":"' || id || '","source":"{SOURCE}","type":"orders.' || type || '","subject":"' || identity || '","time":"2026-01-01T00:00:00.000Z","datacontenttype":"application/json","data":' || data || ',"feedpartition":"","feedlane":"live","feedsequence":' || sequence || ',"feedpoller":"orders"' || coalesce(',"feedprevious":' || previous, '') || '}}'"""


@query("WITH " + ORD + " SELECT identity, type, coalesce(new_hash, old_hash) AS hash FROM d")
def snapshot_diff(spark, d):
    return _diff(spark, d).select("identity", "type", "hash")


for _kind in ("created", "updated", "deleted", "unchanged"):

    def _one(spark, d, kind=_kind):
        return _diff(spark, d).where(F.col("type") == kind).select("identity", "hash")

    query("WITH " + ORD + f" SELECT identity, coalesce(new_hash, old_hash) AS hash FROM d WHERE type = '{_kind}'", f"diff_{_kind}")(_one)


@query("WITH " + ORD + " SELECT identity, data FROM v2")
def canonical_json(spark, d):
    return fx.current(spark, d).select("identity", "data")


@query("WITH " + ORD + " SELECT identity, sha256(data) AS hash, substr(sha256('https://api/' || identity), 1, 32) AS url_hash FROM v2")
def fingerprint_hash(spark, d):
    from tidemark.functions.canonical import hash_url

    return fx.current(spark, d).select("identity", "hash", hash_url(F.concat(F.lit("https://api/"), "identity")).alias("url_hash"))


@query("WITH " + ORD + f" SELECT identity, CAST(NULL AS VARCHAR) AS version, sha256(data) AS hash, 1 AS schema_version, data AS payload, CAST({NOW} AS BIGINT) AS seen_at FROM v2")
def item_rows(spark, d):
    return diff.item_rows(fx.current(spark, d), 1, F.lit(NOW).cast("long"), "payload")


@query("WITH " + ORD + " SELECT identity, CASE WHEN k % 3 = 0 THEN sha256(v1.data) ELSE sha256(v2.data) END AS hash FROM v1 JOIN v2 USING (identity, k)")
def version_fast_path(spark, d):
    """Every third row states the stored version, so its hash is kept even where the payload differs."""
    s = fx.stored(spark, d).select("identity", F.col("hash").alias("old"), F.lit("v1").alias("sv"), "schema_version")
    c = fx.current(spark, d).withColumn("version", F.when(F.col("k") % 3 == 0, "v1").otherwise("v2"))
    return c.join(s, "identity").select("identity", diff.lazily_hashed(F.col("version"), F.col("sv"), F.col("schema_version"), 1, F.col("old"), F.col("hash")).alias("hash"))


for _mode, _unequal in (("rebaseline", "rebaselined"), ("emit", "updated")):

    def _drift(spark, d, mode=_mode):
        return diff.snapshot_diff(fx.stored(spark, d), fx.current(spark, d).drop("k"), 2, mode).select("identity", "type")

    query("WITH " + ORD + f" SELECT identity, CASE type WHEN 'updated' THEN '{_unequal}' WHEN 'unchanged' THEN 'rebaselined' ELSE type END AS type FROM d", f"schema_{_mode}")(_drift)


@query("WITH " + ORD + " SELECT identity, old_data AS previous, new_data AS data FROM d WHERE type = 'updated'")
def retain_previous(spark, d):
    return _diff(spark, d).where("type = 'updated'").select("identity", "previous", "data")


@query("WITH " + ORD + " SELECT identity FROM v1 WHERE identity NOT IN (SELECT identity FROM v2)")
def reconcile_deletes(spark, d):
    return diff.deletes(fx.stored(spark, d), fx.current(spark, d)).select("identity")


@query("WITH " + ORD + " SELECT identity FROM d WHERE type = 'unchanged'")
def backfill_force(spark, d):
    return diff.forced(fx.current(spark, d), fx.stored(spark, d), diff.changes(_diff(spark, d))).select("identity")


@query("""WITH p AS (SELECT identity, page, hash FROM (SELECT CAST(user_id AS VARCHAR) AS identity, event_id // 100 AS page, event_type AS hash,
  row_number() OVER (PARTITION BY user_id, event_id // 100 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1), l AS (
  SELECT *, lag(hash) OVER (PARTITION BY identity ORDER BY page) AS before FROM p)
SELECT identity, page, hash, CASE WHEN before IS NULL THEN 'created' WHEN before <> hash THEN 'updated' ELSE 'unchanged' END AS type FROM l""")
def page_visibility(spark, d):
    e = fx.events(spark, d).select(F.col("subject").alias("identity"), F.floor(F.col("event_id") / 100).alias("page"), "event_id", F.col("event_type").alias("hash"))
    pages = e.groupBy("identity", "page").agg(F.max_by("hash", "event_id").alias("hash"))
    none = fx.stored(spark, d).limit(0).select("identity", "hash")
    return diff.paged_changes(pages, none).select("identity", "page", "hash", "type")


@query("SELECT CAST(user_id AS VARCHAR) AS subject, arg_max(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def dup_last_wins(spark, d):
    return diff.last_wins(fx.events(spark, d).select("subject", "event_id", "event_type"), "subject", "event_id").select("subject", "event_type", "event_id")


@query("WITH " + ORD + """, r AS (SELECT identity, sha256(data) AS hash FROM v1)
SELECT CAST('0x' || substr(sha256(identity), 1, 8) AS BIGINT) % 256 AS bucket, count(*) AS n,
       CAST(sum(CAST(CAST('0x' || substr(sha256(identity || '|' || hash), 1, 10) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM r GROUP BY ALL""")
def merkle_buckets(spark, d):
    return diff.buckets(fx.stored(spark, d))


@query(EVENTS + " SELECT id, identity FROM ev")
def event_id(spark, d):
    return _events(spark, d).select("id", F.col("subject").alias("identity"))


@query(EVENTS + f" SELECT id, type, '{SOURCE}' AS source, identity AS subject, '2026-01-01T00:00:00.000Z' AS time, 'orders' AS poller, '' AS partition, 'live' AS lane, sequence, 'null' AS cursor, data, previous, 0 AS attempt FROM ev")
def event_envelope(spark, d):
    return _events(spark, d)


@query(EVENTS + " SELECT identity, sequence FROM ev")
def sequence_assign(spark, d):
    found = diff.changes(_diff(spark, d)).select("identity", F.col("identity").cast("long").alias("_k"))
    return events.numbered_by_range(found, 0, "_k").select("identity", "sequence")


@query(EVENTS + " SELECT id, " + CE + " AS body FROM ev")
def cloudevents(spark, d):
    return _events(spark, d).select("id", events.cloudevent().alias("body"))


@query(EVENTS + f""", h AS (SELECT identity AS key, data AS value, 'ce_feedlane=live;ce_feedpoller=orders;ce_feedsequence=' || sequence || ';ce_id=' || id || ';ce_source={SOURCE};ce_specversion=1.0;ce_subject=' || identity || ';ce_time=2026-01-01T00:00:00.000Z;ce_type=orders.' || type || ';content-type=application/json' AS headers FROM ev)
SELECT * FROM h""")
def kafka_binary(spark, d):
    h = F.array_join(F.array_sort(F.transform("headers", lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ";")
    return events.kafka_binary(_events(spark, d)).select("key", "value", h.alias("headers"))


@query(EVENTS + " SELECT identity AS key, " + CE + " AS value FROM ev")
def kafka_structured(spark, d):
    return events.kafka_structured(_events(spark, d)).select("key", "value")


@query(EVENTS + " SELECT 'q' AS QueueUrl, " + CE + " AS MessageBody, type, id AS MessageDeduplicationId, identity AS MessageGroupId FROM ev")
def sqs_message(spark, d):
    m = events.sqs_message(_events(spark, d), "q")
    return m.select("QueueUrl", "MessageBody", F.col("MessageAttributes")["type"].alias("type"), "MessageDeduplicationId", "MessageGroupId")


@query(EVENTS + " SELECT 'orders.' || type AS name, " + CE + " AS payload, id AS job_id FROM ev")
def queue_job(spark, d):
    return events.queue_job(_events(spark, d))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events ORDER BY ts, event_id LIMIT 100")
def keyset_first_page(spark, d):
    return cursors.keyset_page(fx.events(spark, d), "ms", "event_id", None, None).select("event_id", "ms")


@query("WITH " + EVT + ", c AS (SELECT ms, event_id FROM evt ORDER BY ms, event_id LIMIT 1 OFFSET 99) SELECT e.event_id, e.ms FROM evt e, c WHERE e.ms > c.ms OR (e.ms = c.ms AND e.event_id > c.event_id) ORDER BY e.ms, e.event_id LIMIT 100")
def keyset_next_page(spark, d):
    last = cursors.keyset_page(fx.events(spark, d), "ms", "event_id", None, None).orderBy(F.desc("ms"), F.desc("event_id")).first()
    return cursors.keyset_page(fx.events(spark, d), "ms", "event_id", F.lit(last["ms"]), F.lit(last["event_id"])).select("event_id", "ms")


@query("WITH " + EVT + " SELECT event_id FROM evt WHERE ms > (SELECT min(ms) + 3600000 FROM evt)")
def keyset_catchup(spark, d):
    """A whole cycle at once: the pages of a catch-up are one range scan."""
    e = fx.events(spark, d)
    start = e.agg(F.min("ms")).first()[0] + 3_600_000
    return cursors.keyset(e, "ms", "event_id", F.lit(start), F.lit(1 << 62)).select("event_id")


@query("SELECT event_id, CAST(ceil(row_number() OVER (ORDER BY event_id) / 100.0) AS BIGINT) AS page, ceil(row_number() OVER (ORDER BY event_id) / 100.0) * 100 < count(*) OVER () AS has_more FROM events")
def page_number(spark, d):
    return cursors.paged(fx.events(spark, d).select("event_id"), 100, "event_id")


@query("SELECT i * 100 AS \"offset\", CASE WHEN (i + 1) * 100 < n THEN (i + 1) * 100 END AS next_offset FROM (SELECT count(*) AS n FROM events), range(100000) t(i) WHERE i * 100 < n")
def token_page(spark, d):
    return cursors.tokens(fx.events(spark, d), 100)


@query("WITH " + ORD + ", o AS (SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS raw, CAST(epoch_ms(o_orderdate) AS BIGINT) AS ms, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS tie FROM orders) SELECT max(raw) AS value, max(ms) AS ms, (SELECT max(tie) FROM o WHERE ms = (SELECT max(ms) FROM o)) AS tie FROM o")
def watermark_advance(spark, d):
    """Orders share dates, so ties matter."""
    raw = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    o = fx.table(spark, d, "orders").select(raw.alias("raw"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("tie"))
    return cursors.watermark(o, "raw", times.timestamp_ms(F.col("raw")), "tie")


MID = "(SELECT CAST((min(ms) + max(ms)) / 2 AS BIGINT) FROM evt)"


def _mid(e: DataFrame) -> int:
    lo, hi = e.agg(F.min("ms"), F.max("ms")).first()
    return round((lo + hi) / 2)


@query("WITH " + EVT + ", b AS (SELECT min(ms) AS lo, max(ms) AS hi FROM evt) SELECT event_id FROM evt, b WHERE ms <= hi - 60000")
def lag_filter(spark, d):
    e = fx.events(spark, d)
    return cursors.fresh_enough(e, F.col("ms"), e.agg(F.max("ms")).first()[0], 60_000).select("event_id")


@query("WITH " + EVT + ", b AS (SELECT max(ms) AS hi FROM evt) SELECT event_id, hi - ms AS behind FROM evt, b WHERE ms >= hi - 120000")
def overlap_rescan(spark, d):
    e = fx.events(spark, d)
    hi = e.agg(F.max("ms")).first()[0]
    return cursors.keyset(e, "ms", "event_id", F.lit(hi - 120_000), None).select("event_id", cursors.lag_ms(F.lit(hi), F.col("ms")).alias("behind"))


@query("WITH " + EVT + ", b AS (SELECT min(ms) AS lo FROM evt) SELECT event_id FROM evt, b WHERE ms >= lo + 600000 AND ms <= lo + 7200000")
def backfill_range(spark, d):
    e = fx.events(spark, d)
    lo = e.agg(F.min("ms")).first()[0]
    return cursors.between(e, "ms", F.lit(lo + 600_000), F.lit(lo + 7_200_000)).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT min(o_orderdate) FROM orders) OR o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders))")
def ties_not_skipped(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    first = o.orderBy("o_orderdate", "o_orderkey").first()
    return cursors.keyset(o, "o_orderdate", "o_orderkey", F.lit(first["o_orderdate"]), F.lit(first["o_orderkey"])).select("o_orderkey")


@query("WITH " + EVT + ", l AS (SELECT event_id, ms, max(ms) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN ms - 600000 ELSE ms END AS ms FROM evt)) SELECT event_id, ms FROM l WHERE ms < mark")
def late_rows(spark, d):
    """T-3: rows behind the watermark of those before them; they are diffed all the same."""
    e = fx.events(spark, d).select("event_id", F.when(F.col("event_id") % 10 == 0, F.col("ms") - 600_000).otherwise(F.col("ms")).alias("ms"))
    w = Window.orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("mark", F.max("ms").over(w)).where("ms < mark").select("event_id", "ms")


TEXTS = "(VALUES ('1767225600'), ('1767225600123'), ('2026-01-01T00:00:00.5Z'), ('2026-01-01'), ('yesterday'), (''), (NULL)) t(raw)"


def _texts(spark: SparkSession, *values: str | None) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "raw string")


@query(f"SELECT raw, n_name, CASE WHEN regexp_full_match(raw, '[0-9]{{10}}') THEN CAST(raw AS BIGINT) * 1000 WHEN regexp_full_match(raw, '[0-9]{{13}}') THEN CAST(raw AS BIGINT) WHEN raw LIKE '2026%' THEN CAST(epoch_ms(CAST(replace(raw, 'Z', '') AS TIMESTAMP)) AS BIGINT) END AS ms FROM nation, {TEXTS}")
def parse_timestamp(spark, d):
    t = _texts(spark, "1767225600", "1767225600123", "2026-01-01T00:00:00.5Z", "2026-01-01", "yesterday", "", None)
    return fx.table(spark, d, "nation").crossJoin(F.broadcast(t)).select("raw", "n_name", times.timestamp_ms(F.col("raw")).alias("ms"))


@query(f"SELECT raw, n_nationkey, CASE WHEN regexp_full_match(raw, '[0-9]{{10}}') THEN CAST(1767225600 + n_nationkey AS VARCHAR) WHEN regexp_full_match(raw, '[0-9]{{13}}') THEN CAST(1767225600000 + n_nationkey * 1000 AS VARCHAR) ELSE strftime(epoch_ms(CAST(1767225600000 + n_nationkey * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS text FROM nation, {TEXTS} WHERE raw IS NOT NULL")
def format_timestamp(spark, d):
    t = _texts(spark, "1767225600", "1767225600123", "2026-01-01T00:00:00.5Z", "2026-01-01", "yesterday", "")
    ms = F.lit(NOW) + F.col("n_nationkey") * 1000
    return fx.table(spark, d, "nation").crossJoin(F.broadcast(t)).select("raw", "n_nationkey", times.format_timestamp_column(ms, F.col("raw")).alias("text"))


@query("SELECT n_nationkey, u AS unit, CAST(n_nationkey * m AS BIGINT) AS ms FROM nation, (VALUES ('ms', 1), ('s', 1000), ('m', 60000), ('h', 3600000), ('d', 86400000), ('x', NULL)) t(u, m)")
def parse_duration(spark, d):
    t = spark.createDataFrame([(u,) for u in ("ms", "s", "m", "h", "d", "x")], "unit string")
    text = F.concat(F.col("n_nationkey").cast("string"), "unit")
    return fx.table(spark, d, "nation").crossJoin(F.broadcast(t)).select("n_nationkey", "unit", times.duration_ms(text).alias("ms"))


@query(f"SELECT n_nationkey, raw, CASE raw WHEN '120' THEN 120000 WHEN '1.5' THEN 1500 WHEN 'Thu, 01 Jan 2026 00:02:00 GMT' THEN greatest(120000 - n_nationkey * 10000, 0) END AS wait_ms FROM nation, (VALUES ('120'), ('1.5'), ('-3'), ('soon'), ('Thu, 01 Jan 2026 00:02:00 GMT')) t(raw)")
def retry_after(spark, d):
    t = _texts(spark, "120", "1.5", "-3", "soon", "Thu, 01 Jan 2026 00:02:00 GMT")
    now = F.lit(NOW) + F.col("n_nationkey") * 10_000
    return fx.table(spark, d, "nation").crossJoin(F.broadcast(t)).select("n_nationkey", "raw", web.retry_after_ms(F.col("raw"), now).alias("wait_ms"))


@query("SELECT c_custkey, '***' AS authorization, c_name AS accept FROM customer")
def redact_headers(spark, d):
    c = fx.table(spark, d, "customer")
    h = web.redacted(F.create_map(F.lit("Authorization"), F.col("c_name"), F.lit("Accept"), F.col("c_name")))
    return c.select("c_custkey", h["Authorization"].alias("authorization"), h["Accept"].alias("accept"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS problem, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS title FROM customer")
def problem_details(spark, d):
    c = fx.table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "text/html").when(F.col("c_custkey") % 3 == 1, "application/problem+json; charset=utf-8").otherwise("application/json")
    body = F.to_json(F.struct(F.col("c_name").alias("title"), F.lit(400).alias("status")))
    p = web.is_problem(kind, body)
    return c.select("c_custkey", p.alias("problem"), F.when(p, web.problem_field(body, "title")).alias("title"))


@query(f"""SELECT c_custkey, 100 AS "limit", c_custkey % 100 AS remaining,
CASE c_custkey % 5 WHEN 3 THEN {NOW} + 60000 ELSE {NOW} + (c_custkey % 60) * 1000 END AS reset_at,
CASE c_custkey % 5 WHEN 0 THEN 'ietf' WHEN 1 THEN 'legacy' ELSE 'vendor' END AS source FROM customer""")
def rate_limit_headers(spark, d):
    """Structured, plain and vendor names; resets from now, as a date in seconds or milliseconds, and under -after."""
    c = fx.table(spark, d, "customer")
    k = F.col("c_custkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    made = lambda **h: F.create_map(*(v for name, value in h.items() for v in (F.lit(name.replace("_", "-")), value)))
    structured = made(ratelimit=text('"default";r=', k % 100, ";t=", k % 60), ratelimit_policy=F.lit('"default";q=100;w=60'), ratelimit_limit=F.lit("7"))
    plain = made(ratelimit_limit=F.lit("100, 100;w=60"), ratelimit_remaining=text(k % 100), ratelimit_reset=text(k % 60))
    names = dict(x_ratelimit_limit=F.lit("100"), x_ratelimit_remaining=text(k % 100))
    seconds = made(**names, x_ratelimit_reset=text(F.lit(NOW // 1000) + k % 60))
    millis = made(**names, x_ratelimit_reset=F.lit(str(NOW + 60_000)))
    after = made(**names, x_ratelimit_reset_after=text(k % 60))
    r = web.rate_limit_columns(F.when(k % 5 == 0, structured).when(k % 5 == 1, plain).when(k % 5 == 2, seconds).when(k % 5 == 3, millis).otherwise(after), F.lit(NOW))
    return c.select("c_custkey", r["limit"].alias("limit"), r["remaining"].alias("remaining"), r["reset_at"].alias("reset_at"), r["source"].alias("source"))


@query("SELECT c_custkey, 'https://api/items?since=' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '&limit=10' ELSE '' END AS url FROM customer")
def request_url(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select("c_custkey", web.request_url_column(F.lit("https://api/items"), ["since", "limit"], [k, F.when(k % 2 == 0, 10)]).alias("url"))


@query(EVENTS + " SELECT id FROM ev")
def webhook_signature(spark, d):
    """Signatures need HMAC, which SQL lacks; each is verified again, and the ids of those that hold are returned."""
    sign, verified = web.signature_column("whsec_c2VjcmV0"), web.verified_column("whsec_c2VjcmV0", NOW)
    e = _events(spark, d).select("id", events.cloudevent().alias("body"))
    stamp = F.lit(str(NOW // 1000))
    signed = e.select("id", "body", sign(F.col("id"), stamp, F.col("body")).alias("s"))
    return signed.where(verified(F.col("id"), stamp, F.col("body"), F.col("s"))).select("id")


def _checks() -> dict:
    return {"must not be negative": ("c_acctbal", F.col("c_acctbal") >= 0), "must be named": ("c_name", F.length("c_name") > 0)}


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND length(c_name) > 0")
def valid_rows(spark, d):
    return validate.split(fx.table(spark, d, "customer"), _checks())[0].select("c_custkey")


@query("SELECT c_custkey, 'c_acctbal: must not be negative' AS issue FROM customer WHERE c_acctbal < 0")
def invalid_issues(spark, d):
    bad = validate.split(fx.table(spark, d, "customer"), _checks())[1]
    return bad.select("c_custkey", F.inline("issues")).select("c_custkey", F.concat_ws(": ", "path", "message").alias("issue"))


@query("SELECT 'invalid:' || substr(sha256('{\"c_custkey\":' || c_custkey || '}'), 1, 32) AS id, 'invalid' AS kind, '{\"c_custkey\":' || c_custkey || '}' AS item FROM customer WHERE c_acctbal < 0")
def quarantine(spark, d):
    bad = validate.split(fx.table(spark, d, "customer"), _checks())[1]
    return validate.parked_rows(bad, F.to_json(F.struct("c_custkey")), F.lit(NOW)).select("id", "kind", "item")


@query("WITH " + EVT + f" SELECT event_id AS sequence, CAST({NOW} AS BIGINT) - ms AS age FROM evt WHERE event_id > 500 AND ms >= (SELECT min(ms) FROM evt) + 3600000")
def log_range(spark, d):
    e = fx.events(spark, d)
    lo = e.agg(F.min("ms")).first()[0]
    return e.where((F.col("event_id") > 500) & (F.col("ms") >= lo + 3_600_000)).select(F.col("event_id").alias("sequence"), (F.lit(NOW).cast("long") - F.col("ms")).alias("age"))


RANGE = "b AS (SELECT min(event_id) + (max(event_id) - min(event_id)) // 4 AS lo, max(event_id) - (max(event_id) - min(event_id)) // 4 AS hi FROM evt)"


@query("WITH " + EVT + ", " + RANGE + " SELECT event_id, 'replay' AS lane, 5000 + row_number() OVER (ORDER BY event_id) AS sequence, 0 AS attempt FROM evt, b WHERE event_id BETWEEN lo AND hi")
def replay_range(spark, d):
    """The middle half of the log, so it grows with the table."""
    e = fx.events(spark, d)
    lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
    cut = (hi - lo) // 4
    e = cursors.between(e, "event_id", F.lit(lo + cut), F.lit(hi - cut)).withColumn("lane", F.lit("live"))
    return events.replayed(e, 5000, F.col("event_id")).select("event_id", "lane", "sequence", "attempt")


@query("WITH " + EVT + ", b AS (SELECT max(ms) AS hi FROM evt) SELECT event_id FROM evt, b WHERE ms >= hi - 86400000")
def log_prune(spark, d):
    e = fx.events(spark, d)
    hi = e.agg(F.max("ms")).first()[0]
    return cursors.between(e, "ms", F.lit(hi - 86_400_000), None).select("event_id")


@query("WITH " + DELIV + " SELECT event_id, sequence FROM deliv WHERE status = 'pending'")
def outbox_pending(spark, d):
    return dispatch.pending(fx.deliveries(spark, d)).select("event_id", "sequence")


@query("WITH " + DELIV + " SELECT subject, count(*) AS waiting, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM deliv WHERE status = 'pending' GROUP BY subject")
def ordering_groups(spark, d):
    return dispatch.groups(fx.deliveries(spark, d))


@query("WITH " + DELIV + " SELECT DISTINCT hold_key AS key FROM parked")
def held_keys(spark, d):
    return dispatch.held_keys(fx.parked(spark, d))


@query("WITH " + DELIV + f""", f AS (SELECT *, max(coalesce(next_attempt_at > {NOW}, false)) OVER (PARTITION BY subject ORDER BY sequence) AS blocked
  FROM deliv WHERE status = 'pending' AND subject NOT IN (SELECT hold_key FROM parked)) SELECT event_id, subject, sequence FROM f WHERE NOT blocked""")
def dispatch_eligible(spark, d):
    return dispatch.eligible(fx.deliveries(spark, d), fx.parked(spark, d), F.lit(NOW)).select("event_id", "subject", "sequence")


OUTCOME = "WITH " + DELIV + f""", o AS (SELECT event_id, subject, attempts + 1 AS attempts, CASE WHEN event_type <> 'error' THEN 'delivered' WHEN attempts + 1 >= 5 THEN 'parked' ELSE 'retry' END AS outcome FROM deliv WHERE status = 'pending')
SELECT event_id, outcome, attempts, CASE WHEN outcome = 'retry' THEN {NOW} + CAST(least(120000, 1000 * pow(2, attempts - 1)) AS BIGINT) END AS next_attempt_at, CASE WHEN outcome = 'parked' THEN subject END AS hold_key FROM o"""


def _outcomes(spark, d):
    p = dispatch.pending(fx.deliveries(spark, d))
    return dispatch.outcomes(p, p.select("event_id", (F.col("event_type") != "error").alias("ok")), F.lit(NOW)).select("event_id", "outcome", "attempts", "next_attempt_at", "hold_key")


@query(OUTCOME)
def delivery_outcome(spark, d):
    return _outcomes(spark, d)


@query(f"SELECT event_id, hold_key FROM ({OUTCOME}) WHERE outcome = 'parked'")
def poison_parked(spark, d):
    return _outcomes(spark, d).where("outcome = 'parked'").select("event_id", "hold_key")


@query("WITH " + DELIV + " SELECT id AS event_id, sequence, 'pending' AS status, 0 AS attempts FROM parked WHERE kind = 'poison'")
def retry_parked(spark, d):
    return dispatch.retried(fx.parked(spark, d))


@query("SELECT n_nationkey, CAST(least(120000, 1000 * pow(2, greatest(n_nationkey, 1) - 1)) AS BIGINT) AS delay_ms FROM nation")
def backoff_nojitter(spark, d):
    return fx.table(spark, d, "nation").select("n_nationkey", dispatch.backoff_ms(F.col("n_nationkey")).alias("delay_ms"))


@query("WITH " + DELIV + f" SELECT min(next_attempt_at) AS next_attempt_at FROM deliv WHERE status = 'pending' AND next_attempt_at > {NOW}")
def earliest_retry(spark, d):
    return dispatch.earliest_retry(fx.deliveries(spark, d), F.lit(NOW))


@query("SELECT event_id AS id, min(event_id) AS sequence FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 4 = 0) GROUP BY event_id")
def dedup_by_event_id(spark, d):
    e = fx.events(spark, d).select(F.col("event_id").alias("id"), F.col("event_id").alias("sequence"))
    return events.once(e.unionByName(e.where("id % 4 = 0")))


def _log(spark, d):
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("updated")
    return fx.events(spark, d).select("subject", F.col("event_id").alias("sequence"), kind.alias("type"), F.col("cents").cast("string").alias("data"))


@query("WITH " + EVT + ", l AS (SELECT subject, arg_max(event_type, event_id) AS t, CAST(arg_max(cents, event_id) AS VARCHAR) AS data, max(event_id) AS sequence FROM evt GROUP BY subject) SELECT subject, data, sequence FROM l WHERE t <> 'error'")
def fold_latest_state(spark, d):
    return events.latest_state(_log(spark, d))


@query("WITH " + EVT + ", l AS (SELECT subject, arg_max(event_type, event_id) AS t, CAST(arg_max(cents, event_id) AS VARCHAR) AS data FROM evt GROUP BY subject) SELECT subject, CASE WHEN t = 'error' THEN 'missing' ELSE 'differs' END AS problem FROM l WHERE t = 'error' OR CAST(subject AS BIGINT) % 5 = 0")
def convergence_check(spark, d):
    log = _log(spark, d)
    source = log.groupBy("subject").agg(F.max_by("data", "sequence").alias("data"))
    state = events.latest_state(log).withColumn("data", F.when(F.col("subject").cast("long") % 5 == 0, F.concat("data", F.lit("x"))).otherwise(F.col("data")))
    return events.convergence(source, state)


@query("WITH " + EVT + ", l AS (SELECT subject, event_id AS sequence, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'updated' END AS type FROM evt), b AS (SELECT *, lag(type) OVER (PARTITION BY subject ORDER BY sequence) AS before FROM l) SELECT subject, sequence, type, CASE WHEN before IS NULL OR before = 'deleted' THEN type = 'created' ELSE type IN ('updated', 'deleted') END AS allowed FROM b")
def lifecycle_check(spark, d):
    return events.lifecycle(_log(spark, d)).select("subject", "sequence", "type", "allowed")


@query("WITH " + EVT + ", p AS (SELECT subject, event_id AS position, CASE WHEN event_id % 50 = 0 THEN event_id - 60 ELSE event_id END AS sequence FROM evt), b AS (SELECT *, lag(sequence) OVER (PARTITION BY subject ORDER BY position) AS before FROM p) SELECT subject, position, sequence FROM b WHERE sequence <= before")
def order_violations(spark, d):
    e = fx.events(spark, d)
    p = e.select("subject", F.col("event_id").alias("position"), F.when(F.col("event_id") % 50 == 0, F.col("event_id") - 60).otherwise(F.col("event_id")).alias("sequence"))
    return events.order_violations(p)


@query("WITH " + EVT + ", k AS (SELECT event_type AS partition, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sequence, event_id FROM evt) SELECT * FROM k")
def partition_fanout(spark, d):
    e = fx.events(spark, d).select(F.col("event_type").alias("partition"), "event_id")
    return events.numbered(e, 0, F.col("event_id"), by=("partition",)).select("partition", "sequence", "event_id")


@query("SELECT DISTINCT event_type AS partition FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_type IN ('click', 'error'))")
def partition_removed(spark, d):
    old = fx.events(spark, d).select(F.col("event_type").alias("partition")).distinct()
    return old.join(old.where(F.col("partition").isin("click", "error")), "partition", "left_anti")


def _feeds(spark, d):
    e = fx.events(spark, d)
    return e.groupBy(F.lit("events").alias("poller"), F.col("event_type").alias("partition")).agg(F.max("ms").alias("last_poll_at"), F.when(F.max("event_id") % 2 == 0, "open").otherwise("closed").alias("circuit"), F.when(F.max("event_id") % 3 > 0, F.max("ms")).alias("next_due_at"), F.when(F.max("event_id") % 5 == 0, F.lit(NOW + 1)).cast("long").alias("throttled_until"))


FEEDS = EVT + f", feeds AS (SELECT 'events' AS poller, event_type AS partition, max(ms) AS last_poll_at, CASE WHEN max(event_id) % 2 = 0 THEN 'open' ELSE 'closed' END AS circuit, CASE WHEN max(event_id) % 3 > 0 THEN max(ms) END AS next_due_at, CASE WHEN max(event_id) % 5 = 0 THEN {NOW + 1} END AS throttled_until FROM evt GROUP BY event_type)"


@query("WITH " + FEEDS + ", c AS (SELECT event_type AS partition, count(*) AS items, count(*) FILTER (event_id % 3 <> 0) AS pending, count(*) FILTER (event_id % 2900 = 1) AS parked FROM evt GROUP BY event_type) SELECT poller, partition, circuit, items, pending, parked FROM feeds JOIN c USING (partition)")
def inspect_report(spark, d):
    key = [F.lit("events").alias("poller"), F.col("event_type").alias("partition")]
    e = fx.events(spark, d)
    out = metrics.inspected(_feeds(spark, d), e.select(*key), fx.deliveries(spark, d).select(*key, "status"), e.where("event_id % 2900 = 1").select(*key))
    return out.select("poller", "partition", "circuit", "items", "pending", "parked")


@query("WITH " + FEEDS + f" SELECT poller, partition FROM feeds WHERE (next_due_at IS NULL OR next_due_at <= {NOW}) AND (throttled_until IS NULL OR throttled_until <= {NOW})")
def due_feeds(spark, d):
    return metrics.due(_feeds(spark, d), F.lit(NOW)).select("poller", "partition")


@query("WITH " + FEEDS + f" SELECT partition, CASE WHEN circuit <> 'closed' THEN 'circuit,lag' ELSE 'lag' END AS reasons, 'down' AS status FROM feeds")
def health(spark, d):
    f = _feeds(spark, d).withColumn("parked", F.lit(0))
    return metrics.health(f, F.lit(NOW)).select("partition", "reasons", "status")


@query("WITH " + ORD + ", x AS (SELECT CASE WHEN k % 2 = 0 THEN 'live' ELSE 'backfill' END AS lane, type FROM d WHERE type <> 'unchanged') SELECT lane, count(*) AS items, count(*) FILTER (type = 'created') AS created, count(*) FILTER (type = 'updated') AS updated, count(*) FILTER (type = 'deleted') AS deleted FROM x GROUP BY lane")
def poll_summary(spark, d):
    lane = F.when(F.col("identity").cast("long") % 2 == 0, "live").otherwise("backfill")
    return metrics.poll_summary(diff.changes(_diff(spark, d)).withColumn("lane", lane), "lane")


@query("WITH " + DELIV + " SELECT count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (status = 'pending') AS waiting, CAST(sum(attempts) AS BIGINT) AS attempts FROM deliv")
def tick_totals(spark, d):
    return fx.deliveries(spark, d).agg(F.count_if(F.col("status") == "delivered").alias("delivered"), F.count_if(F.col("status") == "pending").alias("waiting"), F.sum("attempts").alias("attempts"))


@query("WITH " + EVT + " SELECT event_type, count(*) AS fetched, CAST(sum(cents) AS BIGINT) AS cents FROM evt GROUP BY event_type")
def metric_counters(spark, d):
    return fx.events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("fetched"), F.sum("cents").alias("cents"))


@query("WITH " + EVT + ", s AS (SELECT cents / 1000.0 AS s FROM evt) SELECT CAST((SELECT min(b) FROM (VALUES (0.005), (0.01), (0.025), (0.05), (0.075), (0.1), (0.25), (0.5), (0.75), (1.0), (2.5), (5.0), (10.0)) t(b) WHERE s <= b) AS DOUBLE) AS le, count(*) AS n FROM s GROUP BY 1")
def duration_histogram(spark, d):
    return metrics.histogram(fx.events(spark, d), F.col("cents") / 1000)


@query("WITH " + EVT + " SELECT event_type, arg_max(CASE WHEN cents % 2 = 0 THEN 0 ELSE 2 END, event_id) AS value FROM evt GROUP BY event_type")
def circuit_gauge(spark, d):
    return metrics.gauge(fx.events(spark, d), F.when(F.col("cents") % 2 == 0, 0).otherwise(2), "event_id", "event_type")


@query("WITH " + EVT + " SELECT event_type, count(*) / (1.0 + min(event_id) % 3) AS ratio FROM evt GROUP BY event_type")
def fair_share(spark, d):
    served = fx.events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("served"), (1 + F.min("event_id") % 3).alias("weight"))
    return metrics.fair_share(served).select("event_type", "ratio")


@query("WITH " + EVT + " SELECT ms // 60000 AS minute, count(*) AS calls FROM evt GROUP BY ALL")
def rate_limit_usage(spark, d):
    return fx.events(spark, d).groupBy(F.floor(F.col("ms") / 60_000).alias("minute")).agg(F.count(F.lit(1)).alias("calls"))


def _ordered(spark, d, value):
    rows = F.array_sort(F.collect_list(F.struct("event_id", value.alias("v"))))
    return fx.events(spark, d).groupBy("subject").agg(F.transform(rows, lambda x: x["v"]).alias("steps"))


RANKED = "r AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY event_id) AS i, event_type, ms FROM evt)"


@query("WITH RECURSIVE " + EVT + ", " + RANKED + """, f AS (SELECT subject, 0::BIGINT AS i, 30000.0::DOUBLE AS v FROM (SELECT DISTINCT subject FROM evt) UNION ALL
SELECT f.subject, r.i, CASE WHEN r.event_type = 'purchase' THEN greatest(30000, floor(f.v / 2 + 0.5)) ELSE least(300000, floor(f.v * 1.5 + 0.5)) END FROM f JOIN r ON r.subject = f.subject AND r.i = f.i + 1)
SELECT subject, i, CAST(v AS BIGINT) AS interval_ms FROM f WHERE i > 0""")
def aimd_fold(spark, d):
    s = _ordered(spark, d, F.col("event_type") == "purchase").select("subject", F.posexplode(folds.aimd(F.col("steps"), 30_000, 30_000, 300_000)).alias("i", "v"))
    return s.select("subject", (F.col("i") + 1).cast("long").alias("i"), F.col("v").cast("long").alias("interval_ms"))


@query("WITH RECURSIVE " + EVT + ", " + RANKED + """, f AS (SELECT subject, 0::BIGINT AS i, 0 AS n FROM (SELECT DISTINCT subject FROM evt) UNION ALL
SELECT f.subject, r.i, CASE WHEN r.event_type <> 'error' THEN 0 ELSE f.n + 1 END FROM f JOIN r ON r.subject = f.subject AND r.i = f.i + 1)
SELECT subject, i, CASE WHEN n >= 2 THEN 'open' ELSE 'closed' END AS circuit FROM f WHERE i > 0""")
def circuit_fold(spark, d):
    s = _ordered(spark, d, F.col("event_type") != "error").select("subject", F.posexplode(folds.circuit(F.col("steps"), 2)).alias("i", "circuit"))
    return s.select("subject", (F.col("i") + 1).cast("long").alias("i"), "circuit")


@query("WITH RECURSIVE " + EVT + ", " + RANKED + """, f AS (SELECT subject, 0::BIGINT AS i, 7200000::BIGINT AS have, NULL::BIGINT AS seen, false AS served FROM (SELECT DISTINCT subject FROM evt) UNION ALL
SELECT subject, i, CASE WHEN have >= 3600000 THEN have - 3600000 ELSE have END, seen, have >= 3600000 FROM (
  SELECT f.subject, r.i, least(7200000, f.have + greatest(r.ms - coalesce(f.seen, r.ms), 0)) AS have, greatest(r.ms, coalesce(f.seen, r.ms)) AS seen FROM f JOIN r ON r.subject = f.subject AND r.i = f.i + 1))
SELECT subject, i, served FROM f WHERE i > 0""")
def token_bucket_trace(spark, d):
    s = _ordered(spark, d, F.col("ms")).select("subject", F.posexplode(folds.token_bucket(F.col("steps"), 1, 3_600_000, 2)).alias("i", "served"))
    return s.select("subject", (F.col("i") + 1).cast("long").alias("i"), "served")


@query("WITH " + EVT + ", s AS (SELECT event_type, count(*) / (1.0 + min(event_id) % 3) AS ratio, max(event_id) AS last FROM evt GROUP BY event_type) SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ratio, last, event_id) AS place FROM evt JOIN s USING (event_type)")
def fair_queue_order(spark, d):
    """O5 for requests that all wait: lane rank, then served by weight, then last served, then first come."""
    e = fx.events(spark, d)
    served = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("served"), (1 + F.min("event_id") % 3).alias("weight"), F.max("event_id").alias("last"))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    waiting = e.join(metrics.fair_share(served), "event_type")
    return events.numbered_by_range(waiting, 0, rank, "ratio", "last", "event_id", name="place").select("event_id", "place")


@query("SELECT c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM customer")
def code_unit_order(spark, d):
    c = fx.table(spark, d, "customer")
    return events.numbered_by_range(c, 0, diff.code_unit_order(F.col("c_name")), "c_custkey", name="place").select("c_name", "place")


@query("WITH " + ORD + " SELECT identity, sha256(data) AS hash FROM v1 WHERE k % 17 = 0 UNION ALL SELECT identity, sha256(data) FROM v2")
def keyed_upsert(spark, d):
    s, c = fx.stored(spark, d).select("identity", "hash"), fx.current(spark, d).select("identity", "hash")
    return dispatch.upserted(s, c, "identity")


# small operators of their own


@query("WITH " + EVT + " SELECT event_type AS point, count(*) AS kills FROM evt WHERE event_id % 3 = 0 GROUP BY event_type")
def kill_tally(spark, d):
    return events.kill_tally(fx.events(spark, d).where("event_id % 3 = 0").withColumnRenamed("event_type", "point"))


@query("WITH " + EVT + """ SELECT CAST(event_id AS VARCHAR) AS id, event_id + 10000000 AS position,
CASE WHEN event_id % 8 = 0 THEN 'replay' WHEN event_id % 12 = 0 THEN 'backwards' ELSE 'retry' END AS kind,
CASE WHEN event_id % 40 = 0 THEN 'data' END AS problem FROM evt WHERE event_id % 4 = 0""")
def redelivery_match(spark, d):
    """Every fourth event comes twice: again, as a replay, or out of order; some with other data."""
    k = F.col("event_id")
    first = fx.events(spark, d).select(k, k.cast("string").alias("id"), k.alias("position"), k.alias("sequence"), "subject", F.col("event_type").alias("type"), F.col("cents").cast("string").alias("data"))
    later = F.when(k % 8 == 0, k + 50_000_000).when(k % 12 == 0, k - 1).otherwise(k)
    again = first.where("event_id % 4 = 0").withColumns({"position": k + 10_000_000, "sequence": later, "data": F.when(k % 40 == 0, "other").otherwise(F.col("data"))})
    return events.redeliveries(first.unionByName(again).drop("event_id")).select("id", "position", "kind", "problem")


@query("WITH " + EVT + " SELECT event_id, sign((ms // 1000) * 1000 - ms)::INTEGER AS seconds_to_millis, CASE WHEN event_type > subject THEN event_type ELSE subject END AS larger, subject AS against_null FROM evt")
def text_comparisons(spark, d):
    """F12 on the same time in seconds and in milliseconds, F13 with and without a null."""
    e = fx.events(spark, d)
    seconds = F.floor(F.col("ms") / 1000).cast("string")
    return e.select("event_id", times.compare_timestamps(seconds, F.col("ms").cast("string")).alias("seconds_to_millis"), times.max_string(F.col("event_type"), F.col("subject")).alias("larger"), times.max_string(F.lit(None).cast("string"), F.col("subject")).alias("against_null"))


@query("SELECT c_custkey, c_custkey % 3 < 2 AS fresh, base64(encode('o:' || c_custkey)) AS token, c_custkey AS \"offset\" FROM customer")
def tags_and_tokens(spark, d):
    """weak tags and lists of them; F27: an offset as a token and back."""
    k = F.col("c_custkey")
    tag = F.concat(F.lit('"'), k.cast("string"), F.lit('"'))
    asked = F.when(k % 3 == 0, F.concat(F.lit('"x", W/'), tag)).when(k % 3 == 1, F.lit("*")).otherwise(F.lit('"x"'))
    token = web.offset_token(k)
    return fx.table(spark, d, "customer").select("c_custkey", web.weak_etag_equal(tag, asked).alias("fresh"), token.alias("token"), web.token_offset(token).alias("offset"))


@query("WITH " + DELIV + " SELECT event_id, attempts + 1 AS attempt FROM deliv")
def attempt_stamp(spark, d):
    return events.attempted(fx.deliveries(spark, d)).select("event_id", "attempt")


@query("WITH " + DELIV + " SELECT id, kind, row_number() OVER (ORDER BY sequence) AS place FROM parked WHERE kind = 'poison'")
def parked_listing(spark, d):
    """Of one kind, by when they were parked, then by sequence."""
    rows = fx.parked(spark, d).where("kind = 'poison'")
    return events.numbered_by_range(rows, 0, "parked_at", "sequence", name="place").select("id", "kind", "place")


# the control plane's own arithmetic, against recursive SQL


def _per_subject(spark, d, step, schema):
    """``step`` gets one subject's events in order; a subject's events are what one key does."""
    rows = fx.events(spark, d).select("subject", "event_id", "event_type", "ms")

    def run(group):
        return step(group.sort_values("event_id"))

    return rows.groupBy("subject").applyInPandas(run, schema)


@query(_SQL["aimd_fold"])
def schedule_moves(spark, d):
    """M2 by the scheduler itself: a purchase is a poll with events, anything else an idle one."""
    from tidemark.control import schedule
    from tidemark.spec import Schedule

    def step(group):
        plan = Schedule(min_ms=30_000, max_ms=300_000, jitter=0.0)
        s, out = schedule.initial(0, plan), []
        for kind in group["event_type"]:
            s, _ = schedule.after_success(s, plan, 0, float, kind == "purchase")
            out.append(s.interval_ms)
        return group.assign(i=range(1, len(group) + 1), interval_ms=out)[["subject", "i", "interval_ms"]]

    return _per_subject(spark, d, step, "subject string, i long, interval_ms long")


@query(_SQL["circuit_fold"])
def schedule_circuit(spark, d):
    """M3 by the scheduler itself: an error event is a failed poll, anything else a good one."""
    from tidemark.control import schedule
    from tidemark.spec import Schedule

    def step(group):
        plan = Schedule(circuit_failures=2, jitter=0.0)
        s, out = schedule.initial(0, plan), []
        for kind in group["event_type"]:
            s, _ = schedule.after_failure(s, plan, 0, float, {}) if kind == "error" else schedule.after_success(s, plan, 0, float, False)
            out.append(s.circuit)
        return group.assign(i=range(1, len(group) + 1), circuit=out)[["subject", "i", "circuit"]]

    return _per_subject(spark, d, step, "subject string, i long, circuit string")


@query(_SQL["token_bucket_trace"])
def budget_takes(spark, d):
    """M5 by the budget's own buckets: a request at each event's time."""
    from tidemark.control.budget import Buckets, Policy

    def step(group):
        buckets, policy = Buckets(), Policy(1, 3_600_000, 2)
        served = [buckets.take("b", 1, policy, int(ms)) == 0 for ms in group["ms"]]
        return group.assign(i=range(1, len(group) + 1), served=served)[["subject", "i", "served"]]

    return _per_subject(spark, d, step, "subject string, i long, served boolean")


# whole cycles of the engine over a store of their own


class _Hour:
    def __init__(self):
        self.now = NOW

    def __call__(self):
        return self.now


def _engine(spark, spec, **more):
    """An engine on a fresh store: a folder of its own beside the session's checkpoints if that is a local path, else a temporary one."""
    import tempfile
    import uuid
    from urllib.parse import urlparse

    from tidemark.engine import Engine
    from tidemark.state.manifest import ManifestStore, MemoryLog

    shared = spark.conf.get("spark.checkpoint.dir", None)
    at = urlparse(shared) if shared else None
    home = f"{at.path}/state-{uuid.uuid4().hex}" if at and at.scheme in ("", "file") else tempfile.mkdtemp(prefix="state-")
    clock = _Hour()
    return Engine(spark, ManifestStore(spark, home, MemoryLog()), [spec], clock, lambda: 0.5, **more), clock


def _logged(engine, key):
    one = lambda k: F.get_json_object("event", f"$.{k}")
    return engine.store.read(key, "log").select("sequence", one("subject").alias("identity"), one("type").alias("type"), one("data").alias("data"))


CYCLES = "WITH " + ORD + """, e AS (
  SELECT 0 AS cycle, identity, 'created' AS type, data FROM v1
  UNION ALL SELECT 1, identity, type, CASE WHEN type = 'deleted' THEN old_data ELSE new_data END FROM d WHERE type <> 'unchanged'
) SELECT row_number() OVER (ORDER BY cycle, type = 'deleted', identity) AS sequence, identity, type, data FROM e"""


@query(CYCLES)
def engine_snapshot_cycles(spark, d):
    """A first listing of the orders, then the changed one; the log as the store has it."""
    from tidemark.spec import FeedSpec, Schedule

    listings = iter([fx.orders(spark, d).where("k % 19 <> 0"), fx.orders(spark, d).where("k % 17 <> 0").withColumn("total_cents", F.col("total_cents") + F.when(F.col("k") % 13 == 0, 100).otherwise(0))])
    fetch = lambda ctx: next(listings).select("cust", "identity", "status", "total_cents")
    engine, clock = _engine(spark, FeedSpec("orders", fetch, "identity", retain="payload", schedule=Schedule(jitter=0.0)))
    engine.tick()
    clock.now += 600_000
    engine.tick()
    return _logged(engine, ("orders", ""))


@query("WITH " + EVT + ", p AS (SELECT *, ntile(7) OVER (ORDER BY event_id) AS page FROM evt) SELECT row_number() OVER (ORDER BY page, CAST(event_id AS VARCHAR)) AS sequence, CAST(event_id AS VARCHAR) AS identity, 'created' AS type, '{\"cents\":' || cents || ',\"event_id\":' || event_id || '}' AS data FROM p")
def engine_token_pages(spark, d):
    """Seven pages behind tokens, each committed with its cursor, in one cycle."""
    from tidemark.engine import Listing
    from tidemark.spec import FeedSpec, Schedule

    e = fx.events(spark, d).select("event_id", "cents")
    n = e.count()
    sizes = [n // 7 + (k < n % 7) for k in range(7)]
    placed = events.numbered_by_range(e, 0, "event_id", name="place")

    def fetch(ctx):
        k = int((ctx.cursor or {"value": 0})["value"])
        lo = sum(sizes[:k])
        page = placed.where((F.col("place") > lo) & (F.col("place") <= lo + sizes[k])).select("event_id", "cents")
        return Listing(page, cursor=str(k + 1) if k < 6 else None)

    engine, _ = _engine(spark, FeedSpec("events", fetch, "event_id", cursor="token", schedule=Schedule(jitter=0.0)))
    engine.tick()
    return _logged(engine, ("events", ""))


@query("SELECT CAST(c_custkey AS VARCHAR) AS identity, CASE WHEN c_custkey % 97 = 0 THEN 'parked' ELSE 'delivered' END AS outcome, 1 AS attempts FROM customer")
def engine_delivery(spark, d):
    """Every customer is delivered once; a handler that fails for some has them parked at the first attempt."""
    from tidemark.spec import Delivery, FeedSpec, Schedule

    c = fx.table(spark, d, "customer").select("c_custkey", "c_name")
    engine, _ = _engine(spark, FeedSpec("customers", lambda ctx: c, "c_custkey", delivery=Delivery(attempts=1), schedule=Schedule(jitter=0.0)), batch=20_000)
    schema = "identity string, outcome string, attempts int"
    got, kept = [], []

    def keep():
        """What was delivered goes to the checkpoint folder, so the driver holds a part of it only."""
        if got:
            kept.append(settle(spark.createDataFrame(got, schema).coalesce(1)))
            got.clear()

    def handler(event):
        if int(event["subject"]) % 97 == 0:
            raise ValueError("no")
        got.append((event["subject"], "delivered", event["attempt"]))
        if len(got) == 200_000:
            keep()

    engine.on("customers", handler)
    engine.tick()
    keep()
    parked = engine.parked("customers").select(F.get_json_object("event", "$.subject").alias("identity"), F.lit("parked").alias("outcome"), "attempts")
    return reduce(DataFrame.unionByName, kept, parked)
