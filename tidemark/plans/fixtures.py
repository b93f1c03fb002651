"""Two listings of the orders table, the events table as an API would page it, and deliveries made from it.

ORD_V1 is the stored snapshot, ORD_V2 the current listing; which rows were created, changed and deleted follows from
their keys. The SQL text of the same is beside each, for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical, hash_text

NOW = 1_767_225_600_000
SOURCE = "urn:feed:orders"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("identity"), cents.alias("total_cents"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))


def with_data(rows: DataFrame) -> DataFrame:
    item = F.struct("cust", "identity", "status", "total_cents")
    typed = rows.select(item.alias("x")).schema["x"].dataType
    data = canonical(item, typed)
    return rows.withColumn("data", data).withColumn("hash", hash_text(F.col("data"))).withColumn("version", F.lit(None).cast("string"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v1 = with_data(orders(spark, sf_dir).where("k % 19 <> 0"))
    return v1.select("k", "identity", "version", "hash", F.lit(1).alias("schema_version"), F.col("data").alias("payload"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).where("k % 17 <> 0").withColumn("total_cents", F.col("total_cents") + F.when(F.col("k") % 13 == 0, 100).otherwise(0))
    return with_data(rows).select("k", "identity", "version", "hash", "data")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), F.col("user_id").cast("string").alias("subject"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 29th event was parked, every 23rd waits for its retry, every third is delivered."""
    e = events(spark, sf_dir)
    status = F.when(F.col("event_id") % 3 == 0, "delivered").otherwise("pending")
    due = F.when(F.col("event_id") % 23 == 0, F.lit(NOW + 1000)).when(F.col("event_id") % 7 == 0, F.lit(NOW - 1000)).cast("long")
    return e.select(F.col("event_id").cast("string").alias("event_id"), "subject", F.col("event_id").alias("sequence"), status.alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), due.alias("next_attempt_at"), "event_type")


def parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_id % 2900 = 1")
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("sequence"), F.when(F.col("event_id") % 2 == 1, "poison").otherwise("invalid").alias("kind"), F.col("subject").alias("hold_key"), F.lit(NOW).alias("parked_at"))


ORD = """ord AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS identity, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
         o_orderstatus AS status, o_custkey AS cust FROM orders
), v2raw AS (
  SELECT k, identity, total_cents + CASE WHEN k % 13 = 0 THEN 100 ELSE 0 END AS total_cents, status, cust FROM ord WHERE k % 17 <> 0
), v1 AS (
  SELECT *, '{"cust":' || cust || ',"identity":"' || identity || '","status":"' || status || '","total_cents":' || total_cents || '}' AS data FROM ord WHERE k % 19 <> 0
), v2 AS (
  SELECT *, '{"cust":' || cust || ',"identity":"' || identity || '","status":"' || status || '","total_cents":' || total_cents || '}' AS data FROM v2raw
), d AS (
  SELECT coalesce(v1.identity, v2.identity) AS identity, coalesce(v1.k, v2.k) AS k,
         CASE WHEN v2.identity IS NULL THEN 'deleted' WHEN v1.identity IS NULL THEN 'created'
              WHEN sha256(v1.data) <> sha256(v2.data) THEN 'updated' ELSE 'unchanged' END AS type,
         sha256(v1.data) AS old_hash, sha256(v2.data) AS new_hash, v1.data AS old_data, v2.data AS new_data
  FROM v1 FULL JOIN v2 ON v1.identity = v2.identity
)"""

EVT = """evt AS (
  SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(user_id AS VARCHAR) AS subject, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events
)"""

DELIV = EVT + f""", deliv AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, subject, event_id AS sequence,
         CASE WHEN event_id % 3 = 0 THEN 'delivered' ELSE 'pending' END AS status, CAST(event_id % 5 AS INTEGER) AS attempts,
         CASE WHEN event_id % 23 = 0 THEN {NOW + 1000} WHEN event_id % 7 = 0 THEN {NOW - 1000} END AS next_attempt_at, event_type FROM evt
), parked AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id AS sequence, CASE WHEN event_id % 2 = 1 THEN 'poison' ELSE 'invalid' END AS kind, subject AS hold_key
  FROM evt WHERE event_id % 2900 = 1
)"""
