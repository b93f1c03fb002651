"""Summaries, counters, histograms, gauges, health and inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the duration histogram's buckets in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 10)


def poll_summary(events: DataFrame, *by: str) -> DataFrame:
    """A5."""
    kinds = [F.count_if(F.col("type") == k).alias(k) for k in ("created", "updated", "deleted")]
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), *kinds)


def histogram(values: DataFrame, seconds: Column, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Rows per bucket; ``le`` is the bucket's upper bound, null above the last."""
    le = F.lit(None).cast("double")
    for b in reversed(bounds):
        le = F.when(seconds <= b, F.lit(float(b))).otherwise(le)
    return values.groupBy(le.alias("le")).agg(F.count(F.lit(1)).alias("n"))


def gauge(rows: DataFrame, value: Column, at: str, *by: str) -> DataFrame:
    """The last value."""
    return rows.groupBy(*by).agg(F.max_by(value, F.col(at)).alias("value"))


def fair_share(served: DataFrame) -> DataFrame:
    """Served by weight; newcomers start at the least ratio."""
    return served.withColumn("ratio", F.col("served") / F.col("weight"))


def due(feeds: DataFrame, now: Column) -> DataFrame:
    """Null counts as due."""
    return feeds.where((F.col("next_due_at").isNull() | (F.col("next_due_at") <= now)) & (F.col("throttled_until").isNull() | (F.col("throttled_until") <= now)))


def inspected(feeds: DataFrame, items: DataFrame, outbox: DataFrame, parked: DataFrame, key: tuple[str, ...] = ("poller", "partition")) -> DataFrame:
    """Feeds with counts of their items, waiting and parked rows."""
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    out = feeds.join(count(items, "items"), list(key), "left")
    out = out.join(count(outbox.where(F.col("status") == "pending"), "pending"), list(key), "left")
    out = out.join(count(parked, "parked"), list(key), "left")
    return out.fillna(0, ["items", "pending", "parked"])


def health(inspection: DataFrame, now: Column, most_lag_ms: int = 3_600_000, most_parked: int = 0) -> DataFrame:
    """up or down with reasons."""
    reasons = F.array_compact(F.array(F.when(F.col("circuit") != "closed", F.lit("circuit")), F.when(now - F.col("last_poll_at") > most_lag_ms, F.lit("lag")), F.when(F.col("parked") > most_parked, F.lit("parked"))))
    return inspection.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("status", F.when(F.col("reasons") == "", "up").otherwise("down"))
