"""Delivery over the outbox: order per key, held and blocked keys, outcomes, parking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(outbox: DataFrame) -> DataFrame:
    """Whatever waits, whether or not its next attempt is due."""
    return outbox.where(F.col("status") == "pending")


def held_keys(parked: DataFrame) -> DataFrame:
    """A3."""
    return parked.where(F.col("hold_key").isNotNull()).select(F.col("hold_key").alias("key")).distinct()


def eligible(outbox: DataFrame, parked: DataFrame, now: Column, key: str = "subject") -> DataFrame:
    """Pending rows of keys that aren't held, up to the first row of a key that isn't due."""
    w = Window.partitionBy(key).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    late = F.coalesce(F.col("next_attempt_at") > now, F.lit(False))
    free = pending(outbox).join(held_keys(parked).withColumnRenamed("key", key), key, "left_anti")
    return free.withColumn("_blocked", F.max(late).over(w)).where(~F.col("_blocked")).drop("_blocked")


def followed(rows: DataFrame, key: str = "subject") -> DataFrame:
    """With ``_more``: whether the key has a later row."""
    return rows.withColumn("_more", F.lead("sequence").over(Window.partitionBy(key).orderBy("sequence")).isNotNull())


def groups(outbox: DataFrame, key: str = "subject") -> DataFrame:
    """Of each key how many wait, from which sequence on; keys in the order of their first row."""
    return pending(outbox).groupBy(key).agg(F.count(F.lit(1)).alias("waiting"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


def backoff_ms(attempt: Column, base: int = 1000, factor: float = 2.0, most: int = 120_000) -> Column:
    """F21 without jitter."""
    return F.floor(F.least(F.lit(float(most)), base * F.pow(F.lit(factor), F.greatest(attempt, F.lit(1)) - 1)) + 0.5).cast("long")


def outcomes(outbox: DataFrame, results: DataFrame, now: Column, attempts: int = 5, key: str = "subject") -> DataFrame:
    """Delivered, retried with a later attempt, or parked once attempts are used up. ``results``: event_id, ok."""
    tried = F.col("attempts") + 1
    fine = F.col("ok")
    return (
        outbox.join(results, "event_id")
        .withColumn("outcome", F.when(fine, "delivered").when(tried >= attempts, "parked").otherwise("retry"))
        .withColumn("next_attempt_at", F.when(F.col("outcome") == "retry", now + backoff_ms(tried)))
        .withColumn("hold_key", F.when(F.col("outcome") == "parked", F.col(key)))
        .withColumn("attempts", tried)
        .drop("ok")
    )


def retried(parked: DataFrame) -> DataFrame:
    """Poison rows go back to the outbox with attempts 0 and their old sequence."""
    return parked.where(F.col("kind") == "poison").select(F.col("id").alias("event_id"), "sequence", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def earliest_retry(outbox: DataFrame, now: Column) -> DataFrame:
    """A4."""
    return pending(outbox).where(F.col("next_attempt_at") > now).agg(F.min("next_attempt_at").alias("next_attempt_at"))


def upserted(base: DataFrame, delta: DataFrame, *key: str) -> DataFrame:
    """Rows of the delta replace those of the same key."""
    return base.join(delta.select(*key).distinct(), list(key), "left_anti").unionByName(delta)
