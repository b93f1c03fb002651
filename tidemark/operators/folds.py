"""Sequential folds over ordered arrays, inside the JVM (M2, M3, M5, O5 as traces).

An array holds one key's steps in order; arrays are bounded by what a key does in the window that is looked at, so
callers cut the history by time first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aimd(hits: Column, start: int, least: int, most: int) -> Column:
    """Intervals after each poll: halved (rounded) after events, half as long again when idle, within bounds."""
    zero = F.struct(F.lit(float(start)).alias("at"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, hit: Column) -> Column:
        v = F.when(hit, F.greatest(F.lit(float(least)), F.floor(s["at"] / 2 + 0.5))).otherwise(F.least(F.lit(float(most)), F.floor(s["at"] * 1.5 + 0.5)))
        return F.struct(v.cast("double").alias("at"), F.concat(s["out"], F.array(v.cast("double"))).alias("out"))

    return F.aggregate(hits, zero, step, lambda s: s["out"])


def circuit(ok: Column, failures: int = 5) -> Column:
    """closed or open after each poll: opens at so many failures in a row, closes at a success."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, fine: Column) -> Column:
        n = F.when(fine, 0).otherwise(s["n"] + 1)
        return F.struct(n.alias("n"), F.concat(s["out"], F.array(F.when(n >= failures, "open").otherwise("closed"))).alias("out"))

    return F.aggregate(ok, zero, step, lambda s: s["out"])


def token_bucket(arrivals: Column, requests: int, per_ms: int, burst: int) -> Column:
    """Of each arrival (epoch ms, ascending) whether it is served; exact integers in token-milliseconds, starts full."""
    cap = burst * per_ms
    zero = F.struct(F.lit(cap).cast("long").alias("have"), F.lit(None).cast("long").alias("at"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        passed = F.greatest(t - F.coalesce(s["at"], t), F.lit(0))
        have = F.least(F.lit(cap).cast("long"), s["have"] + passed * requests)
        served = have >= per_ms
        return F.struct((have - F.when(served, per_ms).otherwise(0)).cast("long").alias("have"), F.greatest(t, F.coalesce(s["at"], t)).alias("at"), F.concat(s["out"], F.array(served)).alias("out"))

    return F.aggregate(arrivals, zero, step, lambda s: s["out"])
