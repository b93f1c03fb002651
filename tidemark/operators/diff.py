"""Snapshot diff: last-wins dedup, lookup join, classification, deletes.

``current`` has (identity, version, item columns...), ``stored`` the item rows (identity, version, hash,
schema_version, payload). One full outer join does what a page loop with look-ups would; Spark picks the physical join,
so nothing is broadcast unless its size is known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Of each key the last row, at the place of the first (within a page)."""
    others = [c for c in rows.columns if c not in (key, position)]
    last = F.max_by(F.struct(*others), F.col(position)).alias("_last")
    return rows.groupBy(key).agg(last, F.min(position).alias(position)).select(key, position, *(F.col(f"_last.{c}").alias(c) for c in others))


def lazily_hashed(version: Column, stored_version: Column, stored_schema: Column, schema_version: int, stored_hash: Column, fresh_hash: Column) -> Column:
    """An equal version of the same schema keeps the stored hash, so the fresh one isn't computed for that row."""
    same = version.isNotNull() & (version == stored_version) & (stored_schema == schema_version)
    return F.when(same, stored_hash).otherwise(fresh_hash)


def classified(stored_hash: Column, stored_schema: Column, new_hash: Column, schema_version: int, on_schema_change: str = "rebaseline") -> Column:
    """Created, updated, unchanged or rebaselined; null where there is no current row."""
    drifted = stored_schema != schema_version
    out = F.when(new_hash.isNull(), F.lit(None).cast("string")).when(stored_hash.isNull(), "created")
    if on_schema_change == "rebaseline":
        out = out.when(drifted, "rebaselined")
    return out.when(stored_hash != new_hash, "updated").when(drifted, "rebaselined").otherwise("unchanged")


def snapshot_diff(stored: DataFrame, current: DataFrame, schema_version: int = 1, on_schema_change: str = "rebaseline", deletes: bool = True) -> DataFrame:
    """(identity, type, version, hash, data, previous) of every identity on either side.

    ``stored``: identity, version, hash, schema_version, payload; ``current``: identity, version, hash, data.
    """
    s = stored.select("identity", F.col("version").alias("s_version"), F.col("hash").alias("s_hash"), F.col("schema_version").alias("s_schema"), F.col("payload").alias("s_payload"))
    joined = s.join(current, "identity", "full" if deletes else "right")
    joined = joined.withColumn("hash", lazily_hashed(F.col("version"), F.col("s_version"), F.col("s_schema"), schema_version, F.col("s_hash"), F.col("hash")))
    kind = F.coalesce(classified(F.col("s_hash"), F.col("s_schema"), F.col("hash"), schema_version, on_schema_change), F.lit("deleted"))
    gone = F.col("type") == "deleted"
    return joined.withColumn("type", kind).select(
        "identity",
        "type",
        F.when(gone, F.coalesce("s_version", "s_hash")).otherwise(F.col("version")).alias("version"),
        F.when(gone, F.col("s_hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(gone, F.col("s_payload")).otherwise(F.col("data")).alias("data"),
        F.when(F.col("type").isin("updated", "deleted"), F.col("s_payload")).alias("previous"),
    )


def changes(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("type").isin("created", "updated", "deleted"))


def deletes(stored: DataFrame, seen: DataFrame, allowed: bool = True) -> DataFrame:
    """Stored identities that a whole, untruncated listing didn't show; none unless allowed."""
    return (stored if allowed else stored.limit(0)).join(seen.select("identity").distinct(), "identity", "left_anti")


def code_unit_order(c: Column) -> Column:
    """Sorts as UTF-16 code units do."""
    return F.encode(c, "UTF-16BE")


def forced(valid: DataFrame, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of a backfill that exist and didn't change are emitted again."""
    return valid.join(stored.select("identity"), "identity", "left_semi").join(changed.select("identity"), "identity", "left_anti")


def item_rows(current: DataFrame, schema_version: int, seen_at: Column, retain: str = "hash") -> DataFrame:
    payload = F.col("data") if retain == "payload" else F.lit(None).cast("string")
    return current.select("identity", "version", "hash", F.lit(schema_version).alias("schema_version"), payload.alias("payload"), seen_at.alias("seen_at"))


def paged_changes(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Each page sees what earlier pages of the cycle left: the previous hash is the last one of the identity, or the
    stored one on its first page."""
    w = Window.partitionBy("identity").orderBy("page")
    before = F.coalesce(F.lag("hash").over(w), F.col("s_hash"))
    joined = pages.join(stored.select("identity", F.col("hash").alias("s_hash")), "identity", "left").withColumn("before", before)
    kind = F.when(F.col("before").isNull(), "created").when(F.col("before") != F.col("hash"), "updated").otherwise("unchanged")
    return joined.withColumn("type", kind).drop("s_hash", "before")


def buckets(rows: DataFrame, count: int = 256) -> DataFrame:
    """Digests of hash buckets of a snapshot; only differing buckets need a diff. Sums of 52-bit prefixes, order-free."""
    bucket = F.conv(F.substring(F.sha2("identity", 256), 1, 8), 16, 10).cast("long") % count
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "identity", "hash"), 256), 1, 10), 16, 10).cast("decimal(38,0)")
    return rows.select(bucket.alias("bucket"), part.alias("part")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("part").cast("string").alias("digest"))
