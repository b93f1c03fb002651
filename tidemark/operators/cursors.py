"""Incremental scans over DataFrames: keyset, page, token and snapshot (S3 to S7, W1 to W4, W13, A1, A10, N5, N6, T-1 to T-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import format_timestamp_column
from tidemark.operators.events import numbered_by_range


def keyset(rows: DataFrame, at: str, tie: str, since: Column | None, after: Column | None) -> DataFrame:
    """Rows behind (since, after); without a tie value, rows of the same time come again; without since, all."""
    if since is None:
        return rows
    if after is None:
        return rows.where(F.col(at) >= since)
    return rows.where((F.col(at) > since) | ((F.col(at) == since) & (F.col(tie) > after)))


def keyset_page(rows: DataFrame, at: str, tie: str, since: Column | None, after: Column | None, size: int = 100) -> DataFrame:
    """S3, O1: the next page in order; a page is a feature, so the limit is."""
    return keyset(rows, at, tie, since, after).orderBy(at, tie).limit(size)


def paged(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Page numbers from 1, and whether more follow; ranges of the order are counted apart."""
    total = rows.count()
    numbered = numbered_by_range(rows, 0, *order, name="_place")
    return numbered.withColumn("page", F.ceil(F.col("_place") / size).cast("long")).withColumn("has_more", F.col("page") * size < total).drop("_place")


def tokens(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """One row per page: offset, and the next offset or null at the end."""
    total = rows.count()
    pages = max(1, -(-total // size))
    page = F.col("id")
    after = (page + 1) * size
    return rows.sparkSession.range(pages).select((page * size).alias("offset"), F.when(after < total, after).alias("next_offset"))


def fresh_enough(rows: DataFrame, ms: Column, now: int, lag_ms: int = 0) -> DataFrame:
    """Too fresh rows wait for the next cycle; rows without a readable time stay."""
    return rows.where(ms.isNull() | (ms <= now - lag_ms))


def overlap_start(value: Column, ms: Column, overlap_ms: int) -> Column:
    """The first request of a cycle starts earlier, without tie."""
    return format_timestamp_column(ms - overlap_ms, value)


def watermark(rows: DataFrame, raw: str, ms: Column, tie: str | None = None, position: str | None = None) -> DataFrame:
    """A1: the largest time as it was written (the first seen of equal times), and the largest tie among them."""
    order = F.struct(ms.alias("ms"), (-F.col(position) if position else F.lit(0)).alias("p"))
    out = [F.max_by(F.col(raw), F.when(ms.isNotNull(), order)).alias("value"), F.max(ms).alias("ms")]
    if tie:
        out.append(F.max(F.when(ms.isNotNull(), F.struct(ms.alias("ms"), F.col(tie).alias("t"))))["t"].alias("tie"))
    return rows.agg(*out)


def lag_ms(now: Column, ms: Column) -> Column:
    """A10."""
    return now - ms


def reached(ms: Column, target_ms: Column) -> Column:
    """W13 for timestamps: no target is always reached, no cursor never."""
    return F.when(target_ms.isNull(), True).when(ms.isNull(), False).otherwise(ms >= target_ms)


def between(rows: DataFrame, at: str, start: Column | None, end: Column | None) -> DataFrame:
    """The bounded range of a backfill, both ends included."""
    out = rows if start is None else rows.where(F.col(at) >= start)
    return out if end is None else out.where(F.col(at) <= end)
