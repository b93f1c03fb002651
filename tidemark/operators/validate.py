"""Row validation: named checks, issues, and the split by policy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ValidationFailed
from tidemark.functions.canonical import quarantine_id


def with_issues(rows: DataFrame, checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``checks``: message to (path, condition that holds for valid rows). A null condition doesn't hold."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for message, (path, ok) in checks.items()]
    return rows.withColumn("issues", F.array_compact(F.array(*found)))


def split(rows: DataFrame, checks: Mapping[str, tuple[str, Column]], policy: str = "quarantine") -> tuple[DataFrame, DataFrame | None]:
    """Valid rows, and the invalid ones unless the policy is to skip them; ``fail`` raises if there is one."""
    marked = with_issues(rows, checks)
    bad = marked.where(F.size("issues") > 0)
    if policy == "fail" and not bad.isEmpty():
        raise ValidationFailed("rows are invalid", first=bad.first().asDict(recursive=True))
    return marked.where(F.size("issues") == 0).drop("issues"), bad if policy == "quarantine" else None


def parked_rows(bad: DataFrame, text: Column, now: Column) -> DataFrame:
    """Quarantined rows as they are parked."""
    return bad.select(quarantine_id(text).alias("id"), F.lit("invalid").alias("kind"), text.alias("item"), F.to_json("issues").alias("error"), F.lit(0).alias("attempts"), now.alias("parked_at"))
