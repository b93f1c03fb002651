"""A stream as a feed: each micro-batch is diffed against the snapshot and committed once (T-1 to T-8).

The stream's offsets are the watermark; a batch that was committed before a crash is skipped by its number. Late rows
aren't dropped: the snapshot join decides what changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators import diff, events
from tidemark.spec import FeedSpec
from tidemark.state.manifest import ManifestStore


def committed(spec: FeedSpec, store: ManifestStore, key: tuple[str, str], clock, query: str = "stream"):
    """The function for ``foreachBatch``."""

    def batch(rows: DataFrame, number: int) -> None:
        now = clock()
        if store.record(key)["batches"].get(query, -1) >= number:
            return
        position = "_position" if "_position" in rows.columns else None
        found = diff.last_wins(spec.candidates(rows, position), "identity", "_pos").drop("_pos")
        changed = diff.snapshot_diff(store.read(key, "items"), found, spec.schema_version, spec.on_schema_change, deletes=False).persist()
        base = (store.state(key) or {}).get("sequence", 0)
        numbered = events.numbered_by_range(diff.changes(changed), base, diff.code_unit_order(F.col("identity")))
        made = events.enveloped(numbered, spec.name, F.lit(key[1]), spec.urn, spec.schema_version, "live", F.lit(now), F.lit(str(number))).persist()
        out = events.outbox_rows(made, F.lit(now), spec.delivery.ordering_key)
        items = diff.item_rows(changed.where(F.col("type").isin("created", "updated", "rebaselined")), spec.schema_version, F.lit(now), spec.retain)
        patch = {"sequence": base + made.count(), "waiting": True}
        store.commit(key, None, patch, now, {"items": items, "outbox": out, "log": out.select("sequence", "event", "created_at")}, batch=(query, number))
        store.compact(key, "items")
        changed.unpersist()
        made.unpersist()

    return batch


def follow(stream: DataFrame, spec: FeedSpec, store: ManifestStore, checkpoint: str, clock, partition: str = "", query: str = "stream") -> DataStreamWriter:
    return stream.writeStream.foreachBatch(committed(spec, store, (spec.name, partition), clock, query)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
