"""Events from changes: ids, sequences, envelopes and message shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import PREFIX, event_id
from tidemark.functions.lineage import settle
from tidemark.functions.times import iso_column


def numbered(changes: DataFrame, base: int | Column, *order: Column, by: tuple[str, ...]) -> DataFrame:
    """Sequences base + 1, base + 2, ... in order, for many keys ``by`` (feed, partition) that are each of bounded size."""
    start = base if isinstance(base, Column) else F.lit(base)
    w = Window.partitionBy(*by).orderBy(*order)
    return changes.withColumn("sequence", (start + F.row_number().over(w)).cast("long"))


def ranged(changes: DataFrame, base: int, *order: Column | str, ranges: int | None = None, name: str = "sequence") -> tuple[DataFrame, int]:
    """The same for one key of any size, and how many there are: rows are dealt by ranges of the order and sorted there,
    each range starts behind those before it.

    The driver gets one count a range. Dealing is cut with a checkpoint, as a second run might draw other bounds; a row's
    place in its range is what that run gave it, so rows are dealt once. Spark may put small ranges that adjoin together.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [f"_order{k}" for k in range(len(keys))]
    dealt = changes.repartitionByRange(*((ranges, *keys) if ranges else keys)).select("*", *(k.alias(n) for k, n in zip(keys, names))).sortWithinPartitions(*names)
    dealt = settle(dealt.drop(*names).withColumn("_at", F.monotonically_increasing_id()))  # the range, and below it 33 bits of the place
    at, starts = base, []
    for r in sorted(dealt.groupBy(F.shiftright("_at", 33).cast("int").alias("range")).count().collect()):
        starts += [at] * (r["range"] + 1 - len(starts))
        at += r["count"]
    if not starts:
        return dealt.withColumn(name, F.lit(None).cast("long")).drop("_at"), 0
    before = F.get(F.array(*(F.lit(x).cast("long") for x in starts)), F.shiftright("_at", 33).cast("int"))
    return dealt.withColumn(name, before + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at"), at - base


def numbered_by_range(changes: DataFrame, base: int, *order: Column | str, ranges: int | None = None, name: str = "sequence") -> DataFrame:
    """``ranged`` where the count isn't needed."""
    return ranged(changes, base, *order, ranges=ranges, name=name)[0]


def enveloped(changes: DataFrame, feed: str, partition: Column, source: str, schema_version: int, lane: str, now: Column, cursor: Column, prefix: str = PREFIX) -> DataFrame:
    """P5: (id, type, source, subject, time, poller, partition, lane, sequence, cursor, data, previous, attempt)."""
    version = F.coalesce("version", "hash")
    ids = event_id(F.lit(source), partition, F.col("identity"), version, F.lit(schema_version), F.col("type"), prefix=prefix)
    return changes.select(ids.alias("id"), "type", F.lit(source).alias("source"), F.col("identity").alias("subject"), iso_column(now).alias("time"), F.lit(feed).alias("poller"), partition.alias("partition"), F.lit(lane).alias("lane"), "sequence", cursor.alias("cursor"), "data", "previous", F.lit(0).alias("attempt"))


def replayed(log: DataFrame, base: int, order: Column) -> DataFrame:
    """Same ids, new sequences, lane replay, attempt 0."""
    return numbered_by_range(log, base, order).withColumn("lane", F.lit("replay")).withColumn("attempt", F.lit(0))


def outbox_rows(made: DataFrame, now: Column, ordering_key: str = "subject") -> DataFrame:
    """Rows of the outbox for enveloped events; the key that orders deliveries is an SQL expression over them."""
    key = F.coalesce(F.expr(ordering_key).cast("string"), F.col("subject"))
    return made.select(F.col("id").alias("event_id"), "subject", "sequence", F.to_json(F.struct(*made.columns)).alias("event"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at"), key.alias("order_key"))


def attempted(outbox: DataFrame) -> DataFrame:
    """P8."""
    return outbox.withColumn("attempt", F.col("attempts") + 1)


def event_type() -> Column:
    return F.concat_ws(".", "poller", "type")


def cloudevent(prefix: str = "feed") -> Column:
    """CloudEvents 1.0 JSON; ``data`` is JSON text already."""
    text = lambda c: F.to_json(F.struct(c.alias("v")))
    bare = lambda c: F.regexp_extract(text(c), r"(?s)^\{\"v\":(.*)\}$", 1)
    members = [("specversion", F.lit('"1.0"')), ("id", bare(F.col("id"))), ("source", bare(F.col("source"))), ("type", bare(event_type())), ("subject", bare(F.col("subject"))), ("time", bare(F.col("time"))), ("datacontenttype", F.lit('"application/json"')), ("data", F.col("data")), (prefix + "partition", bare(F.col("partition"))), (prefix + "lane", bare(F.col("lane"))), (prefix + "sequence", F.col("sequence").cast("string")), (prefix + "poller", bare(F.col("poller"))), (prefix + "previous", F.col("previous"))]
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in members)), F.lit("}"))


def kafka_binary(events: DataFrame, prefix: str = "feed") -> DataFrame:
    """K8: key, value and ce_ headers in Spark's Kafka layout (headers as JSON-free arrays of name and text)."""
    attributes = [("content-type", F.lit("application/json")), ("ce_specversion", F.lit("1.0")), ("ce_id", F.col("id")), ("ce_source", F.col("source")), ("ce_type", event_type()), ("ce_subject", F.col("subject")), ("ce_time", F.col("time")), (f"ce_{prefix}partition", F.col("partition")), (f"ce_{prefix}lane", F.col("lane")), (f"ce_{prefix}sequence", F.col("sequence").cast("string")), (f"ce_{prefix}poller", F.col("poller"))]
    headers = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in attributes))
    kept = F.filter(headers, lambda h: h["value"].isNotNull() & (F.length(h["value"]) > 0))
    return events.select(F.col("subject").alias("key"), F.coalesce("data", F.lit("null")).alias("value"), kept.alias("headers"))


def kafka_structured(events: DataFrame, prefix: str = "feed") -> DataFrame:
    headers = F.array(F.struct(F.lit("content-type").alias("key"), F.lit("application/cloudevents+json").cast("binary").alias("value")))
    return events.select(F.col("subject").alias("key"), cloudevent(prefix).alias("value"), headers.alias("headers"))


def sqs_message(events: DataFrame, queue_url: str, fifo: bool = True, group: Column | None = None) -> DataFrame:
    """K7."""
    attributes = F.create_map(F.lit("poller"), F.col("poller"), F.lit("type"), F.col("type"), F.lit("contentType"), F.lit("application/cloudevents+json"))
    extra = [F.col("id").alias("MessageDeduplicationId"), (group if group is not None else F.col("subject")).alias("MessageGroupId")] if fifo else []
    return events.select(F.lit(queue_url).alias("QueueUrl"), cloudevent().alias("MessageBody"), attributes.alias("MessageAttributes"), *extra)


def queue_job(events: DataFrame) -> DataFrame:
    """K6."""
    return events.select(event_type().alias("name"), cloudevent().alias("payload"), F.col("id").alias("job_id"))


def once(events: DataFrame) -> DataFrame:
    """Consumers keep one event per id, the first by sequence."""
    others = [c for c in events.columns if c != "id"]
    first = F.min_by(F.struct(*others), F.col("sequence")).alias("_e")
    return events.groupBy("id").agg(first).select("id", *(F.col(f"_e.{c}").alias(c) for c in others))


def latest_state(events: DataFrame) -> DataFrame:
    """The newest event of each subject, deleted ones dropped."""
    newest = events.groupBy("subject").agg(F.max_by(F.struct("type", "data", "sequence"), F.col("sequence")).alias("e"))
    return newest.where(F.col("e.type") != "deleted").select("subject", F.col("e.data").alias("data"), F.col("e.sequence").alias("sequence"))


def order_violations(deliveries: DataFrame, key: str = "subject", position: str = "position") -> DataFrame:
    """Deliveries whose sequence isn't above the one before of the same key."""
    w = Window.partitionBy(key).orderBy(position)
    return deliveries.withColumn("before", F.lag("sequence").over(w)).where(F.col("sequence") <= F.col("before")).drop("before")


def lifecycle(events: DataFrame) -> DataFrame:
    """Of each event whether its type may follow the one before of its subject."""
    before = F.lag("type").over(Window.partitionBy("subject").orderBy("sequence"))
    first = before.isNull() | (before == "deleted")
    fine = F.when(first, F.col("type") == "created").otherwise(F.col("type").isin("updated", "deleted"))
    return events.withColumn("before", before).withColumn("allowed", fine)


def redeliveries(deliveries: DataFrame, retained: bool = True) -> DataFrame:
    """Of each delivery after the first of its event what is wrong with it, if anything.

    A second delivery may only repeat: the same id stands for the same subject, type and data. One whose sequence is that
    of an earlier delivery is a retry, one with a higher sequence a replay.
    """
    w = Window.partitionBy("id").orderBy("position")
    first = F.first(F.struct("subject", "type", "data", "sequence")).over(w)
    seen = deliveries.withColumn("_first", first).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_first.{c}"))
    problem = F.when(~same("subject"), "subject").when(~same("type"), "type").when(F.lit(retained) & ~same("data"), "data")
    kind = F.when(F.col("sequence") == F.col("_first.sequence"), "retry").when(F.col("sequence") > F.col("_first.sequence"), "replay").otherwise("backwards")
    return seen.select("id", "position", kind.alias("kind"), problem.alias("problem"))


def kill_tally(kills: DataFrame, point: str = "point") -> DataFrame:
    """How often each kill point was hit."""
    return kills.groupBy(point).agg(F.count(F.lit(1)).alias("kills"))


def convergence(source: DataFrame, state: DataFrame) -> DataFrame:
    """Subjects whose delivered state differs from the source, or that one side lacks."""
    s, d = source.select("subject", F.col("data").alias("wanted")), state.select("subject", F.col("data").alias("got"))
    both = s.join(d, "subject", "full")
    problem = F.when(F.col("wanted").isNull(), "extra").when(F.col("got").isNull(), "missing").when(F.col("wanted") != F.col("got"), "differs")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("subject", "problem")
