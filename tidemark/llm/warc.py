"""WARC archives with segmented, chunked and revisited records, and their reassembly.

Writing: a row becomes a record of an HTTP response whose body is framed in chunks. A block longer than
``segment_bytes`` is cut: the first segment is the response record, the rest are continuation records that name its
identifier, their number and, in the last one, the total length. Each record is a gzip member of its own; the members of
a task, in order, are one archive. Of equal payloads of at least ``revisit_bytes`` only the row with the largest id is a
response, the others are revisit records without payload.

Reading: continuation records are grouped by origin identifier, ordered by segment number, checked for gaps and for
the total length, joined, and the chunked framing is taken off. The payload must have the digest that its record states.
Only segments of one record meet in a group, so a group is as large as one page.

Defined results: a null payload is an empty one. A null id is written as such and read back as null; among equal
payloads it never is the largest. Repeated rows give repeated records, and where such a row is the largest, each of its
copies is a response. An empty table gives no records. Extra columns are ignored. Records of others are read too:
payload digests in base 32 or hex are verified, other digests are not; blocks without an HTTP head are payloads as they
are; a revisit without one has no size. A row of archive data must hold whole gzip members, and is as large as one value.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, settle

REVISIT_BYTES = 1000
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
#: Rows of one payload that go to one task, about.
PART = 1_000_000
#: Groups of equal payloads that may be broadcast; their rows have about 60 bytes.
MOST_BROADCAST = 50_000
CRLF = b"\r\n"
RECORD = "archive long, ordinal long, data binary"
PARSED = "record_id string, kind string, number int, origin string, total long, refers string, digest string, full_bytes long, block binary"


class BrokenRecord(ValueError):
    """A record, its segments or its framing are not as stated."""


def framed(payload: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer coding."""
    out = []
    for i in range(0, len(payload), chunk):
        part = payload[i : i + chunk]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def unframed(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, anything else wrong is an error."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise BrokenRecord("a chunk has no size line")
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"?", 16)
        except ValueError:
            raise BrokenRecord("a chunk's size is not a number") from None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != CRLF:
            raise BrokenRecord("a chunk is shorter or longer than stated")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, uri: str, block: bytes, *more: tuple[str, object]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), *more, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode("utf-8") + CRLF + block + CRLF + CRLF, 1, mtime=0)


def page_records(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page; ``revisit_of`` names the page that has the payload."""
    sha = hashlib.sha1(payload)
    digest = "sha1:" + base64.b32encode(sha.digest()).decode()
    name = lambda p: f"urn:page:{'' if p is None else p}:{sha.hexdigest()}"
    uri = " ".join((url or "").split())
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    stated = ("WARC-Payload-Digest", digest)
    if revisit_of is not None:
        block = status + b"Content-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", name(page_id), uri, block, stated, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{name(revisit_of)}>"))
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + framed(payload)
    if len(block) <= segment:
        yield record("response", name(page_id), uri, block, stated)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record("response", name(page_id), uri, parts[0], stated, ("WARC-Segment-Number", 1))
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield record("continuation", f"{name(page_id)}#{k}", uri, part, ("WARC-Segment-Number", k), ("WARC-Segment-Origin-ID", f"<{name(page_id)}>"), *last)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of the records in gzip members laid end to end."""
    while data:
        d = zlib.decompressobj(31)
        raw = d.decompress(data) + d.flush()
        data = d.unused_data
        at = 0
        while at < len(raw):
            end = raw.find(b"\r\n\r\n", at)
            if end < 0 or not raw.startswith(b"WARC/", at):
                raise BrokenRecord("no record begins where one should")
            lines = raw[at:end].decode("utf-8").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(head["content-length"])
            block = raw[end + 4 : end + 4 + size]
            if len(block) != size or raw[end + 4 + size : end + 8 + size] != CRLF + CRLF:
                raise BrokenRecord("a block is shorter or longer than stated")
            yield head, block
            at = end + 8 + size


def http_body(block: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise BrokenRecord("a block has no HTTP head")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return fields, unframed(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def stated_sha1(text: str) -> str | None:
    """Lower-case hex of a stated SHA-1 in base 32 or hex; None where none, or another digest, is stated."""
    kind, _, value = text.partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 40:
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        raise BrokenRecord(f"{text} is not a digest") from None


def payload_of(kind: str, block: bytes) -> bytes:
    """What a record carries: the body of an HTTP message, else (warcinfo, resource, metadata, ...) the block itself."""
    return http_body(block)[1] if kind in ("response", "request") or block.startswith(b"HTTP/") else block


def joined(segments: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of a segmented record: numbers 1 to n without gap, and the stated total length."""
    segments = sorted(segments, key=lambda s: s[0])
    if [n for n, _ in segments] != list(range(1, len(segments) + 1)):
        raise BrokenRecord("segments are missing or repeated")
    block = b"".join(b for _, b in segments)
    if total is None or len(block) != total:
        raise BrokenRecord(f"segments have {len(block)} bytes, {total} are stated")
    return block


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Records (archive, ordinal, data) of all rows, kept in the shared checkpoint folder.

    Which row of equal payloads is the response is found from digests alone. Few groups of equal payloads are
    broadcast; beyond ``MOST_BROADCAST`` the rows are dealt by digest and a salt, as many as the payload's rows ask for, so that
    a payload which a third of all rows share is spread over tasks.
    """
    batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", F.when(F.col("size") >= revisit_bytes, F.sha1("payload")))
    equal = (
        keyed.where(F.col("digest").isNotNull() & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
        .drop("n")
    )
    equal = settle(equal)
    if equal.count() <= MOST_BROADCAST:
        marked = keyed.join(F.broadcast(equal), "digest", "left")
    else:
        hot = settle(equal.where("parts > 1").select("digest", "parts"))
        hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
        spread = equal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        salt = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")
        marked = keyed.join(hot, "digest", "left").withColumn("salt", salt).join(spread, ["digest", "salt"], "left")
    lost = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    marked = marked.select("page_id", "url", "payload", F.when(lost, F.col("winner")).alias("revisit_of"), F.spark_partition_id().cast("long").alias("archive"))

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = 0
        for batch in them:
            archive, data = [], []
            for p, u, x, r, a in zip(*(c.to_pylist() for c in batch.columns)):
                made = list(page_records(p, u, x, r, segment_bytes))
                data += made
                archive += [a] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(archive, pa.int64()), pa.array(range(ordinal, ordinal + len(data)), pa.int64()), pa.array(data, pa.binary())], names=["archive", "ordinal", "data"])
            ordinal += len(data)

    return settle(marked.mapInArrow(run, RECORD))


def read_records(archives: DataFrame, data_col: str = "data") -> DataFrame:
    """Parsed records of archive files or parts of them: any rows of whole gzip members."""

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            out = []
            for data in batch.column(0).to_pylist():
                for head, block in parsed(data):
                    bare = lambda k: head.get(k, "").strip("<>") or None  # noqa: B023, E731
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    has_head = head["warc-type"] == "revisit" and block.startswith(b"HTTP/")
                    full = int(http_body(block)[0].get("content-length", -1)) if has_head else None
                    out.append((bare("warc-record-id"), head["warc-type"], number("warc-segment-number"), bare("warc-segment-origin-id"), number("warc-segment-total-length"), bare("warc-refers-to"), stated_sha1(head.get("warc-payload-digest", "")), full, block))
            cols = list(zip(*out)) if out else [[]] * 9
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in PARSED.split(", ")])

    return archives.select(data_col).mapInArrow(run, PARSED)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: record_id, kind, refers, digest, and the payload with its size; checked as the module says.

    Equal records (of repeated rows) come out as often as they went in.
    """
    keep = ("record_id", "kind", "refers", "digest", "full_bytes")
    whole = records.where(F.col("number").isNull()).select(*keep, F.lit(None).cast("long").alias("total"), F.array(F.struct(F.lit(1).alias("number"), "block")).alias("segments"))
    first = F.col("number") == 1
    cut = (
        records.where(F.col("number").isNotNull())
        .groupBy(F.coalesce("origin", "record_id").alias("record_id"))
        .agg(
            F.coalesce(F.max(F.when(first, F.col("kind"))), F.lit("lost")).alias("kind"),
            F.max("digest").alias("digest"),
            F.max("total").alias("total"),
            F.collect_set(F.struct("number", "block")).alias("segments"),
            F.greatest(F.count(F.when(first, 1)), F.lit(1)).cast("int").alias("copies"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("record_id", "kind", F.lit(None).cast("string").alias("refers"), "digest", F.lit(None).cast("long").alias("full_bytes"), "total", "segments")
    )

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            ids, kinds, refers, digests, full, totals, segments = (c.to_pylist() for c in batch.columns)
            sizes, payloads = [], []
            for rid, kind, digest, size, total, segs in zip(ids, kinds, digests, full, totals, segments):
                pairs = [(s["number"], s["block"]) for s in segs]
                block = pairs[0][1] if total is None and len(pairs) == 1 and kind != "lost" else joined(pairs, total)
                if kind == "revisit":
                    sizes.append(size)
                    payloads.append(None)
                    continue
                payload = payload_of(kind, block)
                if digest and hashlib.sha1(payload).hexdigest() != digest:
                    raise BrokenRecord(f"{rid}: the payload is not the one stated")
                sizes.append(len(payload))
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary())], names=["record_id", "kind", "refers", "digest", "payload_bytes", "payload"])

    return whole.unionByName(cut).mapInArrow(run, "record_id string, kind string, refers string, digest string, payload_bytes long, payload binary")


def page_digests(pages: DataFrame, **options: object) -> DataFrame:
    """Write, read back, and tell of each page what its record holds."""
    back = reassemble(read_records(write_archives(pages, **options)))
    page = lambda c: F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    return back.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(F.when(F.col("kind") == "revisit", F.col("digest")), F.sha1("payload")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page("refers").alias("refers_to"),
    )
