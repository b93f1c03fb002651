"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

A recording (WAV bytes, 16-bit PCM) is cut in frames; each frame's spectrum is folded into twelve pitch classes. Filters
over a window of frames and classes compare sums of areas, which an integral image gives with four look-ups each. The
quantised answers of sixteen filters, two bits each, make one packed integer a frame. Two recordings are aligned at the
offset at which most of their integers are equal (the histogram's peak); they match if the share of differing bits in
the overlap there is small.

Recordings with equal fingerprints are one class, so copies cost nothing further. Every query is aligned with every
class that shares any integer with it, whatever the lengths: fingerprints are dealt into blocks of about ``BLOCK``
integers, each block of queries meets each block of classes, and one sorted index of the queries' integers gives the
offsets' votes of a whole block. So the result is that of ``align`` on all pairs; the work grows with queries x
recordings, and each class is sent once per block of queries.

Defined results: audio that is null, too short, silent or not PCM WAV has no fingerprint and matches nothing. Repeated
rows are recordings of their own. Of equally good matches the least id is best. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, settle

FRAME, HOP = 512, 128
WINDOW = 16
FILTERS = 16
#: Integers in a block, blocks that a small table has at least, and votes that are counted at once.
BLOCK = 1 << 20
PARTS = 64
VOTES = 1 << 21
MOST_ERRORS = 0.15
LEAST_OVERLAP = 20
#: Cuts of the log ratio of two areas; codes differ in one bit from step to step.
CUTS = np.array([-0.35, 0.0, 0.35])
CODES = np.array([0, 1, 3, 2], np.uint32)


def to_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(samples * 32767, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def from_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return None
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
            return x.reshape(-1, w.getnchannels()).mean(1), w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return None


@lru_cache(maxsize=8)
def folding(rate: int) -> np.ndarray:
    """Which pitch class each spectral line from 60 Hz on belongs to."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hertz), 12), np.float32)
    for k, f in enumerate(hertz):
        if f >= 60:
            out[k, int(round(12 * np.log2(f / 440))) % 12] = 1
    return out


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of unit length."""
    if len(x) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    energy = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ folding(rate)
    return energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-9)


@lru_cache(maxsize=1)
def filters() -> list[tuple[tuple[int, int, int, int], tuple[int, int, int, int]]]:
    """Pairs of areas (first frame, first class, frames, classes) by a rule: halves in time, in pitch, and diagonally."""
    out = []
    for k in range(FILTERS):
        low, high, long = (k * 5) % 8, 2 + k % 3, 4 + 2 * (k % 4)
        if k % 3 == 0:
            out.append(((0, low, long, high), (long, low, long, high)))
        elif k % 3 == 1:
            out.append(((0, low, 2 * long, high), (0, (low + high) % (13 - high), 2 * long, high)))
        else:
            out.append(((0, low, long, high), (long, (low + 4) % (13 - high), long, high)))
    return out


def fingerprint(data: bytes | None) -> np.ndarray | None:
    """Packed integers, one a frame position; None without sound."""
    got = from_wav(data)
    if got is None or not np.any(got[0]):
        return None
    image = chroma(*got)
    n = len(image) - WINDOW + 1
    if n < 1:
        return None
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(a: tuple[int, int, int, int]) -> np.ndarray:
        t, c, w, h = a
        w = min(w, WINDOW - t)
        return (total[at + t + w, c + h] - total[at + t, c + h] - total[at + t + w, c] + total[at + t, c]) / (w * h)

    out = np.zeros(n, np.uint32)
    for one, other in filters():
        ratio = np.log((area(one) + 0.02) / (area(other) + 0.02))
        out = (out << np.uint32(2)) | CODES[np.searchsorted(CUTS, ratio)]
    return out.view(np.int32)


def expanded(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row k repeated ``count[k]`` times, and beside it lo[k], lo[k] + 1, ..."""
    ends = np.cumsum(count)
    return np.repeat(np.arange(len(count)), count), np.arange(ends[-1]) + np.repeat(lo - ends + count, count)


def portions(count: np.ndarray) -> Iterator[slice]:
    """Consecutive rows with at most ``VOTES`` votes together, or one row."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VOTES, "right")))
        yield slice(at, to)
        at = to


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float] | None:
    """Offset of b against a, and the share of differing bits there; None without a common integer or overlap."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = hi - lo
    if not count.sum():
        return None
    histogram = np.zeros(len(a) + len(b) - 1, np.int64)
    for part in portions(count):
        i, at = expanded(lo[part], count[part])
        histogram += np.bincount(i + part.start - order[at] + len(b) - 1, minlength=len(histogram))
    offset = int(np.argmax(histogram)) - len(b) + 1
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(x), len(y))
    if n < LEAST_OVERLAP:
        return None
    return offset, float(np.bitwise_count(x[:n].view(np.uint32) ^ y[:n].view(np.uint32)).sum() / (32 * n))


class Index:
    """The sorted integers of many fingerprints; ``meet`` aligns each of them with another one as ``align`` would."""

    def __init__(self, prints: list[np.ndarray]) -> None:
        self.prints = prints
        self.sizes = np.array([len(f) for f in prints])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(prints)
        order = np.argsort(self.flat, kind="stable")
        self.sorted = self.flat[order]
        self.owner = np.repeat(np.arange(len(prints)), self.sizes)[order]
        self.place = order - self.starts[self.owner]

    def meet(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, offset, errors) of those that match b."""
        lo, hi = np.searchsorted(self.sorted, b, "left"), np.searchsorted(self.sorted, b, "right")
        count = hi - lo
        votes = int(count.sum())
        if not votes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if votes > VOTES:
            got = [(k, x) for k, f in enumerate(self.prints) if (x := align(f, b)) and x[1] <= MOST_ERRORS]
            return np.array([k for k, _ in got], np.int64), np.array([x[0] for _, x in got], np.int64), np.array([x[1] for _, x in got])
        j, at = expanded(lo, count)
        span = int(self.sizes.max()) + len(b)
        keys, n = np.unique(self.owner[at] * span + self.place[at] - j + len(b) - 1, return_counts=True)
        owner = keys // span
        first = np.lexsort((keys, -n, owner))
        which, k = np.unique(owner[first], return_index=True)
        offset = keys[first[k]] - which * span - len(b) + 1
        x, y = np.maximum(offset, 0), np.maximum(-offset, 0)
        long = np.minimum(self.sizes[which] - x, len(b) - y)
        keep = long >= LEAST_OVERLAP
        which, offset, x, y, long = which[keep], offset[keep], x[keep], y[keep], long[keep]
        if not len(which):
            return which, offset, np.zeros(0)
        bits = np.empty(len(which), np.int64)
        for part in portions(long):
            _, p = expanded(self.starts[which[part]] + x[part], long[part])
            _, r = expanded(y[part], long[part])
            bits[part] = np.add.reduceat(np.bitwise_count(self.flat[p].view(np.uint32) ^ b[r].view(np.uint32)).astype(np.int64), np.cumsum(long[part]) - long[part])
        errors = bits / (32 * long)
        good = errors <= MOST_ERRORS
        return which[good], offset[good], errors[good]


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(id, sig, ints) of each row."""
    batches(media.sparkSession)
    rows = media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            got = [fingerprint(x) for x in batch.column("audio").to_pylist()]
            sig = [None if f is None else hashlib.md5(f.tobytes()).digest() for f in got]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sig, pa.binary()), pa.array(got, pa.list_(pa.int32()))], names=["id", "sig", "ints"])

    return rows.mapInArrow(run, f"id {kind}, sig binary, ints array<int>")


def aligned(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """Per asked fingerprint and block of other ones: how many recordings match and the best class (q, n, errors, least, offset)."""
    total = lambda df: df.agg(F.sum(F.size("ints").cast("long"))).first()[0] or 0
    rows, most = -(-total(asked) // BLOCK) or 1, total(classes)
    columns = max(-(-most // BLOCK), min(PARTS, -(-PARTS * most // BLOCK))) or 1
    deal = lambda n: F.pmod(F.xxhash64("sig"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(deal(rows).alias("row"), every(columns).alias("column"), F.col("sig").alias("q"), F.col("ints").alias("fq"))
    right = classes.select(every(rows).alias("row"), deal(columns).alias("column"), F.col("sig").alias("m"), F.col("ints").alias("fm"), F.col("size").alias("copies"), F.col("least").alias("first"))
    kind = classes.schema["least"].dataType.simpleString()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        qs = a.column("q").to_pylist()
        n, best = [0] * len(qs), [None] * len(qs)
        if qs and len(b):
            index = Index([x.values.to_numpy() for x in a.column("fq")])
            for m, ints, size, least in zip(b.column("m").to_pylist(), b.column("fm"), b.column("copies").to_pylist(), b.column("first").to_pylist()):
                for k, offset, errors in zip(*(x.tolist() for x in index.meet(ints.values.to_numpy()))):
                    if qs[k] != m:
                        n[k] += size
                        this = (errors, least is not None, least, offset)
                        best[k] = this if best[k] is None else min(best[k], this)
        got = [k for k, x in enumerate(best) if x]
        columns = ([qs[k] for k in got], [n[k] for k in got], *([best[k][c] for k in got] for c in (0, 2, 3)))
        kinds = (pa.binary(), pa.int64(), pa.float64(), b.schema.field("first").type, pa.int32())
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=["q", "n", "errors", "least", "offset"])

    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(run, f"q binary, n long, errors double, least {kind}, offset int")


def search(media: DataFrame, queries: object, id_col: str = "id", audio_col: str = "audio") -> DataFrame:
    """Per row of the queries (a condition on the id): how many other recordings match, and the best of them.

    Columns: id, n_frames, n_matches, match_id, offset, bit_errors.
    """
    each = settle(fingerprints(media, id_col, audio_col))
    sound = each.where("sig IS NOT NULL")
    classes = settle(sound.groupBy("sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("ints").alias("ints")))
    asked = each.where(queries).select("id", "sig", F.coalesce(F.size("ints"), F.lit(0)).alias("n_frames"))
    heard = asked.where("sig IS NOT NULL").select(F.col("sig").alias("q")).distinct()
    found = aligned(classes.join(heard, F.col("sig") == F.col("q"), "left_semi"), classes)
    best = found.groupBy("q").agg(F.sum("n").alias("n"), F.min(F.struct("errors", "least", "offset")).alias("best"))
    out = asked.join(best.withColumnRenamed("q", "sig"), "sig", "left").join(classes.select("sig", "least", "size"), "sig", "left")
    second = sound.select("sig", F.col("id").alias("other")).join(classes.select("sig", "least"), "sig").where("other <> least").groupBy("sig").agg(F.min("other").alias("second"))
    out = out.join(second, "sig", "left")
    twin = F.when(F.col("size") > 1, F.when(F.col("id") == F.col("least"), F.coalesce("second", "least")).otherwise(F.col("least")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_frames").cast("long").alias("n_frames"),
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).cast("long").alias("n_matches"),
        F.coalesce(twin, F.col("best.least")).alias("match_id"),
        F.when(twin.isNotNull(), 0).otherwise(F.col("best.offset")).alias("offset"),
        F.when(twin.isNotNull(), 0.0).otherwise(F.col("best.errors")).alias("bit_errors"),
    )


RATE, NOTE = 4000, 800
PITCHES = 36


@lru_cache(maxsize=1)
def tones() -> np.ndarray:
    """Samples of each pitch with two overtones, faded at both ends."""
    t = np.arange(NOTE) / RATE
    f = 130.81 * 2 ** (np.arange(PITCHES) / 12)
    wave_ = sum(np.sin(2 * np.pi * f[:, None] * k * t) / k for k in (1, 2, 3))
    return (0.4 * wave_ * np.minimum(1, np.minimum(np.arange(NOTE), np.arange(NOTE)[::-1]) / 60)).astype(np.float32)


def rendered(v: list | None) -> bytes | None:
    """A vector as a tune: every four components choose a note. It stands in for an audio column."""
    if not v or None in v or not np.isfinite(v).all():
        return None
    x = np.array(v[: len(v) // 4 * 4], np.float64).reshape(-1, 4)
    notes = (x.argmax(1) * 9 + x.argmin(1) * 2 + (x[:, 0] > x[:, 3])) % PITCHES if len(x) else np.zeros(0, int)
    return to_wav(tones()[notes].ravel(), RATE)


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, audio): a media column made from a table of vectors."""
    batches(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rendered(v) for v in batch.column(1).to_pylist()], pa.binary())], names=["id", "audio"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"id {kind}, audio binary").withColumnRenamed("id", id_col)
