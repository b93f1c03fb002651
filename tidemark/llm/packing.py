"""Best-fit packing of tokenised documents by the linear grouping scheme.

A plan needs only how many pieces there are of each length, at most ``capacity`` numbers, so the driver makes it from a
histogram whatever the size of the corpus:

1. Large lengths are put in groups of equal cardinality and rounded up to the longest of their group.
2. Over these few sizes a linear programme over configurations (multisets of sizes that fit a sequence) is solved by
   column generation; whole multiples of its configurations are used and the rest is packed best-fit.
3. Actual lengths replace the rounded ones, which leaves gaps.
4. Small pieces go best-fit into the gaps and, when none is left, into sequences of their own.

The plan is a list of runs: ranks ``lo .. lo + n - 1`` of a length go to sequences ``seq + k // per`` at
``offset + (k % per) * length``. Rows get their rank within a length by counting parts of at most about ``PART`` rows, so
that one length that a third of all rows share is dealt over many tasks, however many rows there are. Parts and plan are
broadcast up to ``MOST_BROADCAST`` rows and joined beyond.

Defined results: a null text counts as empty and is the single end token. Only documents longer than the capacity are
cut; their first piece is the shorter one. Repeated rows are packed once each. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, batches, only, settle

CAPACITY = 2048
END_ID = 0
#: Lengths from this share of the capacity on are large.
LARGE = 1 / 8
GROUPS = 200
ROUNDS = 500
#: Rows of one length that are ranked in one task, about.
PART = 100_000
#: Rows of a plan or of parts, some 50 bytes each, that may be broadcast.
MOST_BROADCAST = 200_000
KEPT_WORDS = 1_200_000
#: Texts that are tokenised together.
TOGETHER = 64
#: A space beside white space on both sides, or at an end: where cutting at spaces isn't where the pattern cuts.
SPACE = re.compile(r"\s")
UNSAFE = re.compile(r"\s \s|\A | \Z")
#: Letters that have long been letters, and a mark behind them: the byte-level pattern cuts between the two, and around a
#: line end between such words.
ENDS = ",.;:!?"
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f]+"
STEM = re.compile(f"{LETTERS}[{ENDS}]?")
LINES = re.compile(f"{LETTERS}[{ENDS}]?(?:\n{LETTERS}[{ENDS}]?)+")


class CachedTokenizer:
    """``tokenizers`` ids as little-endian bytes; words between single spaces are encoded once.

    Behind GPT-2's byte-level pattern a word and the mark behind it, and words on both sides of a line end, are put
    together from their parts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}
        self.edgy: set[str] = set()
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for s, i in vocab.items() if s.startswith("\u0120")]] = True  # how the vocabulary spells a space
        self.breaks = np.zeros(len(self.starts), bool)
        self.breaks[[i for s, i in vocab.items() if s.startswith("\u010a")]] = True  # and a line end
        self.ends = {c: int(vocab[c]).to_bytes(4, "little") for c in ENDS if c in vocab}
        how = json.loads(self.tok.pre_tokenizer.__getstate__()) if self.tok.pre_tokenizer else {}
        byte_level = how.get("type") == "ByteLevel" and how.get("use_regex") and not how.get("add_prefix_space")
        self.parted = bool(byte_level) and self.tok.normalizer is None and len(self.ends) == len(ENDS) and bool(self.breaks.any())

    def _learn(self, fresh: set[str]) -> list[str]:
        """Stores the ids of words behind a space; returns those that go over a line end, which seldom come again."""
        spaced, below, ended, broken, odd = set(), set(), [], [], []
        for w in fresh:
            if self.parted and STEM.fullmatch(w):
                if w[-1] in ENDS:
                    ended.append(w)
                    w = w[:-1]
                if w not in self.words:
                    spaced.add(w)
            elif self.parted and LINES.fullmatch(w):
                broken.append(w)
                first, *rest = w.split("\n")
                if (first := first.rstrip(ENDS)) not in self.words:
                    spaced.add(first)
                below.update(x for x in (r.rstrip(ENDS) for r in rest) if x not in self.lines)
            elif w and not SPACE.search(w):
                spaced.add(w)
            else:
                odd.append(w)
        self.words.update(self._behind(" ", list(spaced), self.starts))
        self.lines.update(self._behind("\n", list(below), self.breaks))
        self.words.update(zip(odd, self._ids([" " + w for w in odd])))
        self.edgy.update(w for w in odd if not w or w[0].isspace() or w[-1].isspace())
        for w in ended:
            self.words[w] = self.words[w[:-1]] + self.ends[w[-1]]
        for w in broken:
            first, *rest = w.split("\n")
            self.words[w] = self._whole(self.words, first) + b"".join(self._whole(self.lines, r) for r in rest)
        return broken

    def _whole(self, store: dict[str, bytes], word: str) -> bytes:
        return store[word[:-1]] + self.ends[word[-1]] if word[-1] in ENDS else store[word]

    def _behind(self, mark: str, words: list[str], starts: np.ndarray, step: int = 2000) -> Iterator[tuple[str, bytes]]:
        """Ids of words behind a space or line end. Many are encoded as one text: no token crosses the mark, and only a word's first has it."""
        odd = []
        for i in range(0, len(words), step):
            some = words[i : i + step]
            ids = np.array(self.tok.encode_batch_fast([mark + mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(starts[ids])
            if len(at) == len(some):
                raw = ids.tobytes()
                cut = [*(4 * at).tolist(), len(raw)]
                yield from zip(some, (raw[a:b] for a, b in zip(cut, cut[1:])))
            else:
                odd += some
        yield from zip(odd, self._ids([mark + w for w in odd]))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        cut = [t.split(" ") for t in texts]
        seen = {w for ws in cut for w in ws[1:]}
        fresh = seen.difference(self.words)
        if len(self.words) + len(self.lines) + len(fresh) > KEPT_WORDS:
            self.words, self.lines, self.edgy, fresh = {}, {}, set(), seen
        broken = self._learn(fresh)
        whole = [any(m in t for m in self.marks) or "" in ws or (not self.edgy.isdisjoint(ws) and bool(UNSAFE.search(t))) for t, ws in zip(texts, cut)]
        heads = self._ids([t if w else ws[0] for t, ws, w in zip(texts, cut, whole)])
        get = self.words.__getitem__
        for head, ws, w in zip(heads, cut, whole):
            yield head if w else head + b"".join(map(get, ws[1:]))
        for w in broken:
            self.words.pop(w, None)


_LOADED: dict[str, CachedTokenizer] = {}
KEPT["packing"] = _LOADED.clear


def loaded(path: str) -> CachedTokenizer:
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length and CRC-32 of its ids (and the ids themselves if asked for)."""
    batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("packing")
        tok = loaded(path)
        for batch in them:
            at, piece, start, length, crc, raw = [], [], [], [], [], []
            texts = batch.column("text").to_pylist()
            each = (tok.texts(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER))
            for row, got in enumerate(chain.from_iterable(each)):
                got += end
                n, lo, k = len(got) // 4, 0, 0
                while lo < n:
                    size = min(capacity, n) if k or n <= capacity or n % capacity == 0 else n % capacity
                    part = got[4 * lo : 4 * (lo + size)]
                    at.append(row)
                    piece.append(k)
                    start.append(lo)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    raw.append(np.frombuffer(part, "<u4") if ids else None)
                    lo += size
                    k += 1
            out = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if ids:
                out.append(pa.array([x.tolist() for x in raw], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


@dataclass
class Run:
    """Equal sequences: how many, what each holds (length, how often), and the free space."""

    n: int
    items: list[tuple[int, int]]
    gap: int


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations over few sizes and how often to use each: the linear programme by column generation.

    Sizes descend. The basis starts with as many of one size as fit; a knapsack over the dual prices gives the column
    that improves most, the ratio test says which one leaves. It ends at the optimum or after ``rounds`` columns.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / (capacity // sizes))
    for k in range(rounds):
        if k % 100 == 99:
            inverse = inverted(basis)
        use = product(inverse, need)
        price = inverse.sum(axis=0)
        column, worth = knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        turn = product(inverse, column)
        up = turn > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(use, 0) / np.where(up, turn, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        pivot = inverse[out] / turn[out]
        inverse = inverse - turn[:, None] * pivot
        inverse[out] = pivot
    use = product(inverted(basis), need)
    return [(basis[:, j].astype(int), float(use[j])) for j in range(m) if use[j] > 0]


def product(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Element by element: threads of a linear algebra library starve beside Spark's on the driver."""
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss and Jordan with row pivots, also element by element."""
    m = len(matrix)
    both = np.concatenate([matrix, np.eye(m)], 1)
    for k in range(m):
        top = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        rest = both[:, k].copy()
        rest[k] = 0
        both -= rest[:, None] * both[k]
    return both[:, m:]


def knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes within the capacity whose prices sum highest, by dynamic programming over capacities."""
    best = np.zeros(capacity + 1)
    took = []
    for s, p in zip(sizes, price):
        counts = np.zeros(capacity + 1, np.int16)
        if p > 1e-12:
            base = best.copy()
            for c in range(1, capacity // s + 1):
                tried = base[: capacity + 1 - c * s] + c * p
                better = tried > best[c * s :]
                best[c * s :][better] = tried[better]
                counts[c * s :][better] = c
        took.append(counts)
    column, at = np.zeros(len(sizes)), capacity
    for j in range(len(sizes) - 1, -1, -1):
        column[j] = took[j][at]
        at -= int(took[j][at] * sizes[j])
    return column, float(best[capacity])


def equal_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Descending (length, count) dealt into groups of equal cardinality; a length may straddle groups."""
    total = sum(n for _, n in lengths)
    each = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = each
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = each
            k = min(n, room)
            out[-1].append((length, k))
            n -= k
            room -= k
    return [g for g in out if g]


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Sequences for so many pieces of each length."""
    lengths = sorted(((k, n) for k, n in histogram.items() if n), reverse=True)
    large = [x for x in lengths if capacity * LARGE <= x[0] < capacity]
    runs = [Run(n, [(k, 1)], 0) for k, n in lengths if k == capacity]
    left: dict[int, int] = {k: n for k, n in lengths if k < capacity * LARGE}
    if large:
        dealt = equal_groups(large, groups) if len(large) > groups else [[x] for x in large]
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in dealt:  # groups that round to the same size are one
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged), np.int64)
        stock = [list(reversed(g)) for g in merged.values()]
        need = np.array([sum(n for _, n in g) for g in merged.values()], float)
        for column, use in sorted(configurations(sizes, need, capacity), key=lambda x: -x[1]):
            times = int(use + 1e-9)
            kinds = [j for j in np.flatnonzero(column) for _ in range(int(column[j]))]
            times = min([times, *(int(sum(n for _, n in stock[j]) // column[j]) for j in set(kinds))])
            while times:
                picked, step, tops = [], times, {}
                for j in kinds:
                    tops[j] = tops.get(j, 0) + 1
                for j, c in tops.items():
                    step = min(step, max(1, stock[j][-1][1] // c))
                for j in kinds:  # one row of stock per slot; a slot that its run can't fill alone is taken singly
                    if step * tops[j] > stock[j][-1][1]:
                        step = 1
                for j in kinds:
                    length, n = stock[j][-1]
                    picked.append((length, 1))
                    stock[j][-1] = (length, n - step)
                    if n == step:
                        stock[j].pop()
                runs.append(Run(step, picked, capacity - sum(x for x, _ in picked)))
                times -= step
        for g in stock:
            for length, n in g:
                left[length] = left.get(length, 0) + n
    best_fit(runs, left, capacity)
    return runs


def best_fit(runs: list[Run], left: dict[int, int], capacity: int) -> None:
    """Longest first, each into the tightest gap that takes it, over runs of equal sequences."""
    gaps: list[tuple[int, int]] = sorted((r.gap, i) for i, r in enumerate(runs) if r.gap)
    for length, n in sorted(left.items(), reverse=True):
        while n:
            k = bisect_left(gaps, (length, -1))
            if k == len(gaps):
                per = min(n, capacity // length)
                i = len(runs)
                runs.append(Run(n // per, [(length, per)], capacity - per * length))
                n -= runs[i].n * per
                if runs[i].gap:
                    insort(gaps, (runs[i].gap, i))
                continue
            gap, i = gaps.pop(k)
            run = runs[i]
            per = min(n, gap // length)
            times = min(run.n, n // per)
            if times < run.n:
                rest = Run(run.n - times, list(run.items), gap)
                runs.append(rest)
                insort(gaps, (gap, len(runs) - 1))
                run.n = times
            run.items.append((length, per))
            run.gap = gap - per * length
            n -= times * per
            if run.gap:
                insort(gaps, (run.gap, i))


def placements(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, how many, per sequence, first sequence, offset) of each run of equal pieces."""
    ranks: dict[int, int] = {}
    out, seq = [], 0
    for run in runs:
        offset = 0
        for length, per in run.items:
            lo = ranks.get(length, 0)
            out.append((length, lo, run.n * per, per, seq, offset))
            ranks[length] = lo + run.n * per
            offset += length * per
        seq += run.n
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, part: int = PART, order: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """``pieces`` (with a column length, 1 to capacity) plus sequence_id and offset."""
    spark = pieces.sparkSession
    totals = dict(map(tuple, pieces.groupBy("length").count().collect()))  # capacity rows at most
    plan = placements(plan_runs(totals, capacity, groups))
    cut = {length: -(-n // part) for length, n in totals.items() if n > part}
    hot = spark.createDataFrame(sorted(cut.items()), "length long, _parts long")  # capacity rows at most
    count = F.coalesce("_parts", F.lit(1))
    dealt = pieces.join(F.broadcast(hot), "length", "left").withColumn("_salt", F.pmod(F.xxhash64(*order), count)).drop("_parts")
    cells = settle(dealt.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    upto = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    if cells.count() <= MOST_BROADCAST:
        before = F.broadcast(before)
    where = spark.createDataFrame(plan, "length long, _lo long, _n long, _per long, _seq long, _offset long")
    if len(plan) <= MOST_BROADCAST:
        where = F.broadcast(where)
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    hit = (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_n"))
    k = F.col("_rank") - F.col("_lo")
    joined = ranked.alias("r").join(where.alias("w"), (F.col("r.length") == F.col("w.length")) & hit)
    return joined.select(
        *(F.col(f"r.{c}") for c in pieces.columns),
        (F.col("_seq") + F.floor(k / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(k, F.col("_per")) * F.col("r.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut what is too long, and place each piece."""
    pieces = settle(tokenised_pieces(docs, path, capacity, end_id, id_col, text_col))
    return pack_pieces(pieces, capacity, order=(id_col, "piece", "start", "ids_crc32"))
