"""Jaccard join of word shingles by adaptive multi-match prefixes; it gives each document its class of linked copies.

1. *Sets*: the shingles of a text are 64-bit hashes; documents with equal sets become one node, so exact copies cost
   nothing further.
2. *Order*: shingles of rare words come first, by the product of the words' frequencies; but those that a sketch of 2**20
   counters over all documents shows to be frequent come last, by logarithms of their counts. Any fixed order keeps the
   join exact.
3. *Prefixes*: with an l-prefix of n - ceil(t n) + l shingles, two sets of similarity t share at least l of them. Each node
   takes the l from 1 to 3 whose estimated cost is least: the other entries of its prefix's posting lists are read, and
   at most their l-th part is verified. A pair needs the smaller l of the two in common.
4. *Short posting lists* (up to ``LIST`` entries, so an entry meets a bounded number of others) give pairs whose sizes
   fit; those that share enough are verified on whole sets, which are sent once per group of connected pairs.
5. *Long lists* never give pairs. Each goes to its head, the node that meets most others; the nodes of a head's lists are
   compared with the head. Nodes linked to it are done among themselves. Since Jaccard distance is a metric, any other
   node can only link to nodes whose distance from the head differs by at most 1 - t, so it is compared within
   neighbouring rings, in blocks of ``BLOCK`` nodes that are spread over tasks; within rings, only nodes of neighbouring
   sizes meet. A node's set is dealt to the blocks it meets only where that are few (``FEW`` for a ring and size); blocks
   of more populous ones are packed once and meet in a Cartesian product, which reads its other side from the checkpoint
   folder, so disk doesn't grow with the square of a group. Blocks and bins report spanning forests of their links, not all of them. Among the nodes of one ring and
   size that don't link to their head the work still grows with the square of their number.
6. Links make components (no link between different sets is lost); members take the least id.

Defined results: texts without words, and null texts, have an empty set and link with nothing, not even with each
other; fewer words than a shingle make one shingle of all of them. A null id keeps its row with a null component.
Repeated ids are rows of their own under one name. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, batches, let_go, only, settle
from .components import connected

COUNTERS = 1 << 20
CHUNK = 1 << 16
PARTS = 256
EIGHTHS = 8
LEVELS = 3
VERIFY_COST = 8.0
LIST = 64
BLOCK = 256
#: Blocks of one ring and size that others are dealt to by copies; and packed blocks that a task holds of one side.
FEW = 2
SIDE = 64
PAIRS = 2000
GROUP = 500
STEPS = 100_000
KEPT_WORDS = 100_000
FILTER_BITS = 22
MIX = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Words(dict):
    """Hash of each word, kept; the store starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = Words()
KEPT["ngram"] = _WORDS.clear


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[2]
    return x ^ (x >> np.uint64(29))


def hashed(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a text's words and of its shingles in order, and how many words a shingle has; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    if not k:
        return h, h, 0
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = mixed(out * MIX[0] + h[i : len(h) - k + 1 + i] * MIX[1])
    return h, out, k


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes, ascending, of the shingles of a text; words end at ASCII white space."""
    return np.unique(hashed(text, size)[1])


def signature(s: np.ndarray) -> bytes | None:
    return hashlib.md5(s.tobytes()).digest() if len(s) else None


def slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(n * percent / 100): shingles that a set of n shares at least with a similar one."""
    return -(-n * percent // 100)


@dataclass
class Order:
    """How often words and shingles are, in 2**20 counters each: rare ones come first, ties by hash."""

    words: np.ndarray  # logarithm of a counter, EIGHTHS a doubling
    shingles: np.ndarray  # 0 for the load of rare ones, then one more for each doubling

    def first(self, text: str | None, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """A text's distinct shingles, ascending, and its longest prefix in order."""
        h, out, k = hashed(text, size)
        s, at = np.unique(out, return_index=True)
        if not k:
            return s, s
        share = self.words[slot(h)].astype(np.int64)
        score = sum(share[i : len(h) - k + 1 + i] for i in range(k))[at]
        n = len(s)
        most = min(n, n - need(n, percent) + LEVELS)
        rank = self.shingles[slot(s)].astype(np.int64) << 32 | score
        return s, s[np.lexsort((s, rank))[:most]]


def sketched(docs: DataFrame, size: int) -> Order:
    """Counts of all words and shingles; counters travel packed, and are added up in two steps of at most ``PARTS`` groups."""
    chunks = 2 * COUNTERS // CHUNK

    def packed(counts: np.ndarray) -> bytes:
        return zlib.compress(counts.astype("<i8").tobytes(), 1)

    def count(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram")
        counts = np.zeros((2, COUNTERS), np.int64)
        for batch in them:
            met = [(np.empty(0, np.uint64),) * 2, *(hashed(t, size)[:2] for t in batch.column(0).to_pylist())]
            for k in (0, 1):
                counts[k] += np.bincount(slot(np.concatenate([x[k] for x in met])), minlength=COUNTERS)
        part = TaskContext.get().partitionId() % PARTS
        data = [packed(c) for c in counts.reshape(chunks, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([part] * chunks, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for c in group.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), "<i8")
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "part": pa.array([0], pa.int32()), "counts": pa.array([packed(total)], pa.binary())})

    kind = "chunk int, part int, counts binary"
    each = docs.select("text").mapInArrow(count, kind)
    rows = each.groupBy("chunk", "part").applyInArrow(add, kind).groupBy("chunk").applyInArrow(add, kind).collect()  # one row a chunk
    counts = np.zeros((chunks, CHUNK))
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    words, load = counts.reshape(2, COUNTERS)
    usual = np.median(load)
    noise = 4 * np.sqrt(usual) + 4  # what rare shingles that share a counter may add to it by chance
    levels = (np.log2(np.maximum((load - usual) / noise, 0.5)) + 1).astype(np.uint8)
    return Order((EIGHTHS * np.log2(words + 1)).astype(np.uint16), levels)


def prefix_rows(docs: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """Per document: id, signature of its set, the set's size, and its longest prefix in order."""
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(order)  # of fixed size

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram")
        for batch in them:
            got = [shared.value.first(t, size, percent) for t in batch.column("text").to_pylist()]
            prefixes = pa.array([p.view(np.int64) for _, p in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([signature(s) for s, _ in got], pa.binary()), pa.array([len(s) for s, _ in got], pa.int64()), prefixes], names=["id", "md5", "n", "prefix"])

    return docs.mapInArrow(run, f"id {kind}, md5 binary, n long, prefix array<long>")


def postings(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, l, count): prefix entries that other nodes share, each node with the l that costs least."""
    base = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    flat = nodes.select("sig", "n", F.posexplode("prefix").alias("pos", "token"))
    flat = flat.withColumn("level", F.greatest(F.col("pos") - base + 2, F.lit(1)).cast("int"))
    often = flat.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    shared = settle(flat.join(often, "token").select("token", "sig", "n", "level", "count"))
    sums = [F.sum(F.when(F.col("level") <= k, F.col("count") - 1).otherwise(0)).alias(f"s{k}") for k in range(1, LEVELS + 1)]
    most = F.ceil(F.col("n") * percent / 100)
    cost = lambda k: F.when(most >= k, F.col(f"s{k}") * (1 + VERIFY_COST / k))
    costs = F.array(*(F.struct(cost(k).alias("c"), F.lit(k).alias("l")) for k in range(1, LEVELS + 1)))
    chosen = shared.groupBy("sig", "n").agg(*sums).select("sig", F.array_min(F.filter(costs, lambda x: x["c"].isNotNull()))["l"].alias("l"))
    return shared.join(chosen, "sig").where("level <= l").select("token", "sig", "n", "l", "count")


def candidate_pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes with fitting sizes that share as many prefix tokens as the smaller l."""
    a = short.select("token", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("l").alias("la"))
    b = short.select("token", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("l").alias("lb"))
    fit = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    met = a.join(b, "token").where((F.col("a") < F.col("b")) & fit)
    both = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("la", "lb")).alias("least"))
    return both.where("shared >= least").select("a", "b")


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` places occur; executors pack them, the driver gets one row for each ``CHUNK``."""

    def pack(group: pa.Table) -> pa.Table:
        has = np.zeros(CHUNK, bool)
        has[group.column("p").to_numpy() % CHUNK] = True
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "has": pa.array([np.packbits(has).tobytes()], pa.binary())})

    rows = places.distinct().withColumn("chunk", (F.col("p") / CHUNK).cast("int")).groupBy("chunk").applyInArrow(pack, "chunk int, has binary")
    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for r in rows.collect():
        out[r["chunk"]] = np.frombuffer(r["has"], np.uint8)
    return out.ravel()


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(sig, tokens) of the wanted nodes (sig, md5), from the texts once more; a bitmap of fixed size keeps most others out."""
    bits = 1 << FILTER_BITS
    place = F.pmod(F.conv(F.substring(F.hex("md5"), 1, 8), 16, 10).cast("long"), F.lit(bits))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place.alias("p")), bits))

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram")
        known = np.unpackbits(shared.value).astype(bool)
        for batch in them:
            sigs, tokens = [], []
            for t in batch.column(0).to_pylist():
                s = shingles(t, size)
                sig = signature(s)
                if sig is not None and known[int.from_bytes(sig[:4], "big") % bits]:
                    sigs.append(sig)
                    tokens.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], names=["md5", "tokens"])

    found = docs.select("text").mapInArrow(run, "md5 binary, tokens array<long>")
    return settle(found.groupBy("md5").agg(F.first("tokens").alias("tokens")).join(wanted, "md5").select("sig", "tokens"))


class Forest:
    """Union and find; ``add`` tells whether a link joins two trees."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, s: int) -> int:
        root = self.root
        while root.setdefault(s, s) != s:
            root[s] = s = root.setdefault(root[s], root[s])
        return s

    def add(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        self.root[max(x, y)] = min(x, y)
        return x != y


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the pairs' links in each bin.

    Pairs with a common least neighbour are dealt to the same bin, where each set is sent once; the more pairs such a
    neighbour has, the more bins its pairs are cut into, by parts of both ends.
    """
    ends = pairs.select(F.col("a").alias("node"), "b").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("b")))
    labels = settle(ends.groupBy("node").agg(F.min("b").alias("label"), F.count(F.lit(1)).alias("pairs")).select("node", F.least("node", "label").alias("label"), "pairs"))
    parts = labels.groupBy("label").agg(F.ceil(F.sqrt(F.sum("pairs") / PAIRS)).cast("int").alias("k"))
    part = labels.join(parts, "label").select("node", "label", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("part"))
    total = labels.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("ends")).first()
    bins = max(1, total["nodes"] // 500, total["ends"] // (2 * PAIRS))
    at = lambda c: part.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"), F.col("part").alias(f"part_{c}"))
    both = pairs.join(at("a"), "a").join(at("b"), "b")
    label = F.least("label_a", "label_b")
    dealt = settle(both.select("a", "b", F.pmod(F.xxhash64(label, "part_a", "part_b"), F.lit(bins)).cast("int").alias("bin")))
    used = dealt.select(F.col("bin").alias("at"), F.col("a").alias("sig")).union(dealt.select(F.col("bin").alias("at"), "b")).distinct().join(sets, "sig")

    def compare(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        tokens = dict(zip(known["sig"], known["tokens"]))
        forest, out = Forest(), []
        for a, b in zip(asked["a"], asked["b"]):
            if forest.find(a) == forest.find(b):
                continue
            x, y = tokens[a], tokens[b]
            n = len(np.intersect1d(x, y, assume_unique=True))
            if n * 100 >= (len(x) + len(y) - n) * percent and forest.add(a, b):
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("bin").cogroup(used.groupBy("at")).applyInPandas(compare, "a long, b long")


def group_links(long: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among nodes of long posting lists (token, sig, count): each list goes to its head, the node that meets most others.

    All nodes of a head's lists are one group, whose distances from the head are known.
    """
    if long.isEmpty():
        return long.sparkSession.createDataFrame([], "a long, b long")
    weighed = long.join(long.groupBy("sig").agg(F.sum("count").alias("w")), "sig")
    heads = weighed.groupBy("token").agg(F.max_by("sig", F.struct("w", "sig")).alias("pivot"))
    members = asked = settle(long.join(heads, "token").select("pivot", "sig").distinct())
    pivots = members.select("pivot").distinct().join(sets.select(F.col("sig").alias("pivot"), F.col("tokens").alias("tp")), "pivot")
    both = F.size(F.array_intersect("tokens", "tp"))
    union = F.size("tokens") + F.size("tp") - both
    parts = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    members = members.join(parts, "pivot").withColumn("part", part).drop("parts")  # a head's set is sent once for each part of its group
    pivots = pivots.join(parts, "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = members.join(sets, "sig").join(pivots, ["pivot", "part"]).select(F.col("pivot").alias("cluster"), "sig", "pivot", F.size("tokens").alias("n"), both.alias("both"), union.alias("union"))
    linked = F.col("both") * 100 >= F.col("union") * percent
    width = 100 - percent
    # Linked nodes have ring 0, but those at the very threshold ring 1, so that they also meet ring 2.
    ring = F.floor((F.col("union") - F.col("both")) * 100 / (F.col("union") * width)).cast("int")
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")  # similar sizes are at most a step apart
    near = settle(near.select("cluster", "sig", "pivot", linked.alias("linked"), ring.alias("ring"), step.alias("step")))
    let_go(asked)
    first = near.where(F.col("linked") & (F.col("sig") != F.col("pivot"))).select(F.col("sig").alias("a"), F.col("pivot").alias("b"))
    cell = lambda r, s: r * STEPS + s
    placed = near.withColumn("ring", cell(F.col("ring"), F.col("step")))
    sizes = placed.groupBy("cluster", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    per = sizes.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("ring", "k"))).alias("ks"))  # rings by steps: a bounded number
    own = F.pmod(F.xxhash64("sig"), F.col("ks")[F.col("ring")]).cast("int")
    placed = placed.join(per, "cluster").withColumn("block", own)

    def partners(rings: int, steps: int):
        ring = F.col("ring") + cell(rings, steps)
        there = F.coalesce(F.try_element_at("ks", ring), F.lit(0))
        other = F.transform(F.sequence(F.lit(0), there - 1), lambda j: F.struct(ring.alias("ring"), j.cast("int").alias("block")))
        skip = (there == 0) | ((F.col("ring") < STEPS) & (ring < STEPS)) | (F.greatest(F.col("ks")[F.col("ring")], there) > FEW)
        return F.when(skip, F.array().cast("array<struct<ring:int,block:int>>")).otherwise(other)

    here = F.struct(F.col("ring").alias("ring"), F.col("block").alias("block"))
    copies = placed.select("cluster", "sig", here.alias("here"), F.explode(F.concat(*(partners(r, t) for r in (-1, 0, 1) for t in (-1, 0, 1)))).alias("there"))
    keyed = copies.select("cluster", F.least("here", "there").alias("low"), F.greatest("here", "there").alias("high"), (F.col("here") <= F.col("there")).alias("side"), "sig")
    full = keyed.join(sets, "sig").withColumn("key", F.concat_ws(":", F.col("cluster").cast("string"), F.to_json("low"), F.to_json("high")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("sig")
        same = group["same"].iloc[0]
        left = group if same else group[group["side"]]
        right = group if same else group[~group["side"]]
        out = links(list(left["sig"]), list(left["tokens"]), list(right["sig"]), list(right["tokens"]), percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = full.select("key", "sig", "tokens", "side", (F.col("low") == F.col("high")).alias("same")).groupBy("key").applyInPandas(compare, "a long, b long")
    near_cells = [cell(r, t) for r in (-1, 0, 1) for t in (-1, 0, 1)]
    return first.unionByName(found).unionByName(crowded_links(placed, near_cells, sets, percent))


def crowded_links(placed: DataFrame, near_cells: list[int], sets: DataFrame, percent: int) -> DataFrame:
    """Links between blocks of which either is of a ring and size with more than ``FEW`` blocks; each set is packed once."""
    spark = placed.sparkSession
    there = [F.coalesce(F.try_element_at("ks", F.col("ring") + d), F.lit(0)) for d in near_cells]
    crowded = placed.where(F.greatest(*there) > FEW).select("cluster", "ring", "block", F.col("ks")[F.col("ring")].alias("k"), "sig")
    if crowded.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    rows = F.collect_list(F.struct("sig", "tokens")).alias("rows")
    blocks = settle(crowded.join(sets, "sig").groupBy("cluster", "ring", "block").agg(F.first("k").alias("k"), rows))
    blocks = blocks.coalesce(max(spark.sparkContext.defaultParallelism, -(-blocks.count() // SIDE)))
    a, b = (blocks.select(*(F.col(c).alias(f"{x}_{c}") for c in ("cluster", "ring", "block", "k")), F.col("rows.sig").alias(f"{x}_sig"), F.col("rows.tokens").alias(f"{x}_tokens")) for x in "ab")
    apart = F.col("b_ring") - F.col("a_ring")
    later = (apart > 0) | ((apart == 0) & (F.col("a_block") <= F.col("b_block")))
    both_linked = (F.col("a_ring") < STEPS) & (F.col("b_ring") < STEPS)
    meets = apart.isin(near_cells) & later & ~both_linked & (F.greatest("a_k", "b_k") > FEW)
    pairs = a.crossJoin(b).where((F.col("a_cluster") - F.col("b_cluster") == 0) & meets).select("a_sig", "a_tokens", "b_sig", "b_tokens")  # no equality to deal by

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in them:
            for k in range(batch.num_rows):
                sigs = [batch.column(f"{x}_sig")[k].as_py() for x in "ab"]
                tokens = [[t.values.to_numpy() for t in batch.column(f"{x}_tokens")[k].values] for x in "ab"]
                out = [x for x in links(sigs[0], tokens[0], sigs[1], tokens[1], percent) if forest.add(*x)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def links(a: list[int], ta: list[np.ndarray], b: list[int], tb: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks: intersections as products of 0/1 matrices, column by column."""
    if not a or not b:
        return []
    na, nb = np.array([len(t) for t in ta]), np.array([len(t) for t in tb])
    flat = np.concatenate([*ta, *tb])
    owner = np.repeat(np.arange(len(ta) + len(tb)), np.r_[na, nb])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    keep = often[column] > 1
    order = np.argsort(column[keep], kind="stable")
    column, owner = column[keep][order], owner[keep][order]
    column = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
    both = np.zeros((len(ta), len(tb)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(ta) + len(tb), 4096), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        both += m[: len(ta)] @ m[len(ta) :].T
    both = both.astype(np.int64)
    hit = both * 100 >= (na[:, None] + nb[None] - both) * percent
    forest = Forest()
    return [(a[i], b[j]) for i, j in zip(*np.nonzero(hit)) if forest.add(a[i], b[j])]


def near_copies(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable by links)."""
    batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    levels = sketched(rows, size)
    whole = settle(prefix_rows(rows, levels, size, percent))
    nodes = whole.where("md5 IS NOT NULL").groupBy("md5").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("id").alias("least"))
    full = settle(nodes.withColumn("sig", F.monotonically_increasing_id()))
    each, nodes = settle(whole.select("id", "md5", "n")), settle(full.select("sig", "md5", "least"))
    let_go(whole)
    entries = settle(postings(full, percent))
    let_go(full)
    short, long = entries.where(F.col("count") <= LIST), entries.where(F.col("count") > LIST)
    pairs = settle(candidate_pairs(short, percent))
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(long.select("sig")).distinct()
    sets = whole_sets(rows, settle(wanted.join(nodes.select("sig", "md5"), "sig")), size)
    edges = settle(settle(verified(pairs, sets, percent)).unionByName(group_links(long, sets, percent)))
    let_go(sets, pairs, entries)
    labels = connected(edges)
    named = nodes.select("sig", "md5", "least").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    component = named.join(names, "label").select("md5", "component_id")
    joined = each.where("md5 IS NOT NULL").select("id", "md5", "n").join(component, "md5").select("id", "n", "component_id")
    empty = each.where("md5 IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return joined.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
