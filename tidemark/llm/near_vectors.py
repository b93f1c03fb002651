"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more have squared distance 2 - 2c at most. A fixed random rotation spreads them evenly;
their coordinates are cut in low-dimensional blocks, and each block gets a part of the squared distance in proportion to
its dimensions. In at least one block a similar pair keeps to its part (pigeonhole), so a range join per block finds it.

The range join compares strips of vectors, rows that each hold many packed vectors, pair by pair in a Cartesian product,
which reads its other side from the checkpoint folder: a vector is dealt and kept once, whatever it is compared with.
Within a pair of strips each block cuts either side into cells of at most ``CELL`` rows, halving the widest of the first
coordinates; only cells whose boxes are near enough meet. Where two vectors meet, the pair is checked against the
block's part; a pair that an earlier block also finds is left to that block, so pairs need no deduplication; the rest is
verified by cosine in double precision. Rows with equal vectors are one node that counts as often as it occurs, so exact
copies cost nothing further. A pair of strips reports counts and a spanning forest of its links, not the pairs.

The table is read twice, and must hold the same rows each time. Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links and are their
own component. Vectors of different lengths don't link. Repeated rows are vectors of their own under one id; a
component's name is its least id, and a null id stays null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, let_go, settle
from .components import connected

COSINE = 0.95
BLOCK_DIMS = 16
GRID_DIMS = 3
#: Rows of a cell at most, bytes of vectors in a strip, and bytes of strips that a task holds of one side.
CELL = 256
STRIP_BYTES = 8 << 20
SIDE_BYTES = 64 << 20
#: Columns of one product of matrices.
COLUMNS = 8192
#: Rounding never loses a pair: every part of the budget is this much larger.
SLACK = 1e-9
#: What single precision may be off by; what it lets through is measured again in double precision.
ROUNDING = 1e-5
STRIP = "strip long, dims int, nodes binary, sizes binary, h1 binary, h2 binary, vectors binary"


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    count = max(1, dims // BLOCK_DIMS)
    edges = np.linspace(0, dims, count + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def parts(dims: int, cosine: float) -> np.ndarray:
    """Each block's part of the squared distance."""
    return np.array([(2 - 2 * cosine) * (b - a) / dims + SLACK for a, b in blocks(dims)])


def rotated(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def usable(v: list | None) -> bool:
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v))


def packed(nodes: DataFrame, strip_bytes: int) -> DataFrame:
    """Rows (node, size, h1, h2, vector) as strips of vectors of one length."""

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, int, int, bytes]]] = {}

        def strip(dims: int) -> pa.RecordBatch:
            *whole, vectors = zip(*held.pop(dims))
            cols = [np.array(c, np.int64).tobytes() for c in whole]
            values = [whole[0][0], dims, *cols, b"".join(vectors)]
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["strip", "dims", "nodes", "sizes", "h1", "h2", "vectors"])

        for batch in them:
            kind = batch.column("vector").type.value_type
            kind = np.float64 if pa.types.is_float64(kind) else np.float32
            whole = [batch.column(c).to_pylist() for c in ("node", "size", "h1", "h2")]
            for *row, v in zip(*whole, batch.column("vector")):
                data = v.values.to_numpy(zero_copy_only=False).astype(kind, copy=False).tobytes()
                dims = len(v.values)
                held.setdefault(dims, []).append((*row, data))
                if len(held[dims]) * len(data) >= strip_bytes:
                    yield strip(dims)
        for dims in list(held):
            yield strip(dims)

    return nodes.mapInArrow(run, STRIP)


def unpacked(strips: DataFrame) -> DataFrame:
    """(h1, h2, node, size) of the strips' rows."""

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], np.int64)) for c in ("h1", "h2", "nodes", "sizes")], names=["h1", "h2", "node", "size"])

    return strips.select("nodes", "sizes", "h1", "h2").mapInArrow(run, "h1 long, h2 long, node long, size long")


def halved(y: np.ndarray, cell: int) -> list[np.ndarray]:
    """Row numbers in cells of at most ``cell``: the widest of the first coordinates is cut at its median."""
    out, todo = [], [np.arange(len(y))]
    while todo:
        at = todo.pop()
        if len(at) <= cell:
            out.append(at)
            continue
        some = y[at, :GRID_DIMS]
        wide = int(np.argmax(np.ptp(some, axis=0)))
        half = len(at) // 2
        order = np.argpartition(some[:, wide], half)
        todo += [at[order[half:]], at[order[:half]]]
    return out


@dataclass
class Cells:
    """A strip's rows in one block's cells: what each holds, its box, and both factors of the squared distances."""

    order: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray


class Strip:
    def __init__(self, nodes: bytes, sizes: bytes, vectors: bytes, dims: int, double: bool, cell: int):
        self.nodes, self.sizes = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64)
        self.raw = np.frombuffer(vectors, np.float64 if double else np.float32).reshape(len(self.nodes), dims)
        self.x = rotated(self.raw)
        self.cells = [self._cells(self.x[:, lo:hi], cell) for lo, hi in blocks(dims)]

    @staticmethod
    def _cells(y: np.ndarray, cell: int) -> Cells:
        each = halved(y, cell)
        order = np.concatenate(each)
        starts = np.cumsum([0, *map(len, each)])
        y = y[order]
        sq = (y * y).sum(1)[:, None]
        one = np.ones_like(sq)
        left, right = np.concatenate([-2 * y, one, sq], 1).astype(np.float32), np.concatenate([y, sq, one], 1).astype(np.float32).T
        return Cells(order, starts, np.minimum.reduceat(y, starts[:-1]), np.maximum.reduceat(y, starts[:-1]), left, np.ascontiguousarray(right))

    def exact(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.raw[at].astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        return v, np.sqrt((v * v).sum(1))


def near_in_block(a: Cells, b: Cells, part: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs whose distance in the block may keep to its part; homes among themselves once."""
    for k in range(len(a.starts) - 1):
        apart = np.maximum(0, np.maximum(a.low[k] - b.high, b.low - a.high[k]))
        meets = np.flatnonzero((apart * apart).sum(1) <= part + ROUNDING)
        if same:
            meets = meets[meets >= k]
        lo, hi = a.starts[k], a.starts[k + 1]
        at = np.concatenate([np.arange(b.starts[m], b.starts[m + 1]) for m in meets]) if len(meets) else meets
        for s in range(0, len(at), COLUMNS):
            some = at[s : s + COLUMNS]
            near = a.left[lo:hi] @ b.right[:, some] <= part + ROUNDING  # squared distances, in one product
            p, q = np.divmod(np.flatnonzero(near), len(some))
            p, q = lo + p, some[q]
            if same:
                p, q = p[p < q], q[p < q]
            yield a.order[p], b.order[q]


def met(a: Strip, b: Strip, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns a, b, n of a pair of strips: counts (node, -1, n), and forest links (node, other, 0)."""
    dims, shift = a.x.shape[1], 0 if same else len(a.nodes)
    budget, first = parts(dims, cosine), [lo for lo, _ in blocks(dims)]
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    count, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    links = []
    for block, part in enumerate(budget):
        for p, q in near_in_block(a.cells[block], b.cells[block], part, same):
            for s in range(0, len(p), 65_536):
                u, v = p[s : s + 65_536], q[s : s + 65_536]
                diff = (a.x[u] - b.x[v]) ** 2
                by = np.add.reduceat(diff, first, axis=1)
                mine = (by[:, block] <= part) & ~(by[:, :block] <= budget[:block]).any(1)
                u, v = u[mine], v[mine]
                if not len(u):
                    continue
                (x, nx), (y, ny) = a.exact(u), b.exact(v)
                fine = (x * y).sum(1) / (nx * ny) >= cosine
                u, v = u[fine], v[fine]
                np.add.at(count, u, b.sizes[v])
                np.add.at(count, shift + v, a.sizes[u])
                links += joined(label, u, shift + v)
    has = np.flatnonzero(count)
    ends = np.array(links, np.int64).reshape(-1, 2)
    none = np.full(len(has), -1)
    return np.concatenate([nodes[has], nodes[ends[:, 0]]]), np.concatenate([none, nodes[ends[:, 1]]]), np.concatenate([count[has], np.zeros(len(ends), np.int64)])


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """The links that join trees; ``label``, each node's tree, is brought up to date."""
    x, y = label[u], label[v]
    apart = np.flatnonzero(x != y)
    if not len(apart):
        return []
    _, once = np.unique(x[apart] * len(label) + y[apart], return_index=True)
    root: dict[int, int] = {}

    def find(s: int) -> int:
        while root.setdefault(s, s) != s:
            root[s] = s = root[root[s]]
        return s

    out = []
    for k in apart[once].tolist():
        s, t = find(int(x[k])), find(int(y[k]))
        if s != t:
            root[max(s, t)] = min(s, t)
            out.append((int(u[k]), int(v[k])))
    to = np.arange(len(label))
    for s in list(root):
        to[s] = find(s)
    label[:] = to[label]
    return out


def strip_links(strips: DataFrame, cosine: float, double: bool, cell: int) -> DataFrame:
    """(a, b, n): how many rows each node links with (b null), and links that connect all that are linked (n 0)."""
    sides = [strips.select(*(F.col(c).alias(f"{side}_{c}") for c in ("strip", "dims", "nodes", "sizes", "vectors"))) for side in "ab"]
    a, b = F.col("a_strip"), F.col("b_strip")
    turn = F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(2)) == 0
    once = (a - b == 0) | ((a - b != 0) & ((a - b < 0) == turn))  # either order of two strips, by chance, so that tasks are alike
    pairs = sides[0].crossJoin(sides[1]).where((F.col("a_dims") - F.col("b_dims") == 0) & once)  # no equality to deal the strips by

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Strip] = {}
        for batch in them:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("a_strip", "b_strip", "a_dims")}
                for s in [s for s in kept if s not in (row["a_strip"], row["b_strip"])]:
                    del kept[s]
                for side in "ab":
                    if row[f"{side}_strip"] not in kept:
                        data = (batch.column(f"{side}_{c}")[k].as_py() for c in ("nodes", "sizes", "vectors"))
                        kept[row[f"{side}_strip"]] = Strip(*data, row["a_dims"], double, cell)
                x, y = kept[row["a_strip"]], kept[row["b_strip"]]
                ends, others, n = met(x, y, cosine, x is y)
                yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(others, mask=others < 0), pa.array(n)], names=["a", "b", "n"])

    return pairs.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def near_vectors(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    batches(table.sparkSession)
    same = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), F.col("vector")).alias("h2")]
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).select("*", *same)
    double = "double" in rows.schema["vector"].dataType.simpleString()
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    nodes = rows.where(fine).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "size", "h1", "h2", "vector")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    total = (rows.where(fine).agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0) * (8 if double else 4)
    tasks = max(cores, -(-total // SIDE_BYTES))
    strips = settle(packed(nodes.coalesce(tasks), max(1, min(STRIP_BYTES, total // (2 * cores)))))
    sides = strips.repartition(cores) if tasks == cores else strips  # a small table may lie in fewer tasks than cores
    found = settle(strip_links(sides, cosine, double, CELL))
    nodes = settle(unpacked(strips))
    let_go(strips)
    counts = found.where("b IS NULL").select(F.col("a").alias("node"), "n")
    labels = connected(found.where("b IS NOT NULL").select("a", "b"))
    marked = nodes.join(labels, "node", "left").join(counts, "node", "left")
    marked = marked.select("h1", "h2", F.coalesce("label", "node").alias("label"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    linked = rows.where(fine).select("id", "h1", "h2").join(marked, ["h1", "h2"]).select("id", "label", "n_links")
    names = linked.groupBy("label").agg(F.min("id").alias("component_id"))
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.join(names, "label").select("id", "n_links", "component_id").unionByName(alone)
    mine = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.coalesce(F.col("id") == mine, F.lit(False)).alias("kept"))
