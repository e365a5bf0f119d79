"""Exact k-means over integer vectors with heap-ordered bounds.

A vector's gap is the distance to its second nearest centroid minus that to
its own, both when it was last scanned.  When centroids move, the gap of a
vector of cluster c shrinks by no more than the move of c plus the largest
move among the others; the sum of those over the rounds is the drift of c.  A
gap is stored with the drift of its cluster added, so that it never has to be
touched: it has expired once the drift has caught up with it.  Each cluster
keeps a heap of its stored gaps, least first, pops what has expired and leaves
the rest alone.  Only popped vectors are compared with all centroids, exactly.

Vectors lie in blocks of bounded size, dealt as they were read; a block holds
a heap and exact sums per cluster.  A round is one pass over the blocks without
a shuffle; k centroids and k drifts go out, one sum per centroid component
comes back.  The blocks are written after every round, so a lost executor
repeats tasks of one round only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import materialize

COMPONENTS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
BLOCK_ROWS = 1 << 14
LARGEST = 1 << 27  # of a component: all squared distances fit in a long
_FLOAT_EXACT = 1 << 21  # up to here products and sums are exact in doubles
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


# ---- one block ---------------------------------------------------------------

def integer_vectors(column: pa.Array, components: int = COMPONENTS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integer vectors): exactly ``components`` components, none null or non-finite."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), components), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    values = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64)
    values = values.reshape(-1, components)
    finite = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        out = np.floor(scale * values[finite])
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"components times {scale} must not exceed {LARGEST}, else distances don't fit in a long")
    return at[finite], out.astype(np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row per vector."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _FLOAT_EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, gap): ties go to the smaller number; the gap is rounded down, infinite with one centroid."""
    d = squared_distances(x, centroids)
    best = d.argmin(axis=1)
    rows = np.arange(len(x))
    own = np.sqrt(d[rows, best].astype(np.float64))
    if d.shape[1] == 1:
        return best, np.full(len(x), np.inf)
    d[rows, best] = np.iinfo(np.int64).max
    return best, np.sqrt(d.min(axis=1).astype(np.float64)) * _DOWN - own * _UP


class Members:
    """Clusters of one block's vectors: a heap of ``(gap + drift, vector)``, the sum of vectors and their number per cluster."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors = vectors
        self.cluster = np.full(len(vectors), -1, np.int64)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        self.sums = np.zeros((k, vectors.shape[1]), np.int64)
        self.counts = np.zeros(k, np.int64)

    def start(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Scan all vectors."""
        self._scan(np.arange(len(self.vectors)), centroids, drift)

    def advance(self, centroids: np.ndarray, drift: np.ndarray) -> int:
        """Scan the vectors whose gap has expired; their number."""
        expired: list[int] = []
        for heap, d in zip(self.heaps, drift.tolist()):
            while heap and heap[0][0] * _DOWN - 1e-9 <= d:
                expired.append(heappop(heap)[1])
        self._scan(np.array(expired, np.int64), centroids, drift)
        return len(expired)

    def _scan(self, at: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> None:
        if not len(at):
            return
        best, gap = nearest(self.vectors[at], centroids)
        key = gap + drift[best]
        for c in np.unique(best).tolist():
            mine = np.flatnonzero(best == c)
            entries = list(zip(key[mine].tolist(), at[mine].tolist()))
            heap = self.heaps[c]
            if len(entries) > len(heap):
                heap += entries
                heapify(heap)
            else:
                for e in entries:
                    heappush(heap, e)
        moved = best != self.cluster[at]
        at, best = at[moved], best[moved]
        for to, sign in ((self.cluster[at], -1), (best, 1)):
            for c in np.unique(to[to >= 0]).tolist():
                self.sums[c] += sign * self.vectors[at[to == c]].sum(axis=0)
                self.counts[c] += sign * int((to == c).sum())
        self.cluster[at] = best

    def pack(self) -> list[bytes]:
        """State columns: cluster, heap keys, heap vectors, heap sizes, sums, counts."""
        entries = [e for h in self.heaps for e in h]
        return [x.tobytes() for x in (
            self.cluster.astype(np.int32), np.array([e[0] for e in entries], np.float64), np.array([e[1] for e in entries], np.int32),
            np.array([len(h) for h in self.heaps], np.int32), self.sums, self.counts)]

    @classmethod
    def unpack(cls, vectors: np.ndarray, state: list[bytes]) -> Members:
        kinds = (np.int32, np.float64, np.int32, np.int32, np.int64, np.int64)
        cluster, keys, items, sizes, sums, counts = (np.frombuffer(b, t) for b, t in zip(state, kinds))
        out = cls(vectors, len(sizes))
        out.cluster[:] = cluster
        cut = np.cumsum([0, *sizes])
        out.heaps = [list(zip(keys[a:b].tolist(), items[a:b].tolist())) for a, b in zip(cut[:-1], cut[1:])]
        out.sums[:] = sums.reshape(out.sums.shape)
        out.counts[:] = counts
        return out


# ---- blocks ------------------------------------------------------------------

_STATE = ["cluster", "heap_keys", "heap_items", "heap_sizes", "sums", "counts"]


def _narrow(x: np.ndarray) -> np.ndarray:
    """The vectors in the narrower of two integer types that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32)


def _wide(data: pa.Scalar, rows: int) -> np.ndarray:
    raw = data.as_buffer()
    kind = np.int16 if raw.size == 2 * COMPONENTS * rows else np.int32
    return np.frombuffer(raw, kind).reshape(rows, COMPONENTS).astype(np.int64)


def vector_blocks(rows: DataFrame, id_col: str, vector_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(ids, vectors)``: the kept vectors in blocks, written once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        kept: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            offsets = pa.array([0, len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets, keys), pa.array([_narrow(np.concatenate(kept)).tobytes()], pa.binary())],
                ["ids", "vectors"])

        for b in batches:
            for lo in range(0, b.num_rows, block_rows):
                part = b.slice(lo, block_rows)
                at, x = integer_vectors(part.column("v"))
                if len(at):
                    ids.append(part.column("id").take(pa.array(at)))
                    kept.append(x)
                    n += len(at)
                if n >= block_rows:
                    yield flush()
                    ids, kept, n = [], [], 0
        if n:
            yield flush()

    source = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = source.schema["id"].dataType.simpleString()
    return materialize(source.mapInArrow(gather, f"ids array<{kind}>, vectors binary"), "vector-blocks")


def first_centroids(blocks: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hash of ``seed:id``, in that order; equal hashes by components.

    A block names its own k smallest, so k rows come to the driver.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, vectors in zip(b.column("ids"), b.column("vectors")):
                x = _wide(vectors, len(ids.values))
                keys = [sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids.values.to_pylist()]
                best = sorted(zip(keys, map(tuple, x.tolist())))[:k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))], ["h", "v"])

    drawn = blocks.mapInArrow(draw, "h string, v array<long>").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in drawn], np.int64)


def _round(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """All blocks with their vectors assigned to ``centroids``, written."""
    first = "cluster" not in blocks.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m = _members(b, i, len(centroids), first)
                (m.start if first else m.advance)(centroids, drift)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids").slice(i, 1), b.column("vectors").slice(i, 1), *(pa.array([x], pa.binary()) for x in m.pack())],
                    ["ids", "vectors", *_STATE])

    kind = blocks.schema["ids"].dataType.simpleString()
    schema = f"ids {kind}, vectors binary, " + ", ".join(f"{c} binary" for c in _STATE)
    return materialize(blocks.mapInArrow(assign, schema), "cluster-state")


def _members(b: pa.RecordBatch, i: int, k: int, first: bool) -> Members:
    x = _wide(b.column("vectors")[i], len(b.column("ids")[i].values))
    return Members(x, k) if first else Members.unpack(x, [b.column(c)[i].as_buffer() for c in _STATE])


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the clusters; empty clusters stay.

    A task adds up its blocks, Spark adds up the tasks, one row per centroid
    and component comes to the driver.
    """
    k, d = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), np.int64)
        for b in batches:
            for sums, counts in zip(b.column("sums"), b.column("counts")):
                total[:, :d] += np.frombuffer(sums.as_buffer(), np.int64).reshape(k, d)
                total[:, d] += np.frombuffer(counts.as_buffer(), np.int64)
        c, j = np.divmod(np.arange(total.size), d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(j), pa.array(total.ravel())], ["c", "j", "n"])

    sums = [[0] * (d + 1) for _ in range(k)]
    per_task = blocks.select("sums", "counts").mapInArrow(add, "c long, j long, n long")
    for r in per_task.groupBy("c", "j").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect():
        sums[r["c"]][r["j"]] = int(r["n"])
    return np.array([[s // row[d] for s in row[:d]] if row[d] else old for row, old in zip(sums, centroids.tolist())], np.int64)


def cluster_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS,
                    rounds: int = ROUNDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster, distance)`` per kept vector, and the final centroids (at most k).

    Vectors with exactly ``COMPONENTS`` components, none null or non-finite,
    are kept, each component as ``floor(SCALE * x)``.  ``distance`` is the
    squared Euclidean one; ties go to the smaller cluster.  With fewer kept
    vectors than k each of them starts a cluster.  Repeated rows are vectors
    of their own.  A null id hashes as the empty string.  A component beyond
    ``LARGEST`` after scaling is an error.  Other columns are ignored.  An empty
    table gives an empty result and no centroids.
    """
    blocks = vector_blocks(rows, id_col, vector_col, block_rows)
    centroids = first_centroids(blocks, k, seed)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {kind}, cluster int, distance long"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col), centroids
    drift = np.zeros(len(centroids))
    for _ in range(rounds):
        blocks = _round(blocks, centroids, drift)
        before, centroids = centroids, _moved(blocks, centroids)
        move = np.array([math.sqrt(sum(x * x for x in c)) for c in (centroids - before).tolist()]) * _UP
        others = np.array([max([0.0, *move[:c], *move[c + 1:]]) for c in range(len(move))])
        drift = (drift + move + others) * _UP
    final, first = centroids, "cluster" not in blocks.columns

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m = _members(b, i, len(final), first)
                (m.start if first else m.advance)(final, drift)
                distance = ((m.vectors - final[m.cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, pa.array(m.cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return materialize(blocks.mapInArrow(last, schema), "clusters").withColumnRenamed("id", id_col), centroids


def cluster_report(rows: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """Per kept vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and a digest of its centroid."""
    assigned, centroids = cluster_vectors(rows, id_col, **options)
    per_cluster = dict(assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect())  # k rows at most
    total = sum(per_cluster.values())
    about = [(c, n, total, sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in per_cluster.items()]
    table = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
