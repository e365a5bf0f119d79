"""Helpers shared by the operators: written tables, grouped streams, components, bounded bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.session import read_table, shared_dir

__all__ = ["connected_components", "from_planes", "id_bitmap", "in_bitmap", "materialize", "planes", "read_table", "runs", "shared_dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below ``spark.checkpoint.dir`` and read it back (cuts lineage, survives lost executors)."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(src, dst)``; the root is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is a few
    shuffles of the edge list, whose size never grows, and the number of
    rounds is logarithmic.  Minima are partial aggregates, and the joins back
    are plain equi-joins that the adaptive planner may split, so a hub with
    millions of neighbours is no single task.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.select("src", "dst")
        if large:
            near = near.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = near.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
        j = near.join(low, "src")
        if large:
            out = j.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        else:
            out = j.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(
                low.select("src", F.col("m").alias("dst")))
        return out.where("src <> dst").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())

    e = materialize(
        edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(),
        "edges")
    before = state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        e = materialize(star(star(e, True), False), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    rooted = e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return rooted.union(rooted.select(F.col("root").alias("node"), "root").distinct())


def id_bitmap(keys: DataFrame, key: Column, log2_bits: int = 23) -> np.ndarray:
    """A bitmap of fixed size (``2**log2_bits`` bits) over the hashes of ``key``: one hash, false positives only.

    It prunes a scan before an exact join and may be broadcast, because its
    size does not depend on the data (1 MB by default).
    """
    bits = 1 << log2_bits
    slot = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))
    words = keys.select(slot.alias("b")).select(
        F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():
        out[r["w"]] = r["v"]
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the (signed 64-bit) hashes may be in the bitmap."""
    b = hashes.astype(np.int64) & np.int64(len(bitmap) * 64 - 1)
    return (bitmap[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, which compression can shrink."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: pa.Scalar | pa.Buffer, kind) -> np.ndarray:
    """The integers of type ``kind`` that ``planes`` wrote."""
    raw = np.frombuffer(data if isinstance(data, pa.Buffer) else data.as_buffer(), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Split a stream sorted by integer ``keys`` into one table per key, holding one key's rows at a time."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(lo, hi - lo))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)
