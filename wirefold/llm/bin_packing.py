"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Documents are dealt by hash into shards of bounded size, and each shard is
packed on its own: longest first, into the bin with the smallest residual
that is large enough and compatible.  A bin carries two bitmaps, of the
sources and of the duplicate clusters it holds, and takes a document only if
neither bit is set; the successor search walks up the bins in order of
residual until it finds the tightest compatible one, or opens a new bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import connected_components, materialize, runs
from wirefold.llm.jaccard_join import class_links, document_sets

CAPACITY = 2048
SHARD_ROWS = 4096


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, taken in the given order; a source or cluster below 0 conflicts with nothing."""
    bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out_bin, out_at = [], []
    for n, s, c in zip(lengths, sources, clusters):
        sbit = 1 << s if s >= 0 else 0
        cbit = 1 << c if c >= 0 else 0
        i = bisect_left(bins, (n, -1))
        while i < len(bins) and (source_bits[bins[i][1]] & sbit or cluster_bits[bins[i][1]] & cbit):
            i += 1
        if i < len(bins):
            residual, b = bins.pop(i)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= sbit
        cluster_bits[b] |= cbit
        out_bin.append(b)
        out_at.append(capacity - residual)
        if residual > n:
            insort(bins, (residual - n, b))
    return out_bin, out_at


def word_count(text: Column) -> Column:
    """White-space separated words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def duplicate_cluster(text: Column) -> Column:
    """Cluster key of equal texts (letter case aside); null for null and empty texts."""
    return F.when(F.length(text) > 0, F.xxhash64(F.lower(text)))


def _codes(column: pa.ChunkedArray) -> list[int]:
    """Small integers for the values of a column within a shard; -1 for null."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_pylist()


def pack_documents(items: DataFrame, id_col: str = "doc_id", length_col: str = "length", source_col: str = "source",
                   cluster_col: str = "cluster", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(id, piece, n_tokens, bin_id, bin_offset)``, one row per piece of a document.

    A document longer than ``capacity`` is cut into pieces of that length and
    a rest.  Null or zero lengths take no room: one row, ``bin_id`` and
    ``bin_offset`` null.  Null sources and clusters conflict with nothing.
    Ties are broken by id and piece; repeated rows are packed one by one.  A
    bin never exceeds ``capacity`` and never holds two pieces of one source or
    one cluster.
    """
    rows = items.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long").alias("n"),
                        F.col(source_col).cast("string").alias("source"), F.col(cluster_col).alias("cluster"))
    pieces = rows.where("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))))
    pieces = pieces.withColumn("n", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity))
    count = rows.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    shards = max(1, -(-int(count) // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "source", "cluster"), F.lit(shards)).cast("int"))
    id_type = dealt.schema["id"].dataType.simpleString()

    def pack(batches):
        for t in runs(batches, ["shard"]):
            n = t["n"].to_pylist()
            b, at = best_fit(n, _codes(t["source"]), _codes(t["cluster"]), capacity)
            ids = np.array(b, np.int64) | np.int64(t["shard"][0].as_py()) << np.int64(24)
            yield pa.Table.from_arrays(
                [t["id"], t["piece"], t["n"], pa.array(ids), pa.array(at, pa.int64())],
                ["id", "piece", "n_tokens", "bin_id", "bin_offset"]).combine_chunks().to_batches()[0]

    packed = (
        dealt.repartition(shards, "shard")
        .sortWithinPartitions("shard", F.desc("n"), "id", "piece", "source", "cluster")
        .mapInArrow(pack, f"id {id_type}, piece int, n_tokens long, bin_id long, bin_offset long")
    )
    empty = rows.where("n = 0").select(
        "id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(empty).withColumnRenamed("id", id_col)


def linked_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, length, cluster)`` per row; a cluster is a group of texts linked by shingles or equal (letter case aside).

    Clusters are joined by the class of a text, not by id, so that repeated and null ids keep their rows.
    """
    info = materialize(document_sets(docs, id_col, text_col, source=F.col(source_col), same=duplicate_cluster(F.col(text_col)))
                       .withColumnRenamed("n_words", "length"), "sets")
    full = info.where("class_id is not null")
    _, links = class_links(docs, full, id_col, text_col)
    texts = full.groupBy("same", "class_id").count().select("same", "class_id")
    lowest = texts.groupBy("same").agg(F.min("class_id").alias("dst"), F.max("class_id").alias("last")).where("dst <> last")
    equal = texts.join(lowest, "same").select(F.col("class_id").alias("src"), "dst").where("src <> dst")
    roots = connected_components(links.unionByName(equal))
    return info.join(roots, info["class_id"] == roots["node"], "left").select(
        "id", "source", "length", F.coalesce("root", "class_id").alias("cluster"))


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               capacity: int = CAPACITY, near: bool = False) -> DataFrame:
    """Pack whole texts by their number of words; clusters are equal texts, with ``near`` all texts linked by shingles too.

    ``near`` is for texts that no near-duplicate removal has seen.
    """
    if near:
        items = linked_items(docs, id_col, text_col, source_col)
    else:
        items = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                            word_count(F.col(text_col)).alias("length"), duplicate_cluster(F.col(text_col)).alias("cluster"))
    items = materialize(items, "lengths")  # the texts are read once, whatever is counted and joined after
    return pack_documents(items, "id", "length", "source", "cluster", capacity).withColumnRenamed("id", id_col)
