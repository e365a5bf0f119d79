"""Stupid-backoff scores of documents from hash-partitioned n-gram counts.

A document's words are scored under the n-grams of all other documents (its
own are taken off, so that a text doesn't vouch for itself).  With c the counts
elsewhere and g the n-1 words before w::

    S(w | g) = c(g w) / c(g)         if c(g w) > 0
             = 0.4 * S(w | g')       otherwise, g' without its first word
    S(w)     = c(w) / N

with N words elsewhere; an unknown word counts as half an occurrence, and the
first words of a text have as many words before them as there are.  All counts
are exact over the whole corpus, up to collisions of 64-bit hashes.

The relations are packed, since nearly every n-gram of a text is a row:

1. documents are gathered into blocks of a few megabytes, written once;
2. a block's distinct n-grams and their numbers are exploded into one row per
   hash partition (sorted arrays in binary columns, hashes as differences);
3. a partition adds up the numbers of all blocks and joins the totals back to
   each block's n-grams;
4. the totals meet their block again, and the logarithms are summed per
   document.

A frequent n-gram is one array entry per block, however often it occurs, so no
partition is hot; blocks and partitions are bounded, and their numbers follow
the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm import textscan as ts
from wirefold.llm.common import from_planes, planes, runs, shared_dir

ORDER = 3
BACKOFF = 0.4
UNKNOWN = 0.5
BLOCK_BYTES = 8 << 20
PARTITION_BYTES = 4 << 20  # corpus bytes per hash partition, about a million n-grams
_U = np.uint64


def _packed(texts: pa.Array) -> bytes:
    """A string array as compressed bytes."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.Array:
    return pa.ipc.open_stream(data.as_buffer()).read_all()["text"].combine_chunks()


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(block, ids, texts, n_words, n_bytes)``, written once below ``spark.checkpoint.dir``; a text is never cut.

    ``texts`` is compressed, so that the block is small in the shuffle too.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def gather(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        kept: list[pa.RecordBatch] = []
        size = 0

        def flush():
            t = pa.Table.from_batches(kept).combine_chunks()
            data, offsets = ts.text_buffer(t["text"])
            one = pa.array([0, t.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.ListArray.from_arrays(one, t["id"].chunk(0)),
                 pa.array([_packed(t["text"].chunk(0))], pa.binary()),
                 pa.array([len(ts.word_bounds(data, offsets, ts.SPACES)[0])]), pa.array([len(data)])],
                ["block", "ids", "texts", "n_words", "n_bytes"])

        for b in batches:
            _, offsets = ts.text_buffer(b.column("text"))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES - size, "right")) - 1)
                kept.append(b.slice(lo, hi - lo))
                size += int(offsets[min(hi, b.num_rows)] - offsets[lo])
                lo = hi
                if size >= BLOCK_BYTES or lo < b.num_rows:
                    yield flush()
                    kept, size, block = [], 0, block + 1
        if kept:
            yield flush()

    schema = f"block long, ids array<{id_type}>, texts binary, n_words long, n_bytes long"
    blocks = source.mapInArrow(gather, schema)
    path = shared_dir(spark, "text-blocks")
    blocks.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def _block_keys(texts: pa.Array, order: int):
    """Sorted distinct n-gram keys of a block, their numbers, index of each text's first word, and per length the place of each word's n-gram.

    The n-gram of a word ends at it; -1 where a text has fewer words before it.
    """
    data, offsets = ts.text_buffer(texts)
    _, _, h, first = ts.words(data, offsets, ts.SPACES)
    before = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))  # words of the text before each word
    grams, at = [ts.mix(h + _U(1))], [np.arange(len(h))]
    for n in range(2, order + 1):
        longer = grams[-1].copy()
        longer[1:] = ts.mix(ts.mix(grams[-1][:-1] ^ _U(0x5851F42D4C957F2D)) + h[1:] * _U(0x9E3779B97F4A7C15) + _U(n))
        grams.append(longer)
        at.append(np.flatnonzero(before >= n - 1))
    keys, place, times = np.unique(np.concatenate([g[i] for g, i in zip(grams, at)]), return_inverse=True, return_counts=True)
    places, lo = [], 0
    for i in at:
        own = np.full(len(h), -1, np.int64)
        own[i] = place[lo:lo + len(i)]
        places.append(own)
        lo += len(i)
    return keys, times, first, places


def ngram_totals(blocks: DataFrame, partitions: int, order: int) -> DataFrame:
    """``(block, part, totals)``: corpus counts of each block's n-grams, in the order of its sorted keys."""
    shift = _U(64 - (partitions.bit_length() - 1))

    def explode(batches):
        for b in batches:
            for block, texts in zip(b.column("block"), b.column("texts")):
                keys, times, *_ = _block_keys(_unpacked(texts), order)
                part = (keys >> shift).astype(np.int64) if partitions > 1 else np.zeros(len(keys), np.int64)
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else np.zeros(0, np.int64)
                ends = np.append(cut[1:], len(keys))
                times = times.astype(np.uint32)
                steps = np.diff(keys, prepend=_U(0))
                steps[cut] = keys[cut]  # each partition starts with a whole key
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut]), pa.array([block.as_py()] * len(cut), pa.int64()),
                     pa.array([planes(steps[x:y]) for x, y in zip(cut, ends)], pa.binary()),
                     pa.array([planes(times[x:y]) for x, y in zip(cut, ends)], pa.binary())], ["part", "block", "grams", "times"])

    def count(batches):
        for t in runs(batches, ["part"]):
            keys = [np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for k in t["grams"]]
            times = np.concatenate([from_planes(n, np.uint32) for n in t["times"]])
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(place, weights=times).astype(np.uint64)[place]
            at = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [t["block"].combine_chunks(), t["part"].combine_chunks(),
                 pa.array([planes(totals[x:y]) for x, y in zip(at[:-1], at[1:])], pa.binary())], ["block", "part", "totals"])

    requests = blocks.select("block", "texts").mapInArrow(explode, "part long, block long, grams binary, times binary")
    return requests.repartition("part").sortWithinPartitions("part", "block").mapInArrow(count, "block long, part long, totals binary")


def _document_scores(texts: pa.Array, totals: np.ndarray, all_words: int, order: int) -> tuple[np.ndarray, ...]:
    """(words, words whose longest n-gram is known from other documents, sum of ln S) per document of a block."""
    keys, _, first, places = _block_keys(texts, order)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)

    def elsewhere(place: np.ndarray) -> np.ndarray:
        """Counts of the words' n-grams outside of their documents; 0 where there is no n-gram."""
        out = np.zeros(len(place), np.int64)
        at = np.flatnonzero(place >= 0)
        if len(at):
            own, inverse, times = np.unique(doc[at] * len(keys) + place[at], return_inverse=True, return_counts=True)
            out[at] = (totals[own % len(keys)].astype(np.int64) - times)[inverse]
        return out

    counts = [elsewhere(p) for p in places]
    s = np.log(np.where(counts[0] > 0, counts[0], UNKNOWN) / np.maximum(all_words - n, 1)[doc])
    for m in range(1, order):  # from short to long: what a longer n-gram knows takes the place of the shorter one's score
        s[places[m] >= 0] += math.log(BACKOFF)
        known = np.flatnonzero(counts[m] > 0)
        s[known] = np.log(counts[m][known] / counts[m - 1][known - 1])
    filled = np.flatnonzero(n)
    sums, hits = np.zeros(len(n)), np.zeros(len(n), np.int64)
    if len(filled):
        sums[filled] = np.add.reduceat(s, first[:-1][filled])
        hits[filled] = np.add.reduceat((counts[-1] > 0).astype(np.int64), first[:-1][filled])
    return n, hits, sums


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per document: id, ``n_words``, ``n_known`` (words whose n-gram of length ``order`` is known from other documents), ``log_score`` (sum of ln S).

    Words are runs of other characters than white space, A-Z lower-cased.
    Null and wordless texts have no words and a ``log_score`` of 0.  Repeated
    rows are documents of their own and know each other's n-grams.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    blocks = text_blocks(docs, id_col, text_col)
    size = blocks.agg(F.sum("n_words").alias("n_words"), F.sum("n_bytes").alias("n_bytes")).first()
    all_words = int(size["n_words"] or 0)
    partitions = 1 << max(6, math.ceil(math.log2(max(1, (size["n_bytes"] or 0) / PARTITION_BYTES))))
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def score(batches):
        for t in runs(batches, ["block"]):
            whole = t.slice(0, 1)
            ids, texts = whole["ids"].combine_chunks().values, _unpacked(whole["texts"][0])
            parts = [from_planes(x, np.uint64) for x in t["totals"][1:]]
            totals = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            n, hits, sums = _document_scores(texts, totals, all_words, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(hits), pa.array(sums)],
                                             ["id", "n_words", "n_known", "log_score"])

    totals = ngram_totals(blocks, partitions, order)
    empty = {"ids": f"array<{id_type}>", "texts": "binary"}
    answers = totals.select("block", "part", "totals", *(F.lit(None).cast(k).alias(c) for c, k in empty.items()))
    rows = blocks.select("block", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("totals"), "ids", "texts")
    scored = (
        rows.unionByName(answers).repartition("block").sortWithinPartitions("block", "part")
        .mapInArrow(score, f"id {id_type}, n_words long, n_known long, log_score double")
    )
    return scored.withColumnRenamed("id", id_col)
