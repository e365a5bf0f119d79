"""Importance resampling towards a target: array-scored weights and a distributed radix sort.

1. *Weights.*  A text's features are its runs of one to three words; each
   falls in the bucket ``crc32 mod buckets``.  Every task counts its features
   in one array, the arrays are added up, and a bucket's gain is the logarithm
   of its smoothed share in the target over that in the documents.  A weight is
   the sum of the gains of a document's features, looked up in an array.
2. *Scores.*  Weight plus Gumbel noise drawn from the document's id, so that
   the highest scores are a sample without replacement.
3. *Ranks.*  A least-significant-digit radix sort over blocks of bounded size.
   The key is composite: score from high to low, then id.  A pass counts every
   block's digits, turns the counts into global offsets (a prefix sum over the
   digits, then over the blocks of each digit) and sends each row to its
   destination; the position after the last pass is the rank.  Blocks hold
   equally many rows whatever the keys are, so no value is hot, and nothing but
   one number per digit passes through the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.llm import textscan as ts
from wirefold.llm.common import materialize, runs

BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
PERCENT = 5
DIGIT_BITS = 11
BLOCK_ROWS = 1 << 15
_STEPPED_BYTES = 64  # longer words are hashed one by one
_SPACE = np.uint32(0x20)


# ---- features ----------------------------------------------------------------

def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


class _Words:
    """CRC-32 registers of words, all words a byte at a time."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.table = data, _crc_table()
        length = end - start
        self.order = np.argsort(-np.minimum(length, _STEPPED_BYTES + 1).astype(np.int16), kind="stable")
        self.start, self.end = start[self.order], end[self.order]
        length = length[self.order]
        self.n_long = int(np.searchsorted(-length, -_STEPPED_BYTES, "left"))
        self.live = [int(np.searchsorted(-length, -j, "left")) for j in range(min(_STEPPED_BYTES, int(length.max(initial=0))))]

    def step(self, register: np.ndarray, byte: np.ndarray | np.uint32) -> np.ndarray:
        return self.table[(register ^ byte) & np.uint32(0xFF)] ^ (register >> np.uint32(8))

    def append(self, register: np.ndarray) -> np.ndarray:
        """The registers after each row's word."""
        r = register[self.order]
        a = self.n_long
        for i in range(a):
            word = self.data[self.start[i]:self.end[i]].tobytes()
            r[i] = zlib.crc32(word, int(r[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        for j, n in enumerate(self.live):
            if n > a:
                r[a:n] = self.step(r[a:n], self.data[self.start[a:n] + j])
        out = np.empty_like(r)
        out[self.order] = r
        return out


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Piece by piece: index of each text's first word, and per run length the words that end a run and their buckets."""
    for part in ts.pieces(texts):
        data, offsets = ts.text_buffer(part)
        data = ts._lower_table()[data]
        start, end = ts.word_bounds(data, offsets, ts.ALNUM)
        first = np.searchsorted(start, offsets)
        place = np.arange(len(start)) - np.repeat(first[:-1], np.diff(first))
        words = _Words(data, start, end)
        register = words.append(np.full(len(start), 0xFFFFFFFF, np.uint32))
        out = []
        for k in range(3):
            if k:
                before = np.empty_like(register)
                before[1:] = words.step(register[:-1], _SPACE)
                before[:1] = 0
                register = words.append(before)
            at = np.flatnonzero(place >= k)
            out.append((at, (~register[at] % np.uint32(buckets)).astype(np.int64)))
        yield first, out


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; every task adds up its own, one row per bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, features in feature_buckets(b.column("text"), buckets):
                for _, bucket in features:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` per bucket, B buckets."""
    b = len(source)
    all_source, all_target = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(key: object, seed: int = SEED) -> int:
    """``floor(-1000 ln(-ln u))`` with u in (0, 1) drawn from the key; a null key counts as the empty string."""
    h = int.from_bytes(sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_documents(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                     seed: int = SEED) -> DataFrame:
    """``(row, id, n_words, n_features, weight, score)`` per row of ``docs``, written once; ``row`` is unique."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            for first, features in feature_buckets(b.column("text"), len(shared.value)):
                gain, times = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
                for at, bucket in features:
                    gain[at] += shared.value[bucket]
                    times[at] += 1
                columns[0].append(np.diff(first))
                for out, x in zip(columns[1:], (times, gain)):
                    total = np.concatenate([[0], np.cumsum(x)])
                    out.append(total[first[1:]] - total[first[:-1]])
            n_words, n_features, weight = (np.concatenate([np.zeros(0, np.int64), *c]) for c in columns)
            noise = np.array([gumbel(k, seed) for k in b.column("id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), *map(pa.array, (n_words, n_features, weight, weight + noise))],
                ["row", "id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(
        score, f"row long, id {kind}, n_words long, n_features long, weight long, score long"), "scores")


# ---- radix sort --------------------------------------------------------------

_COLUMNS = ["low", "high", "row"]
_BLOCK = "part long, low binary, high binary, row binary"


def _block(part: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], ["part", *_COLUMNS])


def _array(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _blocks(rows: DataFrame, score: tuple[int, int], key: tuple[int, int], block_rows: int) -> DataFrame:
    """Rows ``(row, id, score)`` in blocks; ``low`` is the id above the least one, ``high`` the best score minus the row's.

    A null id sets the top bit of ``row``.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column("id")
            empty = ids.is_null().to_numpy(zero_copy_only=False)
            low = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) - np.uint64(key[0] % (1 << 64))
            low[empty] = 0
            high = np.uint64(score[1] % (1 << 64)) - b.column("score").to_numpy().view(np.uint64)
            row = b.column("row").to_numpy().view(np.uint64) | empty.astype(np.uint64) << np.uint64(63)
            for i in range(0, b.num_rows, block_rows):
                yield _block(part, [x[i:i + block_rows] for x in (low, high, row)])
                part += 1

    return materialize(rows.select("row", F.col("id").cast("long").alias("id"), "score").mapInArrow(gather, _BLOCK), "sort-blocks")


def _digits(column: pa.Scalar, shift: int, bits: int) -> np.ndarray:
    return ((_array(column) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _sort_pass(blocks: DataFrame, column: str, shift: int, bits: int, block_rows: int) -> DataFrame:
    """One stable counting sort of all rows by one digit; blocks are numbered by position afterwards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, values in zip(b.column("part"), b.column(column)):
                n = np.bincount(_digits(values, shift, bits), minlength=1 << bits)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), part.as_py())), pa.array(at), pa.array(n[at])], ["part", "digit", "n"])

    counts = materialize(blocks.select("part", column).mapInArrow(count, "part long, digit long, n long"), "digit-counts")
    below, base = 0, []
    for digit, n in sorted(counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()):  # one row per digit
        base.append((digit, below))
        below += n
    base = blocks.sparkSession.createDataFrame(base, "digit long, base long")
    before = F.sum("n").over(Window.partitionBy("digit").orderBy("part")) - F.col("n")
    offsets = (
        counts.withColumn("before", before).join(F.broadcast(base), "digit")
        .groupBy("part").agg(F.sort_array(F.collect_list(F.struct("digit", (F.col("base") + F.col("before")).alias("to")))).alias("to"))
        .select("part", F.col("to.digit").alias("digit"), F.col("to.to").alias("to"))
    )

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                arrays = [_array(b.column(c)[i]) for c in _COLUMNS]
                digit = _digits(b.column(column)[i], shift, bits)
                order = np.argsort(digit, kind="stable")
                digit = digit[order]
                first = np.searchsorted(digit, digit)  # equal digits are neighbours
                known, to = (b.column(c)[i].values.to_numpy() for c in ("digit", "to"))
                position = to[np.searchsorted(known, digit)] + np.arange(len(digit)) - first
                part = position // block_rows
                cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                segments = list(zip(cut[:-1], cut[1:]))
                at = (position % block_rows).astype(np.uint64)
                sent = [x[order] for x in arrays]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[x]) for x, _ in segments]),
                     *(pa.array([v[x:y].tobytes() for x, y in segments], pa.binary()) for v in (*sent, at))],
                    ["part", *_COLUMNS, "at"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["part"]):
            at = np.concatenate([_array(x) for x in t["at"]]).astype(np.int64)
            out = []
            for c in _COLUMNS:
                v = np.empty(len(at), np.uint64)
                v[at] = np.concatenate([_array(x) for x in t[c]])
                out.append(v)
            yield _block(t["part"][0].as_py(), out)

    moved = blocks.join(offsets, "part").mapInArrow(scatter, f"{_BLOCK}, at binary")
    return materialize(moved.repartition("part").sortWithinPartitions("part").mapInArrow(place, _BLOCK), "sort-blocks")


def radix_ranks(rows: DataFrame, last: int, digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(row, rank)`` of the rows ``(row, id, score)`` up to rank ``last``: score from high to low, then id, null ids last.

    ``id`` is an integer, ``row`` is not negative.  Rows equal in both keep the order in which they were read.
    """
    seen = rows.agg(F.count_if(F.col("id").isNull()).alias("nulls"),
                    *(f(c).alias(f"{n}_{c}") for c in ("score", "id") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    score = (seen["lo_score"] or 0, seen["hi_score"] or 0)
    key = (seen["lo_id"] or 0, seen["hi_id"] or 0)
    blocks = _blocks(rows, score, key, block_rows)
    digits = [("low", 0, (key[1] - key[0]).bit_length()), ("row", 63, 64 if seen["nulls"] else 63), ("high", 0, (score[1] - score[0]).bit_length())]
    passes = [(c, s, min(digit_bits, n - s)) for c, lo, n in digits for s in range(lo, n, digit_bits)]
    for column, shift, bits in passes:
        blocks = _sort_pass(blocks, column, shift, bits, block_rows)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, row in zip(b.column("part"), b.column("row")):
                row = (_array(row) & np.uint64((1 << 63) - 1)).view(np.int64)
                rank = part.as_py() * block_rows + 1 + np.arange(len(row))
                drawn = rank <= last
                yield pa.RecordBatch.from_arrays([pa.array(row[drawn]), pa.array(rank[drawn])], ["row", "rank"])

    return blocks.where(F.col("part") * block_rows < last).select("part", "row").mapInArrow(ranks, "row long, rank long")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
                        buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per document: id (an integer), ``n_features``, ``weight``, ``score``, ``rank`` (1 the highest score, null if not drawn).

    ``percent`` of the documents with ``min_words`` words or more are drawn,
    rounded down.  Words are runs of ASCII letters, digits and characters
    beyond ASCII, A-Z lower-cased; null and empty texts have none, weight 0.
    Ties in the score go to the smaller id, null ids last; repeated rows are
    documents of their own with equal scores, in the order in which they were
    read.  Without target texts every gain is that of an empty target.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    scored = scored_documents(docs, gains, id_col, text_col, seed)
    eligible = scored.where(F.col("n_words") >= min_words)
    ranks = radix_ranks(eligible.select("row", "id", "score"), percent * eligible.count() // 100)
    return scored.join(ranks, "row", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
