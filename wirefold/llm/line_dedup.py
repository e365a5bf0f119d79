"""Removal of repeated lines with levelled sorted runs of line hashes.

The state is a log-structured set of runs.  A run is a table sorted by the
128-bit hash of a line's key; an entry holds the number of documents with that
line and the largest document id among them.

1. Texts are gathered in blocks.  A block's distinct long lines become one row
   each (hash, documents of the block that hold it, their largest id), so a
   line that every document holds is one row per block.
2. Blocks are dealt into batches.  A batch adds up its rows per line and
   merge-anti-joins the runs: a line that a run has settled already (enough
   documents there, and no larger id here) leaves the batch.  The rest, sorted,
   is the batch's own run on level 0.
3. When a level has ``FAN_OUT`` runs, they are compacted into one run of the
   next level, which adds up their entries.  So an entry is rewritten once per
   level, however many batches come.
4. The settled lines go back to the blocks that hold them, and the texts are
   written without these lines.

Lines are compared by hash alone (BLAKE2b, 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm import textscan as ts
from wirefold.llm.common import materialize, runs
from wirefold.llm.lm_score import _unpacked as unpacked
from wirefold.llm.lm_score import text_blocks

MIN_CHARS = 40  # code points of a key, at least
MIN_DOCS = 5
BATCHES = 4
FAN_OUT = 3
KEY = ["h", "g"]
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class SortedRuns:
    """Runs of ``(h, g, n, top)``: documents with a line and the largest id of them, sorted by the hash ``(h, g)``.

    A run is a table below ``spark.checkpoint.dir``.  ``add`` takes batches in
    any order; what ``entries`` says of a line doesn't depend on it, but for
    ``n`` of lines that reached ``min_docs`` before, which may be too low (but
    never below ``min_docs``).
    """

    def __init__(self, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT):
        self.min_docs, self.fan_out = min_docs, fan_out
        self.levels: list[list[DataFrame]] = []

    def add(self, rows: DataFrame) -> None:
        """Add the rows ``(h, g, n, top)`` of new documents; several rows may belong to one line."""
        fresh = _summed(rows)
        for run in (r for level in self.levels for r in level):
            known = run.where(F.col("n") >= self.min_docs).select(*KEY, F.col("top").alias("known"))
            at = [fresh[k] == known[k] for k in KEY] + [known["known"] >= fresh["top"]]
            fresh = fresh.join(known.hint("merge"), at, "left_anti")
        self._put(fresh, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        at = self.levels[level]
        at.append(materialize(run.sortWithinPartitions(*KEY), f"run-{level}"))
        if len(at) == self.fan_out:
            self.levels[level] = []
            self._put(_summed(_union(at)), level + 1)

    def entries(self) -> DataFrame:
        """All lines, the runs merged."""
        return _summed(_union([r for level in self.levels for r in level]))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))


# ---- lines -------------------------------------------------------------------

def line_keys(texts: pa.Array, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, ...]:
    """``(start, end, doc, at, h, g)``: byte ranges of all lines, each line's text, and the hashes of the lines ``at``.

    ``at`` are the lines whose keys have ``min_chars`` code points or more.
    """
    data, offsets = ts.text_buffer(texts)
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    end = np.sort(np.concatenate([feeds, offsets[1:]]))
    n = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    doc = np.repeat(np.arange(len(texts)), n)
    solid = np.flatnonzero(ts.SPACES[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    at = np.flatnonzero(b > a)
    first, last = solid[a[at]], solid[b[at] - 1] + 1
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data & 0xC0 != 0x80, out=chars[1:])
    is_long = chars[last] - chars[first] >= min_chars
    at, first, last = at[is_long], first[is_long], last[is_long]
    lowered = data.tobytes().translate(_LOWER)
    digests = b"".join(blake2b(lowered[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), last.tolist()))
    pairs = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return start, end, doc, at, pairs[:, 0], pairs[:, 1]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def block_lines(blocks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(block, h, g, n, top)``: one row per block and distinct long line, written once."""
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, texts in zip(b.column("block"), b.column("ids"), b.column("texts")):
                _, _, doc, at, h, g = line_keys(unpacked(texts), min_chars)
                order = pc.array_sort_indices(ids.values, null_placement="at_start").to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                held = rank[doc[at]]
                by = np.lexsort((held, g, h))
                h, g, held = h[by], g[by], held[by]
                once = _changes(h, g, held)  # a line counts once per document
                h, g, held = h[once], g[once], held[once]
                first = np.flatnonzero(_changes(h, g))
                n = np.diff(np.append(first, len(h)))
                top = ids.values.take(pa.array(order[held[first + n - 1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), block.as_py())), pa.array(h[first]), pa.array(g[first]), pa.array(n), top],
                    ["block", "h", "g", "n", "top"])

    rows = blocks.select("block", "ids", "texts").mapInArrow(scan, f"block long, h long, g long, n long, top {id_type}")
    return materialize(rows, "lines")


def _rewritten(ids: pa.Array, texts: pa.Array, h: np.ndarray, g: np.ndarray, top: pa.Array, min_chars: int) -> list[pa.Array]:
    """Texts, lines and dropped lines per document; ``(h, g)``, sorted, are the settled lines, ``top`` the ids that keep them."""
    start, end, doc, at, lh, lg = line_keys(texts, min_chars)
    drop = np.zeros(len(start), bool)
    if len(h) and len(at):
        # Lines and settled lines in one sorted order: a line's entry is the one of equal hash.
        by = np.lexsort((np.concatenate([np.zeros(len(h), int), np.ones(len(lh), int)]), np.concatenate([g, lg]), np.concatenate([h, lh])))
        group = np.cumsum(_changes(np.concatenate([h, lh])[by], np.concatenate([g, lg])[by])) - 1
        entry = np.full(group[-1] + 1, -1)
        settled = by < len(h)
        entry[group[settled]] = by[settled]
        of_line = np.empty(len(lh), np.int64)
        of_line[by[~settled] - len(h)] = entry[group[~settled]]
        hit = np.flatnonzero(of_line >= 0)
        own, keeper = ids.take(pa.array(doc[at[hit]])), top.take(pa.array(of_line[hit]))
        same = pc.or_(pc.fill_null(pc.equal(own, keeper), False), pc.and_(pc.is_null(own), pc.is_null(keeper)))
        drop[at[hit]] = ~same.to_numpy(zero_copy_only=False)
    first = np.searchsorted(doc, np.arange(len(ids) + 1))
    n_lines = np.diff(first)
    n_dropped = np.bincount(doc[drop], minlength=len(ids))
    data = ts.text_buffer(texts)[0].tobytes()
    out = []
    for i, dropped in enumerate(n_dropped.tolist()):
        a, b = first[i], first[i + 1]
        if dropped:
            out.append(b"\n".join(data[start[j]:end[j]] for j in range(a, b) if not drop[j]))
        else:
            out.append(data[start[a]:end[b - 1]])
    return [pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_lines.astype(np.int64)), pa.array(n_dropped.astype(np.int64))]


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """Per document: id, text without repeated lines, ``n_lines`` (before), ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_docs`` documents hold
    are dropped everywhere but in the largest id that holds them.  Every row is
    a document, also if it repeats another one; rows that share the largest id
    all keep the line.  A null id is smaller than any other.  A null or empty
    text is one empty line and gives an empty text.  Other columns are ignored.
    An empty table gives an empty result.
    """
    blocks = text_blocks(docs, id_col, text_col)
    lines = block_lines(blocks, min_chars)
    state = SortedRuns(min_docs, fan_out)
    for i in range(batches):
        state.add(lines.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == i).drop("block"))
    settled = state.entries().where(F.col("n") >= min_docs).select(*KEY, "top")
    answers = lines.select("block", *KEY).join(settled, KEY)
    id_type = blocks.schema["ids"].dataType.elementType

    def rewrite(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(stream, ["block"]):
            ids, texts = t["ids"][0].values, unpacked(t["texts"][0])
            h, g = (t[k].to_numpy()[1:].astype(np.int64) for k in KEY)
            out = _rewritten(ids, texts, h, g, t["top"].combine_chunks().slice(1), min_chars)
            yield pa.RecordBatch.from_arrays([ids, *out], ["id", "text", "n_lines", "n_dropped"])

    rows = blocks.select("block", F.lit(False).alias("answer"), *(F.lit(0).cast("long").alias(k) for k in KEY),
                         F.lit(None).cast(id_type).alias("top"), "ids", "texts")
    back = answers.select("block", F.lit(True).alias("answer"), *KEY, "top",
                          F.lit(None).cast(blocks.schema["ids"].dataType).alias("ids"), F.lit(None).cast("binary").alias("texts"))
    out = rows.unionByName(back).repartition("block").sortWithinPartitions("block", "answer", *KEY)
    kind = id_type.simpleString()
    return out.mapInArrow(rewrite, f"id {kind}, text string, n_lines long, n_dropped long").withColumnRenamed("id", id_col)
