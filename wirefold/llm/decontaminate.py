"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ten consecutive words (one shorter run for
a short item).  A window occurs in a document only if all its words do, so
its rarest word is a necessary prefix (containment of the whole set needs a
prefix of length one).  The steps:

1. count in how many documents each benchmark word occurs (partial sums per
   task, whole corpus), and order each window's words by that rarity;
2. join the documents' words to the windows' rarest words only;
3. drop candidates by position (the window must lie within the document
   around the joined word, which also bounds the length);
4. verify the others word by word over the window.

The documents are never shuffled.  The benchmark's index is broadcast in
blocks of at most ``BLOCK_WORDS`` words, whatever the benchmark's size, and
the hits of the blocks are merged per document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm import textscan as ts
from wirefold.llm.common import materialize

WINDOW = 10
BLOCK_WORDS = 200_000  # words of benchmark text per broadcast block (about 150 MB on the driver while its index is built)
PIECE_WORDS = 100_000  # longer items are cut into overlapping pieces
CANDIDATES = 1 << 20  # candidates verified at a time
HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, index of each text's first word)."""
    data, offsets = ts.text_buffer(column)
    _, _, h, first = ts.words(data, offsets, ts.ALNUM)
    return h, first


def item_words(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``(item, words, n)``: the words of each item as hashes; a long item in pieces that overlap by a window."""

    def scan(batches):
        for b in batches:
            h, first = _words(b.column("text"))
            rows = []
            for item, a, z in zip(b.column("item").to_pylist(), first[:-1], first[1:]):
                step = PIECE_WORDS - window + 1
                rows += [(item, h[x:min(x + PIECE_WORDS, z)]) for x in range(a, max(a + 1, z - window + 1), step) if z > a]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tobytes() for r in rows], pa.binary()),
                     pa.array([len(r[1]) for r in rows], pa.int64())], ["item", "words", "n"])

    return items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(
        scan, "item string, words binary, n long")


def document_frequencies(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each word hash of the sorted ``vocabulary`` occurs."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches):
        voc = known.value
        total = np.zeros(len(voc), np.int64)
        for part in (p for b in batches for p in ts.pieces(b.column("text"))):
            h, first = _words(part)
            at = np.searchsorted(voc, h)
            at[at == len(voc)] = 0
            hit = np.flatnonzero(voc[at] == h)
            doc = np.searchsorted(first, hit, "right")
            pairs = np.unique(doc.astype(np.int64) * len(voc) + at[hit])
            total += np.bincount(pairs % len(voc), minlength=len(voc))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    for r in counts.collect():  # at most one row per word of the block
        out[r["word"]] = r["n"]
    return out


class WindowIndex:
    """The distinct windows of one block of items, by the rarest word of each."""

    def __init__(self, pieces: list[tuple[str, np.ndarray]], window: int):
        by_text: dict[bytes, set] = {}
        for item, h in pieces:
            k = min(window, len(h))
            for i in range(len(h) - k + 1):
                by_text.setdefault(h[i:i + k].tobytes(), set()).add(item)
        self.window = window
        self.items = [sorted(x for x in s if x is not None) for s in by_text.values()]
        self.length = np.array([len(k) // 8 for k in by_text], np.int64)
        self.words = np.zeros((len(by_text), window), np.uint64)
        for row, k in zip(self.words, by_text):
            row[:len(k) // 8] = np.frombuffer(k, np.uint64)
        inside = np.arange(window) < self.length[:, None]
        self.vocabulary = np.unique(self.words[inside])

    def order_by_rarity(self, frequency: np.ndarray) -> None:
        """Choose each window's prefix word; windows with a word that no document has are dropped."""
        at = np.searchsorted(self.vocabulary, self.words)
        at[at == len(self.vocabulary)] = 0
        rank = np.empty(len(self.vocabulary), np.int64)
        rank[np.lexsort((self.vocabulary, frequency))] = np.arange(len(self.vocabulary))
        inside = np.arange(self.window) < self.length[:, None]
        offset = np.where(inside, rank[at], len(rank)).argmin(axis=1)
        prefix = self.words[np.arange(len(self.words)), offset]
        possible = frequency[at[np.arange(len(at)), offset]] > 0
        order = np.flatnonzero(possible)
        order = order[np.argsort(prefix[order], kind="stable")]
        self.words, self.length, self.offset = self.words[order], self.length[order], offset[order]
        self.items = [self.items[i] for i in order]
        self.prefix, self.first = np.unique(prefix[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.vocabulary = None

    def occurrences(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of all occurrences in the texts whose words are ``h``."""
        none = np.zeros(0, np.int64)
        if not len(self.prefix) or not len(h):
            return none, none
        at = np.searchsorted(self.prefix, h)
        at[at == len(self.prefix)] = 0
        pos = np.flatnonzero(self.prefix[at] == h)
        at = at[pos]
        doc = np.searchsorted(first, pos, "right") - 1
        low, high = first[doc], first[doc + 1]
        times = self.first[at + 1] - self.first[at]
        found_start, found_window = [none], [none]
        ends = np.cumsum(times)
        a = 0
        while a < len(pos):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CANDIDATES, "right")))
            n = times[a:z]
            one = np.repeat(np.arange(a, z), n)
            win = self.first[at[one]] + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            start = pos[one] - self.offset[win]
            fits = (start >= low[one]) & (start + self.length[win] <= high[one])
            start, win = start[fits], win[fits]
            for j in range(self.window):
                same = (j >= self.length[win]) | (h[np.minimum(start + j, len(h) - 1)] == self.words[win, j])
                start, win = start[same], win[same]
            found_start.append(start)
            found_window.append(win)
            a = z
        return np.concatenate(found_start), np.concatenate(found_window)


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Disjoint ranges that cover the given ones."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return [{"start": int(s), "end": int(e)} for s, e in zip(start[first], end[last])]


def _hits_udf(shared) -> Callable[[Column], Column]:
    """The look-up of a broadcast index as a function of a text column."""

    def scan(texts):
        index = shared.value
        out = []
        for part in ts.pieces(texts):
            h, first = _words(part)
            start, win = index.occurrences(h, first)
            doc = np.searchsorted(first, start, "right") - 1
            order = np.argsort(doc, kind="stable")
            start, win, doc = start[order], win[order], doc[order]
            cut = np.searchsorted(doc, np.arange(len(first)))
            for i, n in enumerate(np.diff(first)):
                a, z = cut[i], cut[i + 1]
                spans, names = [], []
                if z > a:
                    s = start[a:z] - first[i]
                    spans = _merged(s, s + index.length[win[a:z]])
                    names = sorted({x for w in np.unique(win[a:z]) for x in index.items[w]})
                out.append({"n_words": int(n), "spans": spans, "items": names})
        return pa.array(out, _HITS_ARROW)

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, HITS)


def window_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                window: int = WINDOW) -> list[Column]:
    """One column per block of the benchmark: ``n_words``, hit ``spans`` (word positions, disjoint, end exclusive), ``items``.

    Usually there is one block; ``merge_hits`` joins the columns of several.
    """
    spark = docs.sparkSession
    # Repeated items are one; a table, so that no block scans the benchmark again.
    pieces = materialize(item_words(items, item_id, item_text, window).distinct(), "benchmark-words")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-2 * int(total) // BLOCK_WORDS) if total > BLOCK_WORDS else 1  # twice as many as needed: the deal is uneven
    columns = []
    for block in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block) if blocks > 1 else pieces
        index = WindowIndex([(r["item"], np.frombuffer(r["words"], np.uint64)) for r in own.toLocalIterator()], window)
        index.order_by_rarity(document_frequencies(docs, text_col, index.vocabulary) if len(index.vocabulary) else np.zeros(0, np.int64))
        shared = spark.sparkContext.broadcast(index)
        columns.append(_hits_udf(shared)(F.col(text_col)))
    return columns


def merge_hits(columns: list[Column]) -> Column:
    """The hits of all blocks as one struct; overlapping spans are joined."""
    if len(columns) == 1:
        return columns[0]
    spans = F.array_sort(F.flatten(F.array(*(c["spans"] for c in columns))))

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return F.struct(columns[0]["n_words"].alias("n_words"), F.aggregate(spans, empty, join).alias("spans"),
                    F.array_distinct(F.flatten(F.array(*(c["items"] for c in columns)))).alias("items"))


def contaminated_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_words, spans, items)`` per document, in any order; no shuffle of documents.

    Null and wordless texts have no words and no hits; null or wordless
    items have no windows; an item with a null id marks words but is not named.
    Equal windows of several items are looked up once and name all of them.
    """
    hits = window_hits(docs, items, text_col, **options)
    found = docs.select(F.col(id_col), *(c.alias(f"h{i}") for i, c in enumerate(hits)))
    return found.select(id_col, merge_hits([F.col(f"h{i}") for i in range(len(hits))]).alias("hit")).select(id_col, "hit.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs; rows and columns stay as they are."""
    clean = docs
    for hit in window_hits(docs, items, text_col, **options):
        clean = clean.where(F.size(hit["spans"]) == 0)
    return clean


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and a digest of the items found, per document."""
    hits = contaminated_documents(docs, items, id_col, text_col)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))
