"""Token ids in binary blocks compressed by Re-Pair grammars, with random-access decoding.

Documents are sorted by id into shards (range partitions).  A shard is cut
into blocks of whole documents, and each block becomes one binary record:
frequent neighbouring id pairs are replaced by nonterminals, round after
round; the rules, the number of ids every rule expands to, the remaining
sequence and the documents' lengths are stored.  The lengths make any id range
of a block decodable without expanding the rest.  The records are the rows of
a Parquet table written by Spark, so lost tasks are repeated and any file
system that Spark reaches will do.

Record (little endian): magic ``RPG1``, four u32 counts (rules R, symbols S,
documents D, first nonterminal V), then u32 left[R], u32 right[R], u32
expansion[R], u32 symbol[S], u32 document length[D].
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.llm import textscan as ts
from wirefold.llm.common import shared_dir

MAGIC = b"RPG1"
END_ID = 2
BLOCK_IDS = 1 << 18  # a block is closed by the document that reaches this many ids
MIN_PAIR_COUNT = 8
SHARDS_PER_SPLIT = 2  # shards per split that Spark reads the documents in, so that they don't grow with the table
PIECE_BYTES = 1 << 20  # text that is cut and looked up at a time: its arrays stay in the cache
CACHED_PIECES = 1_500_000  # pieces of text whose ids a worker remembers
_SLOT_BITS = 18
_U = np.uint64


# ---- grammar -----------------------------------------------------------------

def _frequent_pairs(seq: np.ndarray, among: np.ndarray, min_count: int) -> tuple[np.ndarray, ...]:
    """(positions among the given ones of pairs that occur ``min_count`` times or more there, which pair each is, the pairs, their counts)."""
    whole = len(among) == len(seq) - 1
    code = (seq[:-1] if whole else seq[among]).astype(np.uint64)
    code <<= _U(32)
    code |= seq[1:] if whole else seq[among + 1]
    slot = (code * _U(0x9E3779B97F4A7C15) >> _U(64 - _SLOT_BITS)).astype(np.int32)
    hot = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOT_BITS) >= min_count)[slot])  # no frequent pair is missed, a few others come along
    pair, which, times = np.unique(code[hot], return_inverse=True, return_counts=True)
    keep = times[which] >= min_count
    return among[hot[keep]], which[keep], pair, times


def _locally_best(at: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Which of the positions have a more frequent pair than both overlapping ones; among equals every second of a run."""
    start = np.ones(len(at), bool)
    start[1:] = (at[1:] != at[:-1] + 1) | (times[1:] != times[:-1])
    index = np.arange(len(at))
    even = (index - np.maximum.accumulate(np.where(start, index, 0))) % 2 == 0
    rank = np.zeros(len(at) + 2, np.int64)
    rank[1:-1] = 2 * times + even
    place = np.full(len(at) + 2, -9, np.int64)
    place[1:-1] = at
    before = np.where(place[:-2] == at - 1, rank[:-2], 0)
    behind = np.where(place[2:] == at + 1, rank[2:], 0)
    return (rank[1:-1] > before) & (rank[1:-1] > behind)


def compress(ids: np.ndarray, min_count: int = MIN_PAIR_COUNT) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """``(rules, sequence, first, expansions)``: Re-Pair over one block of ids, until no pair occurs ``min_count`` times.

    Rule ``i`` defines the nonterminal ``first + i`` and stands for
    ``expansions[i]`` ids.  A round counts all neighbouring pairs and replaces
    every frequent one where no overlapping pair is more frequent, so many
    rules are made per pass; where that replaces none often enough, the most
    frequent pair alone is replaced from the left.  A pair's count never grows,
    so a round looks only at the pairs that were frequent in the one before and
    at those around its new nonterminals.
    """
    seq = ids.astype(np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 0
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64)
    among = np.arange(max(0, len(seq) - 1))
    while len(among) >= min_count:
        at, which, pair, times = _frequent_pairs(seq, among, min_count)
        if not len(at):
            break
        take = _locally_best(at, times[which])
        uses = np.bincount(which[take], minlength=len(pair))
        chosen = uses >= max(2, min_count // 2)
        if not chosen.any():
            chosen = np.arange(len(pair)) == np.argmax(times)
            hit = chosen[which]
            take = hit.copy()
            take[hit] = _locally_best(at[hit], times[which[hit]])
        take &= chosen[which]
        position, number = at[take], np.cumsum(chosen)[which[take]] - 1
        p = pair[chosen]
        new = np.stack([p >> _U(32), p & _U(0xFFFFFFFF)], 1).astype(np.uint32)
        seq[position] = (first + len(lengths) + number).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[position + 1] = False
        look = np.zeros(len(seq) + 1, bool)
        look[at] = True
        look[position] = True
        look[position + 1] = False
        look[position - 1] |= position > 0  # the one before it may be removed, then the nonterminal before that starts a new pair
        look[np.maximum(position - 2, 0)] |= position > 1
        seq, look = seq[stay], look[:-1][stay]
        among = np.flatnonzero(look[:-1])
        inner = new.astype(np.int64) - first
        known = np.append(lengths, 1)  # the last entry: of an id
        lengths = np.concatenate([lengths, known[np.where(inner >= 0, inner, len(lengths))].sum(axis=1)])
        rules.append(new)
    return np.concatenate(rules), seq, first, lengths


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that ``seq`` stands for: all nonterminals are opened level by level."""
    seq = seq.astype(np.uint32)
    while True:
        at = np.flatnonzero(seq >= first) if len(rules) else np.zeros(0, np.int64)
        if not len(at):
            return seq
        width = np.ones(len(seq), np.int64)
        width[at] = 2
        place = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[place] = seq
        pair = rules[seq[at] - first]
        out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def pack_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The binary record of a block of documents with the given lengths."""
    rules, seq, first, expansions = compress(ids)
    head = np.array([len(rules), len(seq), len(lengths), first], "<u4")
    parts = [head, rules[:, 0], rules[:, 1], expansions, seq, np.asarray(lengths)]
    return MAGIC + b"".join(np.ascontiguousarray(p, "<u4").tobytes() for p in parts)


class Block:
    """Reader of one record."""

    def __init__(self, record: bytes):
        if record[:4] != MAGIC:
            raise ValueError("not a grammar block")
        n_rules, n_symbols, n_docs, self.first = (int(x) for x in np.frombuffer(record, "<u4", 4, 4))
        body = np.frombuffer(record, "<u4", offset=20)
        cut = np.cumsum([0, n_rules, n_rules, n_rules, n_symbols, n_docs])
        left, right, self.length, self.symbols, self.doc_lengths = (body[a:b] for a, b in zip(cut[:-1], cut[1:]))
        self.rules = np.stack([left, right], 1)
        self.doc_starts = np.concatenate([[0], np.cumsum(self.doc_lengths, dtype=np.int64)])
        width = np.ones(n_symbols, np.int64)
        nonterminal = self.symbols >= self.first if n_rules else np.zeros(n_symbols, bool)
        width[nonterminal] = self.length[self.symbols[nonterminal] - self.first]
        self.symbol_starts = np.concatenate([[0], np.cumsum(width)])

    def ids(self) -> np.ndarray:
        """All ids: every rule is opened once, then the symbols are looked up."""
        if not len(self.rules):
            return self.symbols.astype(np.uint32)
        opened = expand(np.arange(self.first, self.first + len(self.rules)), self.rules, self.first)
        table = np.concatenate([opened, self.symbols.astype(np.uint32)])  # a symbol that is an id stands for itself
        rule = self.symbols.astype(np.int64) - self.first
        start = np.where(rule >= 0, (np.cumsum(self.length, dtype=np.int64) - self.length)[np.maximum(rule, 0)], len(opened) + np.arange(len(rule)))
        shift = (start - self.symbol_starts[:-1]).astype(np.int32)
        at = np.repeat(shift, np.diff(self.symbol_starts))
        at += np.arange(len(at), dtype=np.int32)
        return table[at]

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` of the block; only the symbols that cover them are expanded."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.symbol_starts, start, "right")) - 1
        b = int(np.searchsorted(self.symbol_starts, stop, "left"))
        skip = start - int(self.symbol_starts[a])
        return expand(self.symbols[a:b], self.rules, self.first)[skip:skip + stop - start]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the block."""
        return self.range(int(self.doc_starts[i]), int(self.doc_starts[i + 1]))


# ---- encoding ----------------------------------------------------------------

def _byte_flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


# Bytes of white space other than space and line feed; punctuation that a pattern parts from a word before it;
# bytes of letters up to U+024F (a lead byte from C3 to C9 and what follows), on whose class all libraries agree.
_OTHER_SPACE = _byte_flags((0x09, 0x09), (0x0B, 0x0D), (0x1C, 0x1F))
_PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?%$#&*|\")]}"))
_LETTER = _byte_flags((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC9))


def _spaced_oddly(data: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 bytes where white space stands that isn't a space or a line feed between two other characters (or may stand)."""
    def ahead(k: int) -> np.ndarray:
        return np.concatenate([data[k:], np.zeros(min(k, len(data)), np.uint8)])

    one, two = ahead(1), ahead(2)
    wide = (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (data == 0xE1) & (one == 0x9A) & (two == 0x80)
    wide |= (data == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    wide |= (data == 0xE2) & (one == 0x81) & (two == 0x9F) | (data == 0xE3) & (one == 0x80) & (two == 0x80)
    gap = (data == 0x20) | (data == 0x0A)
    double = gap.copy()
    double[:-1] &= gap[1:]
    double[-1:] = False
    return np.flatnonzero(_OTHER_SPACE[data] | wide | double)


def _odd_letters(data: np.ndarray) -> np.ndarray:
    """Bytes that are no letter's: all but ASCII letters and two-byte letters up to U+024F."""
    odd = ~_LETTER[data]
    lead = (data >= 0xC3) & (data <= 0xC9)
    follows = np.zeros(len(data), bool)
    follows[1:] = lead[:-1]
    odd |= (data >= 0x80) & (data <= 0xBF) & ~follows
    sign = lead.copy()  # the signs of multiplication and division
    sign[:-1] &= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    sign[-1:] = False
    beyond = lead.copy()  # from U+0250 on
    beyond[:-1] &= (data[:-1] == 0xC9) & (data[1:] >= 0x90)
    beyond[-1:] = False
    return odd | sign | beyond


def _slices(texts: pa.Array, most: int):
    """Consecutive slices of a string column with about ``most`` bytes each (or one longer text)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


class _Known:
    """Ids of pieces of text by 128-bit hash: an open hash table in arrays; the most used half stays when it is full."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << 16, -1, np.int32)
        self.key, self.check, self.start, self.size, self.hits = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32))
        self.ids = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.key)

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key + _U(step)) & _U(len(self.slots) - 1)).astype(np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place of each piece, -1 if it isn't known."""
        out = np.full(len(key), -1)
        if not len(self.key):
            return out
        place = self.slots[self._slot(key, 0)]
        same = (self.key[place] == key) & (self.check[place] == check) & (place >= 0)
        out[same] = place[same]
        todo, step = np.flatnonzero(~same & (place >= 0)), 1
        while len(todo):  # the slot holds another piece: on to the next one, until a free one
            place = self.slots[self._slot(key[todo], step)]
            same = (self.key[place] == key[todo]) & (self.check[place] == check[todo]) & (place >= 0)
            out[todo[same]] = place[same]
            todo, step = todo[~same & (place >= 0)], step + 1
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[list[int]]) -> None:
        """Add distinct pieces that aren't known."""
        n = len(self.key)
        size = np.array([len(x) for x in ids], np.int32)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size, dtype=np.int64) - size])
        self.ids = np.concatenate([self.ids, np.array([x for i in ids for x in i], np.uint32)])
        self.key, self.check, self.size = (np.concatenate(x) for x in ((self.key, key), (self.check, check), (self.size, size)))
        self.hits = np.concatenate([self.hits, np.zeros(len(key), np.int32)])
        if 2 * len(self.key) > len(self.slots):
            self.slots, n = np.full(1 << (4 * len(self.key)).bit_length(), -1, np.int32), 0
        todo, step = np.arange(n, len(self.key)), 0
        while len(todo):
            at = self._slot(self.key[todo], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several that want one slot, one gets it
            todo, step = todo[self.slots[at] != todo], step + 1

    def shrink(self, most: int) -> None:
        if len(self.key) <= most:
            return
        keep = np.sort(np.argsort(-self.hits, kind="stable")[:most // 2])
        key, check, size, ids = self.key[keep], self.check[keep], self.size[keep], self.gather(keep)
        self._clear()
        ends = np.cumsum(size)
        self.add(key, check, [ids[a:b] for a, b in zip(ends - size, ends)])

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the pieces at ``at``, one after the other."""
        size = self.size[at].astype(np.int64)
        return self.ids[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Encoder:
    """Ids of whole texts, remembering pieces.

    The tokenizer's pattern never joins a space between two other
    characters with what stands before it, nor a line feed between two others
    with either side, nor letters with the punctuation behind them.  A text
    whose white space is only such spaces and line feeds may thus be cut there
    and its pieces encoded apart, each distinct one once; pieces are found and
    looked up for many texts at once.  Other texts, and texts that hold the
    string of an added token, are encoded in one call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        about = json.loads(self._tok.to_str())
        pre = about["pre_tokenizer"] or {}
        feed = self._tok.encode("\n", add_special_tokens=False).ids
        plain = about["normalizer"] is None and len(feed) == 1 and about["truncation"] is None and about["padding"] is None
        self._cuts = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self._model = self._tok.model.tokenize if about["model"].get("type") == "BPE" and not about["model"].get("dropout") else None
        self._added = [t.content.encode() for t in self._tok.get_added_tokens_decoder().values()]
        self._feed = feed[0] if feed else 0
        self.known = _Known()
        self._powers = ts._powers(ts._BASE, _HASHED + 1), ts._powers(ts._BASE_INV, _HASHED + 1)
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self._alphabet = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes], letters: np.ndarray) -> list[list[int]]:
        """Ids of pieces without line feeds; those of letters are one unit for the model, many others go in one call with line feeds between."""
        out: list = [None] * len(pieces)
        if self._model is not None:
            for i in np.flatnonzero(letters).tolist():
                out[i] = [t.id for t in self._model(pieces[i].decode("latin1").translate(self._alphabet))]
        rest = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(rest), 1000):
            part = rest[lo:lo + 1000]
            ids = self._tok.encode("\n".join(pieces[i].decode() for i in part), add_special_tokens=False).ids
            cut = [-1, *(k for k, x in enumerate(ids) if x == self._feed), len(ids)]
            for i, a, b in zip(part, cut[:-1], cut[1:]):
                out[i] = ids[a + 1:b]
        return out

    def _simple(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts may be cut."""
        simple = np.full(len(offsets) - 1, self._cuts)
        full = np.flatnonzero(np.diff(offsets))
        edge = np.concatenate([offsets[:-1][full], offsets[1:][full] - 1])
        edge = edge[(data[edge] == 0x20) | (data[edge] == 0x0A)]
        bad = [_spaced_oddly(data), edge]
        raw = data.tobytes()
        for token in self._added:
            at = raw.find(token)
            while at >= 0:
                bad.append(np.array([at]))
                at = raw.find(token, at + 1)
        simple[np.searchsorted(offsets, np.concatenate(bad), "right") - 1] = False
        return simple

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null texts have none."""
        return [ids for part in _slices(texts, PIECE_BYTES) for ids in self._piece(part)]

    def _piece(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = ts.text_buffer(texts)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        simple = self._simple(data, offsets)
        out: list = [None] * len(texts)
        odd = np.flatnonzero(~simple)
        for i, ids in zip(odd.tolist(), self._whole([t or "" for t in texts.take(pa.array(odd)).to_pylist()])):
            out[i] = ids
        if simple.any():
            if len(odd):
                texts = texts.filter(pa.array(simple))
                data, offsets = ts.text_buffer(texts)
            for i, ids in zip(np.flatnonzero(simple).tolist(), self._cut(data, offsets)):
                out[i] = ids
        return out

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of texts that may be cut."""
        start, end = ts.word_bounds(data, offsets, _NO_GAP)
        before = np.where(start > 0, data[np.maximum(start, 1) - 1], 0)
        at = np.searchsorted(start, offsets[:-1])
        at = at[at < len(start)]
        before[at[np.isin(start[at], offsets[:-1])]] = 0  # the first piece of a text
        spaced, fed = before == 0x20, before == 0x0A
        # Punctuation behind letters is a piece of its own.
        stem = end.copy()
        tail = np.arange(len(end))
        while len(tail):
            tail = tail[stem[tail] > start[tail]]
            tail = tail[_PUNCTUATION[data[stem[tail] - 1]]]
            stem[tail] -= 1
        strange = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_odd_letters(data), out=strange[1:])
        letters = (stem > start) & (strange[stem] == strange[start])
        parted = letters & (stem < end)
        n = 1 + parted
        at = np.cumsum(n) - n
        piece = np.repeat(np.arange(len(start)), n)
        second = np.ones(len(piece), bool)
        second[at] = False
        lo = np.where(second, stem[piece], start[piece])
        hi = np.where(parted[piece] & ~second, stem[piece], end[piece])
        spaced, fed, letters = spaced[piece] & ~second, fed[piece] & ~second, letters[piece] & ~second
        key, check = _hashes(data, lo, hi, spaced, self._powers)
        at = self.known.find(key, check)
        new = np.flatnonzero(at < 0)
        if len(new):
            order = np.lexsort((check[new], key[new]))
            k, c = key[new][order], check[new][order]
            distinct = np.ones(len(new), bool)
            distinct[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            first = new[order[distinct]]
            raw = data.tobytes()
            found = [(b" " if s else b"") + raw[a:b] for a, b, s in zip(lo[first].tolist(), hi[first].tolist(), spaced[first].tolist())]
            self.known.add(key[first], check[first], self._encode_pieces(found, letters[first]))
            at[new] = self.known.find(key[new], check[new])
        self.known.hits[at] += 1  # once per piece of text and call, which is enough to tell the used ones
        size = self.known.size[at].astype(np.int64) + fed
        ends = np.cumsum(size)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        feeds = (ends - size)[fed]
        rest = np.ones(len(ids), bool)
        rest[feeds] = False
        ids[feeds] = self._feed
        ids[rest] = self.known.gather(at)
        self.known.shrink(CACHED_PIECES)
        cut = np.concatenate([[0], ends])[np.searchsorted(lo, offsets)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


_NO_GAP = ~_byte_flags((0x20, 0x20), (0x0A, 0x0A))


_HASHED = 1 << 20  # bytes hashed at a time


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, flag: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values per byte range (in ascending order) and flag: a hash of all its bytes, and one of its first and last eight."""
    value = ts._byte_values()
    size = (end - start).astype(np.uint64)
    h = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        lo = int(start[a])
        b = max(a + 1, int(np.searchsorted(end, lo + _HASHED, "right")))
        hi = int(end[b - 1])
        power, inverse = powers if hi - lo <= _HASHED else (ts._powers(ts._BASE, hi - lo + 1), ts._powers(ts._BASE_INV, hi - lo + 1))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[data[lo:hi]] * power[:hi - lo], out=sums[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        h[a:b] = (sums[e] - sums[s]) * inverse[s]
        a = b
    h = ts.mix(h + size * _U(ts._ODD[4]) + flag.astype(np.uint64) * _U(ts._ODD[3]))
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 9, 8), (1, 1))
    first = eight[start + 8].view(np.uint64)[:, 0] << (_U(8) * (_U(8) - np.minimum(size, _U(8))) % _U(64))
    last = eight[end].view(np.uint64)[:, 0] >> (_U(8) * (_U(8) - np.minimum(size, _U(8))) % _U(64))
    check = ts.mix(first * _U(ts._ODD[0]) + ts.mix(last + size * _U(ts._ODD[1]) + flag.astype(np.uint64)))
    return h, check


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept with its pieces from task to task; one per tokenizer file."""
    kept = sys.modules.setdefault("_wirefold_worker_state", SimpleNamespace(encoders={}))
    about = os.stat(path)
    key = path, about.st_size, about.st_mtime_ns, CACHED_PIECES
    if key not in kept.encoders:
        kept.encoders.clear()
        kept.encoders[key] = Encoder(path)
    return kept.encoders[key]


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                       end_id: int = END_ID, block_ids: int = BLOCK_IDS, shards: int | None = None) -> None:
    """Encode all texts and write them in ascending id order as grammar blocks to the table at ``path``.

    ``tokenizer`` is a tokenizer file that every executor can open.  Columns:
    shard, block, n_ids, ids of the documents (``keys``), record.  Null texts
    are empty; a null id sorts first; equal ids sort by text.  A document is
    never cut; a very long one makes a large block of its own.
    """
    key_type = docs.schema[id_col].dataType.simpleString()
    schema = f"shard int, block int, n_ids long, keys array<{key_type}>, record binary"

    def encode(batches):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        enc = worker_encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        keys: list = []
        ids: list[np.ndarray] = []
        total = 0

        def flush():
            flat = np.concatenate([x for d in ids for x in (d, end)])
            record = pack_block(flat, np.array([len(d) + 1 for d in ids]))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([total], pa.int64()),
                 pa.array([keys], pa.list_(key_arrow)), pa.array([record], pa.binary())],
                ["shard", "block", "n_ids", "keys", "record"])

        key_arrow = None
        for b in batches:
            key_arrow = b.column("key").type
            lo = 0
            for part in _slices(b.column("text"), 4 * PIECE_BYTES):
                names = b.column("key").slice(lo, len(part)).to_pylist()
                lo += len(part)
                for key, x in zip(names, enc(part)):
                    keys.append(key)
                    ids.append(x)
                    total += len(x) + 1
                    if total >= block_ids:
                        yield flush()
                        keys, ids, total, block = [], [], 0, block + 1
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    shards = shards or max(docs.sparkSession.sparkContext.defaultParallelism, SHARDS_PER_SPLIT * docs.rdd.getNumPartitions())
    rows = rows.repartitionByRange(shards, "key", F.xxhash64("text"))
    rows.sortWithinPartitions("key", F.xxhash64("text"), "text").mapInArrow(encode, schema).write.parquet(path)


def read_token_blocks(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Decode the table at ``path``: id, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``.

    The offset of a block is a running sum over one row per block of its own
    shard, and a shard's over one row per shard.
    """
    table = spark.read.parquet(path)
    key_type = table.schema["keys"].dataType.elementType.simpleString()

    def decode(batches):
        for b in batches:
            for shard, block, keys, record in zip(*(b.column(c) for c in ("shard", "block", "keys", "record"))):
                r = Block(record.as_buffer().to_pybytes())
                ids = r.ids().astype("<u4")
                s = r.doc_starts
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(s[:-1], s[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()),
                     keys.values, pa.array(s[:-1], pa.int64()),
                     pa.array(r.doc_lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["shard", "block", "key", "at", "n_tokens", "ids_crc32"])

    rows = table.select("shard", "block", "keys", "record").mapInArrow(
        decode, f"shard int, block int, key {key_type}, at long, n_tokens long, ids_crc32 long")
    counts = table.select("shard", "block", "n_ids")
    shard_at = (counts.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "shard_at", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "shard_at"))
    block_at = counts.withColumn(
        "block_at", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).drop("n_ids")
    offsets = block_at.join(shard_at, "shard").select("shard", "block", (F.col("block_at") + F.col("shard_at")).alias("offset"))
    return rows.join(offsets, ["shard", "block"]).select(
        F.col("key").alias(id_col), (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the blocks below ``spark.checkpoint.dir`` and read them back (see the two functions above)."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-blocks")
    write_token_blocks(docs, path, tokenizer, **options)
    return read_token_blocks(spark, path, options.get("id_col", "doc_id"))
