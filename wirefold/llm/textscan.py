"""Word and shingle hashing over whole Arrow batches with numpy.

A batch of texts is one byte buffer and a list of offsets, so words are found
and hashed for all texts at once: byte ``i`` adds ``value[byte] * B**i`` to a
running sum modulo 2**64, and a word's hash is the difference of the sum at
its two ends, divided by ``B**start`` (B is odd, hence invertible).  The cost
is a few passes over the buffer, whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 20  # bytes hashed at a time: bounds the temporary arrays
_ODD = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

# White space of the similarity join: space and \t \n \v \f \r; every other byte belongs to a word.
SPACES = np.array([b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) for b in range(256)])
# Words of the decontamination: digits, letters (after lower-casing) and everything beyond ASCII.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection), so that high bits are usable as bucket numbers."""
    h = h ^ (h >> _U(32))
    h *= _U(_ODD[2])
    h ^= h >> _U(29)
    h *= _U(_ODD[3])
    h ^= h >> _U(32)
    return h


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(_ODD[0])) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * _U(pow(base, k, 1 << 64))
        k += m
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


PIECE_BYTES = 4 << 20


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of a string column with a few megabytes of text each (or one longer text)."""
    lo, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= PIECE_BYTES:
            yield column.slice(lo, i + 1 - lo)
            lo, size = i + 1, 0
    if lo < len(column):
        yield column.slice(lo)


def word_bounds(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words; no word spans two texts."""
    n = len(data)
    inside = in_word[data]
    edge = np.empty(n + 1, bool)
    edge[0] = n > 0 and inside[0]
    edge[1:n] = inside[1:] != inside[:-1]
    edge[n] = n > 0 and inside[-1]
    inner = np.unique(offsets[1:-1])  # empty texts repeat an offset
    inner = inner[(inner > 0) & (inner < n)]
    joined = inner[inside[inner] & inside[inner - 1]]  # two texts meet inside a run of word bytes
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]), kind="stable")
    return at[0::2], at[1::2]


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
    """(start, end, hash, first) of the words: byte ranges, lower-cased hashes, and the index of each text's first word.

    ``first`` has one entry more than there are texts.
    """
    n = len(data)
    start, end = word_bounds(data, offsets, in_word)
    values, lower = _byte_values(), _lower_table()
    values = values[lower]
    h = np.empty(len(start), np.uint64)
    pow_, inv = _powers(_BASE, min(n, _STEP) + 1), _powers(_BASE_INV, min(n, _STEP) + 1)
    a = 0
    while a < len(start):
        lo = int(start[a])
        b = max(a + 1, int(np.searchsorted(end, lo + _STEP, "right")))
        hi = int(end[b - 1])
        if hi - lo > _STEP:  # one very long word
            pow_b, inv_b = _powers(_BASE, hi - lo + 1), _powers(_BASE_INV, 1)
        else:
            pow_b, inv_b = pow_, inv
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * pow_b[:hi - lo], out=sums[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        h[a:b] = (sums[e] - sums[s]) * inv_b[s]
        a = b
    h = mix(h + (end - start).astype(np.uint64) * _U(_ODD[4]))
    return start, end, h, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one text; of the whole sequence if it has fewer."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out *= _U(_ODD[0])
        out += h[j:n - k + 1 + j]
        out ^= out >> _U(31)
    return mix(out + _U(k))
