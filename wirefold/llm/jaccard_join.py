"""Exact n-gram Jaccard join by parity sketches, and the groups of linked documents.

A document's set holds the hashes of its distinct k-word shingles.  Two sets
with Jaccard similarity >= t differ in at most ``(1-t)/(1+t) * (|A|+|B|)``
shingles, hence in at most ``D(s) = (1-t)/t * s`` of them, s being either
size.  The steps:

1. *Parity sketch.*  The hash space is cut into ``m`` buckets, m set by the
   size band (powers of two); each bucket XORs its shingles' hashes.  A
   differing shingle changes one bucket, so linked sets agree in all but D
   buckets (pigeonhole).  A set also emits the sketch of the next smaller
   band where it may be the larger partner.  A set with at most D non-empty
   buckets emits its single shingles as well, which restores the guarantee.
2. *Pigeonhole join.*  Signatures (bucket, XOR value) shared by two sets are
   ordered by frequency.  Linked sets share all but D signatures, so they
   share one among the D+1 rarest of each.  Unshared ones are rarest: a set
   with more than D of them has no partner and leaves at once, and a passage
   that thousands of documents share is never joined on.  The signatures of a
   block of sets travel packed, sorted and shortened, to the partitions of the
   hash space, which count them over all blocks and answer with the shared
   ones; a block then picks the rarest of each of its sets.  A signature that
   many sets of a block hold is one entry of the block, so that none is hot.
3. *Clusters.*  In each signature group all members are tied to the smallest
   one, and the connected components of that star graph are the clusters: all
   linked pairs lie within one.  Passages that documents happen to share tie
   ever more of them together as the corpus grows, so in a large cluster bit
   sketches are compared first (each shingle flips one bit; the Hamming distance
   is a lower bound of the symmetric difference): sets that may be linked by
   their sketches are tied anew, and the components of that are the clusters.
   A cluster is cut into chunks of bounded size, and every pair of chunks is
   one unit of work.
4. *Verification.*  In a unit a bit sketch discards most pairs, the rest are
   compared exactly; pairs that are connected already are skipped, and only
   the links of a spanning forest are emitted.

No link between different sets is lost and no pair list is ever built.  Sets
with equal members form one class; the documents of a class share its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm import textscan as ts
from wirefold.llm.common import connected_components, from_planes, id_bitmap, in_bitmap, materialize, planes, runs

SHINGLE_WORDS = 5
THRESHOLD = (75, 100)  # similarity >= 75 / 100, compared in integers
PER_BUCKET = 2.5  # shingles per bucket at the upper end of a size band
CHUNK_ROWS = 2048  # documents per chunk of a cluster
CHUNK_SHINGLES = 1 << 21  # shingles per chunk of a cluster (16 MB)
LOOSE_ROWS = 256  # documents of a cluster whose sketches are compared before its sets are sent
SKETCH_ROWS = 1 << 15  # sketches per chunk of such a cluster
SKETCH_BYTES = 1 << 24  # bytes of them
BLOCK_SIGNATURES = 1 << 20  # signatures that are sorted and sent together
PART_SIGNATURES = 1 << 21  # signatures per partition of the hash space, about
COMMON = 16  # sets of a block that share a signature which is then one entry
SPARE_BITS = 8  # shortened signatures: two different ones are equal with probability 2**-8 at most
BROADCAST_COPIES = 1_000_000  # ids of copies and of linked documents that are broadcast (8 MB); beyond, they are joined by a shuffle
SKETCH_WORDS = 512  # widest bit sketch in 64-bit words; sets beyond 8,192 shingles are filtered less sharply
_U = np.uint64
_C = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


def text_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: the shingle hashes of all texts (sorted and distinct per text), each text's first, its number of words."""
    for part in ts.pieces(texts):
        data, offsets = ts.text_buffer(part)
        _, _, h, word = ts.words(data, offsets, ts.SPACES)
        n = np.diff(word)
        out = np.zeros(len(h), np.uint64)  # of the run that starts at a word
        for m in range(1, k + 1):  # texts of fewer words are one run
            at = np.flatnonzero(n == m) if m < k else np.flatnonzero(n >= k)
            start = word[at] if m < k else np.repeat(word[at] - np.cumsum(n[at] - k + 1) + (n[at] - k + 1), n[at] - k + 1)
            start = start + np.arange(len(start)) if m == k else start
            x = np.zeros(len(start), np.uint64)
            for j in range(m):
                x *= _U(ts._ODD[0])
                x += h[start + j]
                x ^= x >> _U(31)
            out[start] = ts.mix(x + _U(m))
        count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
        first = np.cumsum(np.concatenate([[0], count]))
        place = np.arange(first[-1]) + np.repeat(word[:-1] - first[:-1], count)
        out = out[place]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            out[a:b].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[first[:-1][count > 0]] = True
        total = np.concatenate([[0], np.cumsum(new)])
        yield out[new], total[first], n


def _class_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """62-bit fingerprints of the sets (0 for empty ones); the two low bits stay free for the sketch's kind."""
    out = np.zeros(len(first) - 1, np.int64)
    size = np.diff(first)
    full = np.flatnonzero(size)
    if len(full):
        x, at = ts.mix(h * _C[0]), first[:-1][full]
        x = np.bitwise_xor.reduceat(x, at) + np.add.reduceat(x, at) * _C[1]
        out[full] = (ts.mix(x + size[full].astype(np.uint64)) & ~_U(3)).view(np.int64)
    return out


def _max_diff(size):
    """Most shingles in which a set of ``size`` can differ from a linked set."""
    num, den = THRESHOLD
    return size * (den - num) // num


def set_signatures(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, set of each signature, signatures) of all sets; kind: bit 0 the next smaller band, bit 1 single shingles."""
    num, den = THRESHOLD
    size = np.diff(first)
    band = np.frexp(size.astype(np.float64))[1] - 1
    for low in (0, 1):
        use = size > 0
        if low:
            use &= (band > 0) & (size * num < (np.int64(1) << np.maximum(band, 0)) * den)
        inside = np.repeat(use, size)
        of = np.repeat(np.arange(len(size)), size)[inside]
        if not len(of):
            continue
        s, b = h[inside], (band - low).astype(np.uint64)
        m = (np.ceil(2.0 ** (band - low + 1) / PER_BUCKET) + 2).astype(np.uint64)
        bucket = ((s >> _U(32)) * m[of]) >> _U(32)
        change = np.ones(len(of), bool)
        change[1:] = (bucket[1:] != bucket[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(change)
        sig = np.bitwise_xor.reduceat(s, at) * _C[1] ^ ts.mix(bucket[at] * _C[2] + b[of[at]])
        yield low, of[at], sig
        few = use & (np.bincount(of[at], minlength=len(size)) <= _max_diff(size))
        single = few[of]
        yield low | 2, of[single], ts.mix(s[single] * _C[2] + b[of[single]] + _U(64))


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                  **others: Column) -> DataFrame:
    """Per document: id, ``others``, ``n_shingles`` (set size), ``n_words`` and ``class_id`` (null for an empty set), without a shuffle."""
    kept = [F.col(id_col).alias("id"), *(c.alias(name) for name, c in others.items())]
    names = ["id", *others]
    schema = docs.select(*kept).schema.add("n_shingles", "long").add("n_words", "long").add("class_id", "long")

    def scan(batches):
        for b in batches:
            out = [(np.diff(first), n, _class_ids(h, first)) for h, first, n in text_sets(b.column("text"), k)]
            size, words, cls = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [*(b.column(name) for name in names), pa.array(size), pa.array(words), pa.array(cls, mask=size == 0)],
                [*names, "n_shingles", "n_words", "class_id"])

    return docs.select(*kept, F.col(text_col).alias("text")).mapInArrow(scan, schema)


# ---- pigeonhole join ---------------------------------------------------------
# Packed rows (part, block, kind, a, b, c).  LIGHT: signatures and their owners; HEAVY: signatures and how many owners
# they have; LISTS: the owners of the heavy ones; OWNERS: class with the sketch's kind in its low bits, and spare =
# D + 1 - signatures of that kind.  The first two go to the partitions of the hash space, the others to their block.

_ROW = "part long, block long, kind int, a binary, b binary, c binary"
LIGHT, HEAVY, LISTS, OWNERS = range(4)


def _squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes, their size in front."""
    raw = planes(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loose(data: pa.Scalar, kind) -> np.ndarray:
    raw = data.as_buffer()
    size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    return from_planes(pa.decompress(raw.slice(8), decompressed_size=size, codec="zstd"), kind)


def _packed(part: int, block: int, kind: int, *arrays: np.ndarray) -> tuple:
    return (part, block, kind, *(_squeezed(x) for x in arrays), *[None] * (3 - len(arrays)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["part", "block", "kind", "a", "b", "c"])


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of sorted values: small numbers, which compress."""
    return np.diff(sorted_values, prepend=_U(0))


def _unsteps(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(_loose(data, np.uint64), dtype=np.uint64)


def _by_signature(sig: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by signature, then owner."""
    width = max(1, int(of.max(initial=0)).bit_length())
    if bits + width <= 64:
        both = np.sort(sig << _U(width) | of.astype(np.uint64))
        return both >> _U(width), (both & _U((1 << width) - 1)).astype(np.uint32)
    order = np.lexsort((of, sig))
    return sig[order], of[order].astype(np.uint32)


def _block_rows(block: int, sig: np.ndarray, of: np.ndarray, owner: np.ndarray, spare: np.ndarray, bits: int, parts: int) -> list[tuple]:
    """The packed rows of a block of sets."""
    sig, of = _by_signature(sig >> _U(64 - bits), of, bits)
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    times = np.diff(np.append(start, len(sig)))
    common = times >= COMMON
    light = ~np.repeat(common, times)
    home = parts + (block + (block >> 32)) % parts  # any partition that only passes rows on
    rows = [_packed(home, block, OWNERS, owner, spare.astype(np.int32))]
    if common.any():
        rows.append(_packed(home, block, LISTS, _steps(sig[start[common]]), times[common].astype(np.uint32), of[~light]))
    log2 = parts.bit_length() - 1
    for kind, s, x in ((LIGHT, sig[light], of[light]), (HEAVY, sig[start[common]], times[common].astype(np.uint32))):
        part = (s >> _U(bits - log2)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(s) else []
        rows += [_packed(int(part[i]), block, kind, _steps(s[i:j]), x[i:j]) for i, j in zip(cut, [*cut[1:], len(s)])]
    return rows


def signature_blocks(docs: DataFrame, bits: int, parts: int, text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """Packed rows of all sets' signatures.  A task sends a class once (it remembers up to a million of them)."""

    def scan(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        n_owners = n = 0

        def flush() -> pa.RecordBatch:
            sig, of, owner, spare = (np.concatenate(x) for x in zip(*held))
            return _rows(_block_rows(block, sig, of, owner, spare, bits, parts))

        for b in batches:
            for h, first, _ in text_sets(b.column("text"), k):
                cls, size = _class_ids(h, first), np.diff(first)
                new = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):
                    if size[i] and c not in seen:
                        new[i] = True
                        if len(seen) < 1_000_000:
                            seen.add(c)
                h, cls, size = h[np.repeat(new, size)], cls[new], size[new]
                for kind, of, sig in set_signatures(h, np.cumsum(np.concatenate([[0], size]))):
                    sets, of, times = np.unique(of, return_inverse=True, return_counts=True)
                    held.append((sig, of + n_owners, cls[sets] | kind, _max_diff(size[sets]) + 1 - times))
                    n_owners += len(sets)
                    n += len(sig)
                if n >= BLOCK_SIGNATURES:
                    yield flush()
                    held, n_owners, n, block = [], 0, 0, block + 1
        if n:
            yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(scan, _ROW)


def _count_partition(t: pa.Table) -> Iterator[tuple]:
    """Per packed row of a partition the signatures that have more than one owner, and how many."""
    values = [(_unsteps(a), _loose(b, np.uint32)) for a, b in zip(t["a"], t["b"])]
    cut = np.cumsum([0, *(len(s) for s, _ in values)])
    sig = np.concatenate([s for s, _ in values])
    kinds, blocks = t["kind"].to_pylist(), t["block"].to_pylist()
    weight = np.concatenate([x.astype(np.int64) if kind == HEAVY else np.ones(len(x), np.int64) for kind, (_, x) in zip(kinds, values)])
    order = np.argsort(sig)
    ordered = sig[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.empty(len(sig), np.int64)
    total[order] = np.repeat(np.add.reduceat(weight[order], start), np.diff(np.append(start, len(sig))))
    for i, (s, x) in enumerate(values):
        n = total[cut[i]:cut[i + 1]]
        at = np.flatnonzero(n > 1)
        if len(at):
            yield _packed(0, blocks[i], kinds[i], _steps(s[at]), n[at], x[at])


def _block_prefixes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(signature, class) of the rarest signatures of a block's sets, as far as they are shared."""
    rows = list(zip(t["kind"].to_pylist(), t["a"], t["b"], t["c"]))
    owner, spare = next((_loose(a, np.int64), _loose(b, np.int32)) for kind, a, b, _ in rows if kind == OWNERS)
    parts = [(_unsteps(a), _loose(b, np.int64), _loose(c, np.uint32)) for kind, a, b, c in rows if kind == LIGHT]
    counted = [(_unsteps(a), _loose(b, np.int64)) for kind, a, b, _ in rows if kind == HEAVY]
    if counted:  # each is in a list of the block
        known, n = (np.concatenate(x) for x in zip(*counted))
        by = np.argsort(known)
        for kind, a, b, c in rows:
            if kind == LISTS:
                s, times = _unsteps(a), _loose(b, np.uint32)
                parts.append((np.repeat(s, times), np.repeat(n[by][np.searchsorted(known[by], s)], times), _loose(c, np.uint32)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sig, n, of = (np.concatenate(x) for x in zip(*parts))
    room = spare + np.bincount(of, minlength=len(owner))
    sig, n, of = (x[room[of] > 0] if len(of) else x for x in (sig, n, of))
    order = np.lexsort((sig, n, of))
    sig, of = sig[order], of[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    kept = rank < room[of]
    return sig[kept], owner[of[kept]] & ~np.int64(3)


def candidate_edges(docs: DataFrame, n_shingles: int, text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``(src, dst)`` class pairs whose components hold every linked pair (steps 2 and 3).

    ``n_shingles``: shingles of all sets, about; it sets the length of the
    shortened signatures and the number of partitions.
    """
    bits = min(64, max(32, n_shingles.bit_length() + SPARE_BITS))
    parts = 1 << max(5, (n_shingles // PART_SIGNATURES).bit_length())

    def count(batches):
        for t in runs(batches, ["part"]):
            if t["part"][0].as_py() >= parts:
                yield t.combine_chunks().to_batches()[0]
                continue
            rows = list(_count_partition(t))
            if rows:
                yield _rows(rows)

    def pick(batches):
        for t in runs(batches, ["block"]):
            sig, cls = _block_prefixes(t)
            if len(sig):
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls)], ["sig", "src"])

    blocks = signature_blocks(docs, bits, parts, text_col, k)
    answers = materialize(blocks.repartition("part").sortWithinPartitions("part").mapInArrow(count, _ROW), "shared-signatures")
    prefix = materialize(answers.repartition("block").sortWithinPartitions("block").mapInArrow(pick, "sig long, src long"), "prefixes")
    lowest = prefix.groupBy("sig").agg(F.min("src").alias("dst"), F.max("src").alias("last")).where("dst <> last").select("sig", "dst")
    return prefix.join(lowest, "sig").where("src <> dst").select("src", "dst").distinct()


def first_texts(docs: DataFrame, full: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` but those whose id represents no class.  All classes remain, most copies go."""
    of_id = full.join(classes.select("class_id", "rep"), "class_id").groupBy("id").agg(F.bool_or(F.col("id") == F.col("rep")).alias("own"))
    copies = materialize(of_id.where("not own").select(F.col("id").alias("_copy")), "copies")
    if copies.count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)
    return docs.join(copies, docs[id_col] == copies["_copy"], "left_anti")


# ---- large clusters ----------------------------------------------------------
# Sketches are as wide as their size band (powers of two) wants, so that all of a band can be compared.  A set that may
# be the larger partner of one of the next smaller band is a guest there: linked sets meet in the smaller one's band.

def _sketch_log2(band: int) -> int:
    """Bits of a band's sketches as a power of two: four to eight per shingle, up to ``SKETCH_WORDS``."""
    return min(max(band + 3, 6), (SKETCH_WORDS * 64).bit_length() - 1)


def set_sketches(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(band, guests, sets, a row of bytes per set) of all sets."""
    num, den = THRESHOLD
    size = np.diff(first)
    band = np.frexp(size.astype(np.float64))[1] - 1
    for guest in (False, True):
        use = size > 0
        if guest:
            use &= (band > 0) & (size * num < (np.int64(1) << np.maximum(band, 0)) * den)
        for v in np.unique(band[use]).tolist():
            log2 = _sketch_log2(v - guest)
            of = np.flatnonzero(use & (band == v))
            step = max(1, (1 << 21) >> log2)
            for i in range(0, len(of), step):
                sets = of[i:i + step]
                n = size[sets]
                at = np.arange(n.sum()) + np.repeat(first[:-1][sets] - (np.cumsum(n) - n), n)
                bit = ((h[at] & _U(0xFFFFFFFF)) >> _U(32 - log2)).astype(np.int64) + (np.repeat(np.arange(len(sets)), n) << log2)
                odd = (np.bincount(bit, minlength=len(sets) << log2) & 1).astype(np.uint8)
                yield v - guest, guest, sets, np.packbits(odd).reshape(len(sets), -1)


def _near_links(ids: np.ndarray, n: np.ndarray, guest: np.ndarray, side: np.ndarray, bits: np.ndarray, cross: bool) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of a unit that may be linked by their sketches; ``cross``: only between its two sides."""
    num, den = THRESHOLD
    words = bits.shape[1]
    wide = max(1, words // 4)
    folded = np.bitwise_xor.reduce(bits.reshape(len(bits), words // wide, wide), axis=1)  # a sketch too, which discards nearly all
    parts = []
    for s in (0, 1) if cross else (0,):
        rows = np.flatnonzero(side == s) if cross else np.arange(len(ids))
        rows = rows[np.argsort(n[rows], kind="stable")]
        parts.append((rows, n[rows].astype(np.int64), np.ascontiguousarray(folded[rows].T)))
    comp = np.arange(len(ids))
    for x, y in ((0, 1), (1, 0)) if cross else ((0, 0),):
        rows, sizes, narrow = parts[x]
        others, other_sizes, other_narrow = parts[y]
        for i in range(int((~guest[rows]).sum())):  # guests are larger than all others
            lo = int(np.searchsorted(other_sizes, sizes[i], "right" if x else "left")) if cross else i + 1
            hi = int(np.searchsorted(other_sizes, sizes[i] * den // num, "right"))
            at = rows[i]
            if hi <= lo or not (free := comp[others[lo:hi]] != comp[at]).any():
                continue
            most = (other_sizes[lo:hi] + sizes[i]) * (den - num) // (den + num)
            distance = np.zeros(hi - lo, np.int32)
            for w in range(wide):
                distance += np.bitwise_count(other_narrow[w, lo:hi] ^ narrow[w, i])
            near = np.flatnonzero(free & (distance <= most))
            if len(near):
                distance = np.bitwise_count(bits[others[lo + near]] ^ bits[at]).sum(axis=1, dtype=np.int64)
                for j in others[lo + near[distance <= most[near]]]:
                    if comp[j] != comp[at]:
                        comp[comp == comp[j]] = comp[at]
                        yield int(ids[at]), int(ids[j])


def close_clusters(docs: DataFrame, classes: DataFrame, clusters: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   k: int = SHINGLE_WORDS) -> DataFrame:
    """``clusters(node, root)``, those beyond ``LOOSE_ROWS`` split where no two sets may be linked by their sketches."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > LOOSE_ROWS).select("root")
    loose = materialize(clusters.join(sizes, "root").join(classes, F.col("node") == F.col("class_id")).select("root", "class_id", "rep"), "loose")
    if loose.isEmpty():
        return clusters
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(loose, F.col("rep")))

    def sketch(batches):
        seen: set[int] = set()
        for b in batches:
            b = b.filter(pa.array(in_bitmap(bitmap.value, b.column("h").to_numpy())))
            for h, first, _ in text_sets(b.column("text"), k):
                cls, size = _class_ids(h, first), np.diff(first)
                new = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):
                    if size[i] and c not in seen:
                        new[i] = True
                        if len(seen) < 1_000_000:
                            seen.add(c)
                h, cls, size = h[np.repeat(new, size)], cls[new], size[new]
                for band, guest, sets, bits in set_sketches(h, np.cumsum(np.concatenate([[0], size]))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cls[sets]), pa.array(np.full(len(sets), band, np.int32)), pa.array(np.full(len(sets), guest)),
                         pa.array(size[sets]), pa.array([row.tobytes() for row in bits], pa.binary())],
                        ["class_id", "band", "guest", "n", "bits"])

    sketches = (
        docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
        .mapInArrow(sketch, "class_id long, band int, guest boolean, n long, bits binary")
        .dropDuplicates(["class_id", "guest"])
    )
    rows = materialize(loose.select("root", "class_id").join(sketches, "class_id"), "sketches")
    row_bytes = F.expr(f"shiftleft(1L, least(greatest(band + 3, 6), {_sketch_log2(99)}) - 3)")
    # A row per large cluster and size band.
    chunks = rows.groupBy("root", "band").agg(F.count("*").alias("rows"), F.bool_and("guest").alias("idle")).where("rows > 1 and not idle").select(
        "root", "band", F.ceil(F.greatest(F.col("rows") / SKETCH_ROWS, F.col("rows") * row_bytes / SKETCH_BYTES)).cast("int").alias("chunks"))
    units = (
        rows.join(F.broadcast(chunks), ["root", "band"])
        .withColumn("chunk", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("root", "band", "class_id", "guest", "n", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "bits")
    )

    def compare(batches):
        for unit in runs(batches, ["root", "band", "a", "b"]):
            a, b = unit["a"][0].as_py(), unit["b"][0].as_py()
            bits = np.frombuffer(b"".join(unit["bits"].to_pylist()), np.uint64).reshape(unit.num_rows, -1)
            links = list(_near_links(unit["class_id"].to_numpy(), unit["n"].to_numpy(), unit["guest"].to_numpy(),
                                     (unit["chunk"].to_numpy() != a).astype(np.int8), bits, a != b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["src", "dst"])

    near = units.repartition("root", "band", "a", "b").sortWithinPartitions("root", "band", "a", "b", "class_id").mapInArrow(
        compare, "src long, dst long")
    return clusters.join(loose.select("root").distinct(), "root", "left_anti").select("node", "root").unionByName(connected_components(near))


# ---- verification ------------------------------------------------------------

def _bit_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set, four bits per shingle of the largest up to ``SKETCH_WORDS``; every shingle flips one bit."""
    words = min(SKETCH_WORDS, max(1, -(-4 * max(map(len, sets)) // 64)))
    out = np.zeros((len(sets), words), np.uint64)
    for row, s in zip(out, sets):
        at = (((s & _U(0xFFFFFFFF)) * _U(words * 64)) >> _U(32)).astype(np.int64)
        row[:] = np.packbits((np.bincount(at, minlength=words * 64) & 1).astype(np.uint8)).view(np.uint64)
    return out


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    num, den = THRESHOLD
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _unit_links(ids: np.ndarray, chunk: np.ndarray, sets: list[np.ndarray], cross: bool) -> Iterator[tuple[int, int]]:
    """The links of a spanning forest of one unit; ``cross``: only between its two chunks."""
    num, den = THRESHOLD
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    ids, chunk, n = ids[order], chunk[order], n[order]
    sets = [sets[i] for i in order]
    bits = _bit_sketches(sets)
    comp = np.arange(len(ids))
    for i in range(len(ids)):
        end = int(np.searchsorted(n, n[i] * den // num, "right"))
        later = np.arange(i + 1, end)
        later = later[comp[later] != comp[i]]
        if cross:
            later = later[chunk[later] != chunk[i]]
        if not len(later):
            continue
        distance = np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for j in later[distance * (den + num) <= (n[later] + n[i]) * (den - num)]:
            if comp[j] != comp[i] and _similar(sets[i], sets[j]):
                comp[comp == comp[j]] = comp[i]
                yield int(ids[i]), int(ids[j])


def verified_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``(src, dst)`` links that span each component exactly (step 4).

    ``classes(class_id, rep, n_shingles)``: one document per class;
    ``clusters(node, root)``: the classes that may have partners.
    """
    members = materialize(clusters.join(classes, clusters["node"] == classes["class_id"])
                          .select("root", "class_id", "rep", "n_shingles"), "members")
    sizes = members.groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    units = (
        members.join(sizes, "root")
        .withColumn("chunk", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("root", "class_id", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    )
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(members, F.col("rep")))

    def recompute(batches):
        seen: set[int] = set()
        for b in batches:
            b = b.filter(pa.array(in_bitmap(bitmap.value, b.column("h").to_numpy())))
            cls, sets = [], []
            for h, first, _ in text_sets(b.column("text"), k):
                for c, x, y in zip(_class_ids(h, first).tolist(), first[:-1].tolist(), first[1:].tolist()):
                    if x == y or c in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    cls.append(c)
                    sets.append(planes(_steps(h[x:y])))
            for i in range(0, len(cls), 256):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[i:i + 256], pa.int64()), pa.array(sets[i:i + 256], pa.binary())], ["class_id", "members"])

    sets = (
        docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
        .mapInArrow(recompute, "class_id long, members binary")
        .dropDuplicates(["class_id"])
    )  # one set per class, whatever copies the bitmap lets through; the join below drops other classes

    def verify(batches):
        for unit in runs(batches, ["root", "a", "b"]):
            ids = unit["class_id"].to_numpy()
            ids, at = np.unique(ids, return_index=True)
            if len(ids) < 2:
                continue
            cross = unit["a"][0].as_py() != unit["b"][0].as_py()
            arrays = [np.cumsum(from_planes(unit["members"][int(i)], np.uint64), dtype=np.uint64) for i in at]
            links = list(_unit_links(ids, unit["chunk"].to_numpy()[at], arrays, cross))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["src", "dst"])

    return (
        units.join(sets, "class_id")
        .repartition("root", "a", "b")
        .sortWithinPartitions("root", "a", "b", "class_id")
        .mapInArrow(verify, "src long, dst long")
    )


def class_links(docs: DataFrame, full: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                k: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """``classes(class_id, rep, n_shingles)`` of the documents with a set and the links ``(src, dst)`` between classes."""
    classes = materialize(
        full.groupBy("class_id").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n_shingles")), "classes")
    firsts = first_texts(docs, full, classes, id_col)
    n_shingles = classes.agg(F.sum("n_shingles")).first()[0] or 0
    candidates = materialize(candidate_edges(firsts, n_shingles, text_col, k), "candidates")
    clusters = close_clusters(firsts, classes, connected_components(candidates), id_col, text_col, k)
    return classes, materialize(verified_links(firsts, classes, clusters, id_col, text_col, k), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (smallest id linked directly or over others).

    Null or wordless texts have an empty set (``n_shingles`` 0) and are
    linked with nothing.  Repeated rows and equal texts are linked.  A null id
    is never a component id unless all ids of the component are null.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    info = materialize(document_sets(docs, id_col, text_col, k), "sets")
    full = info.where("class_id is not null")
    classes, links = class_links(docs, full, id_col, text_col, k)
    roots = connected_components(links)
    of_class = classes.join(roots, classes["class_id"] == roots["node"], "left").select(
        "class_id", "rep", F.coalesce("root", "class_id").alias("root"))
    smallest = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(smallest, "root").select("class_id", "component_id")
    linked = full.join(of_class, "class_id").select("id", "n_shingles", "component_id")
    alone = info.where("class_id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)


def drop_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` but those linked to a smaller id; columns stay as they are.

    Rows with a null id or an empty set stay; rows that share the smallest id
    of their group all stay, as ids are taken to name documents.
    """
    dropped = materialize(jaccard_components(docs, id_col, text_col, k).where(F.col("component_id") < F.col(id_col)).select(
        F.col(id_col).alias("_dropped")).distinct(), "dropped")
    if dropped.count() <= BROADCAST_COPIES:  # else the texts are shuffled
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")
