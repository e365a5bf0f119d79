"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

1. *Codes.*  On a bounded sample of unit vectors a principal-component
   projection and a rotation are learnt that minimise the distance between
   projected vectors and their signs (iterative quantisation); the signs are
   balanced binary codes.  Several rotations, from different starts, give as
   many codes as the tables need.
2. *Tables.*  The codes are cut into substrings, one table each.  Their width
   follows the number of vectors, and their number is such that a pair at the
   threshold shares a substring with probability ``RECALL``, by the measured
   rate of differing bits.  A table's row carries two of the codes, whatever
   the number of tables.  Within a table's bucket, pairs of one label whose
   codes are near in Hamming distance are tied; only the links of a spanning
   forest are kept.
3. *Rerank.*  The connected components of those ties are the candidate
   clusters.  In a cluster all pairs are compared with the original vectors in
   double precision, block by block; each pair lies in one block, so links are
   counted once and never listed.

Equal vectors of a label are one class with a number of copies, counted by
partial sums before anything else, so that copies are never compared.  Large
buckets and clusters are cut into chunks of bounded size, and each pair of
chunks is a unit of work.  Every vector length has its own codes and tables; a
length whose labels all fit in a chunk needs none, each of its labels is a
candidate cluster, and so is every label with ``exact``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import connected_components, materialize, runs

THRESHOLD = 0.93
SAMPLE_ROWS = 20_000  # vectors that the projection and rotations are learnt from, about
ITERATIONS = 30
RECALL = 0.997  # wanted share of threshold pairs that meet in a table
BUCKET_ROWS = 8  # wanted vectors per bucket of the largest label
CHUNK_ROWS = 512
_SIGMAS = 5  # of the Hamming distance of threshold pairs


# ---- codes -------------------------------------------------------------------

def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learn_rotations(sample: np.ndarray, count: int, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, projections[count, dim, bits])`` by iterative quantisation of unit vectors."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, basis = np.linalg.eigh(x.T @ x)
    basis = basis[:, ::-1][:, :bits]
    v = x @ basis
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(ITERATIONS):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        out.append(basis @ r)
    return mean, np.stack(out)


def sign_codes(x: np.ndarray, mean: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """Rows of bits: the signs under all projections."""
    return np.concatenate([(x - mean) @ p >= 0 for p in projections], axis=1)


def bit_difference(sample: np.ndarray, mean: np.ndarray, projections: np.ndarray, cosine: float, seed: int = 1) -> float:
    """Share of bits in which vectors at the given cosine differ, measured on neighbours made of the sample."""
    if sample.shape[1] == 1:
        return 0.0  # at any cosine above 0 the unit vectors are equal
    rng = np.random.default_rng(seed)
    x = sample[:2000]
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * unit_rows(z)
    return float((sign_codes(x, mean, projections) != sign_codes(y, mean, projections)).mean())


class Tables:
    """The learnt codes and the substrings that index them."""

    def __init__(self, sample: np.ndarray, largest_label: int):
        dim = sample.shape[1]
        bits = min(dim, 64)
        self.width = int(min(bits, max(6, math.ceil(math.log2(max(1, largest_label / BUCKET_ROWS))))))
        per_code = bits // self.width
        self.mean, one = learn_rotations(sample, 1, bits)
        rate = bit_difference(sample, self.mean, one, THRESHOLD)
        share = (1 - rate) ** self.width
        self.count = max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - share)) if share < 1 else 4)
        self.mean, self.projections = learn_rotations(sample, -(-self.count // per_code), bits)
        self.rotation = [t // per_code for t in range(self.count)]  # of each table
        compared = bits * min(2, len(self.projections))
        rate = bit_difference(sample, self.mean, self.projections, THRESHOLD)
        self.radius = math.ceil(rate * compared + _SIGMAS * math.sqrt(rate * (1 - rate) * compared))
        self.starts = [(t // per_code) * bits + (t % per_code) * self.width for t in range(self.count)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes[row, rotation] as 64-bit words, table keys[row, table]) of unit vectors."""
        code = sign_codes(x, self.mean, self.projections)
        weight = 1 << np.arange(self.width, dtype=np.int64)
        keys = np.stack([code[:, s:s + self.width] @ weight + (t << 40) for t, s in enumerate(self.starts)], axis=1)
        one = np.packbits(code.reshape(len(x), len(self.projections), -1), axis=2)
        words = np.pad(one, ((0, 0), (0, 0), (0, 8 - one.shape[2]))).view(np.uint64)[:, :, 0]
        return words, keys

    def carried(self, words: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """The two codes that the rows of a table carry: that of its rotation and the next one's (nothing if it is the only one)."""
        r = self.rotation[table]
        other = words[:, (r + 1) % words.shape[1]] if words.shape[1] > 1 else np.zeros(len(words), np.uint64)
        return words[:, r], other


# ---- vectors -----------------------------------------------------------------

def _vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Length per row (0: not comparable) and the vectors in double precision."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v.values) and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
            else:
                x = x / np.abs(x).max()  # so that no square overflows or vanishes
        out.append(x)
    return np.array([0 if x is None else len(x) for x in out], np.int32), out


def comparable_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(row, id, grp, dim, c1, c2, vector)``, written once; ``vector``: unit vector in binary doubles, null if not comparable.

    ``grp`` stands for label and length, ``(c1, c2)`` is a 128-bit hash of the vector.
    """

    def scan(batches):
        for b in batches:
            dim, vectors = _vectors(b.column("v"))
            binary = [None if x is None else (x / np.linalg.norm(x) + 0.0).tobytes() for x in vectors]  # no negative zeros
            digest = np.frombuffer(b"".join(blake2b(v or b"", digest_size=16).digest() for v in binary), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), b.column("label"), pa.array(dim), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                 pa.array(binary, pa.binary())], ["row", "id", "label", "dim", "c1", "c2", "vector"])

    source = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                         F.col(vector_col).alias("v"))
    id_type, label_type = (source.schema[c].dataType.simpleString() for c in ("id", "label"))
    return materialize(
        source.mapInArrow(scan, f"row long, id {id_type}, label {label_type}, dim int, c1 long, c2 long, vector binary")
        .withColumn("vector", F.when(F.col("label").isNotNull(), F.col("vector")))
        .withColumn("grp", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "dim"))).drop("label"), "vectors")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``(row, low, grp, dim, c1, c2, copies, vector)``: one row per distinct comparable vector of a label, named by its first row; ``low``: smallest id."""
    same = vectors.where("vector is not null").groupBy("grp", "c1", "c2").agg(
        F.min("row").alias("row"), F.min("id").alias("low"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    return materialize(same.select("row", "low", "grp", "dim", "c1", "c2", "copies", "vector"), "distinct-vectors")


def _units(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Cut groups of two rows or more into chunks; one copy of a row per pair of chunks ``(a, b)`` it belongs to."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1").select(
        *keys, F.ceil(F.col("size") / CHUNK_ROWS).cast("int").alias("chunks"))
    return (
        rows.join(sizes, keys)
        .withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*keys, "row", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), *payload)
        .repartition(*keys, "a", "b")
        .sortWithinPartitions(*keys, "a", "b", "row")
    )


def _ties(rows: np.ndarray, chunk: np.ndarray, codes: np.ndarray, radius: int, cross: bool) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius``."""
    comp = np.arange(len(rows))
    for i in range(len(rows) - 1):
        later = np.arange(i + 1, len(rows))
        later = later[comp[later] != comp[i]]
        if cross:
            later = later[chunk[later] != chunk[i]]
        if not len(later):
            continue
        near = later[np.bitwise_count(codes[later] ^ codes[i]).sum(axis=1, dtype=np.int64) <= radius]
        for j in near:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                yield int(rows[i]), int(rows[j])


def learn_tables(vectors: DataFrame, count: int, largest_label: int) -> Tables:
    """The tables of ``count`` vectors of one length, learnt from a sample of them (step 1)."""
    part = max(1, round(1_000_000 * min(1.0, SAMPLE_ROWS / count)))
    drawn = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < part).select("row", "vector").collect()  # about SAMPLE_ROWS
    if len(drawn) < 2:
        drawn = vectors.select("row", "vector").limit(1000).collect()
    sample = np.stack([np.frombuffer(r["vector"], np.float64) for r in sorted(drawn, key=lambda r: r["row"])])
    return Tables(sample, largest_label)


def candidate_ties(vectors: DataFrame, tables: dict[int, Tables]) -> DataFrame:
    """``(src, dst)`` rows whose components are the candidate clusters (step 2); ``tables`` by length of the vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(tables)

    def index(batches):
        for mixed in batches:
            dims = mixed.column("dim").to_numpy()
            for dim in np.unique(dims):
                t = shared.value[int(dim)]
                b = mixed.filter(pa.array(dims == dim))
                x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in b.column("vector")])
                words, keys = t.encode(x)
                for i in range(t.count):
                    code1, code2 = (pa.array(np.ascontiguousarray(c).view(np.int64)) for c in t.carried(words, i))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("grp"), pa.array(keys[:, i].copy()), b.column("row"), b.column("dim"), code1, code2],
                        ["grp", "bucket", "row", "dim", "code1", "code2"])

    def tie(batches):
        for t in runs(batches, ["grp", "bucket", "a", "b"]):
            codes = np.stack([t[c].to_numpy().view(np.uint64) for c in ("code1", "code2")], axis=1)
            cross = t["a"][0].as_py() != t["b"][0].as_py()
            radius = shared.value[t["dim"][0].as_py()].radius
            found = list(_ties(t["row"].to_numpy(), t["chunk"].to_numpy(), codes, radius, cross))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["src", "dst"])

    rows = vectors.select("grp", "row", "dim", "vector").mapInArrow(index, "grp long, bucket long, row long, dim int, code1 long, code2 long")
    return _units(rows, ["grp", "bucket"], ["dim", "code1", "code2"]).mapInArrow(tie, "src long, dst long")


def reranked_links(vectors: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """``(src, dst, n)``: links of a row to other vectors and their copies, counted per unit (``dst`` null), and the links of spanning forests (``n`` 0)."""

    def compare(batches):
        for t in runs(batches, ["root", "a", "b"]):
            rows, chunk = t["row"].to_numpy(), t["chunk"].to_numpy()
            x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in t["vector"]])
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if t["a"][0].as_py() != t["b"][0].as_py():
                linked &= chunk[:, None] != chunk[None, :]
            n = linked @ t["copies"].to_numpy()
            src, dst = [], []
            comp = np.arange(len(rows))
            for i in np.flatnonzero(n):
                for j in np.flatnonzero(linked[i] & (comp != comp[i])):
                    if comp[j] != comp[i]:
                        comp[comp == comp[j]] = comp[i]
                        src.append(rows[i])
                        dst.append(rows[j])
            with_links = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rows[with_links], np.array(src, np.int64)])),
                 pa.array([None] * len(with_links) + dst, pa.int64()),
                 pa.array(np.concatenate([n[with_links], np.zeros(len(src), np.int64)]))], ["src", "dst", "n"])

    members = clusters.join(vectors.select("row", "vector", "copies"), clusters["node"] == F.col("row")).select("root", "row", "vector", "copies")
    return materialize(_units(members, ["root"], ["vector", "copies"]).mapInArrow(compare, "src long, dst long, n long"), "links")


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                           threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` (smallest id reachable over links), ``kept``.

    Rows are compared if their labels are equal and not null.  Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths; all lengths are compared, each on its
    own (a length with more than ``CHUNK_ROWS`` vectors of a label costs one
    more pass for its sample).  Repeated rows are rows of their own and link
    with each other.  A row whose id is null stays; ids of a component are
    compared without nulls.  An empty table gives an empty result.

    With ``exact`` no index is used: all distinct vectors of a label are
    compared, in units of bounded size, and no link is missed.
    """
    vectors = comparable_vectors(rows, id_col, vector_col, label_col)
    distinct = distinct_vectors(vectors)
    per_group = distinct.groupBy("dim", "grp").count()
    dims = [] if exact else per_group.groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("largest")).where(
        F.col("largest") > CHUNK_ROWS).orderBy("dim").collect()
    indexed = F.col("dim").isin([d["dim"] for d in dims])
    # Groups that fit in a chunk are clusters as they are; negative roots are never rows.
    clusters = distinct.where(~indexed).select(F.col("row").alias("node"), F.col("grp").bitwiseOR(F.lit(-(1 << 63))).alias("root"))
    if dims:
        tables = {d["dim"]: learn_tables(distinct.where(F.col("dim") == d["dim"]), d["n"], d["largest"]) for d in dims}
        clusters = clusters.unionByName(connected_components(candidate_ties(distinct.where(indexed), tables)))
    links = reranked_links(distinct, clusters, threshold)
    counts = links.where("dst is null").groupBy(F.col("src").alias("row")).agg(F.sum("n").alias("others"))
    roots = connected_components(links.where("dst is not null").select("src", "dst")).withColumnRenamed("node", "row")
    classes = distinct.select("row", "low", "grp", "c1", "c2", "copies").join(counts, "row", "left").join(roots, "row", "left").select(
        "low", "grp", "c1", "c2", F.coalesce("root", "row").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = materialize(classes, "classes")
    smallest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(smallest, "root").select("grp", "c1", "c2", "n_links", "component_id")
    linked = vectors.where("vector is not null").select("id", "grp", "c1", "c2").join(classes, ["grp", "c1", "c2"]).select(
        "id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    alone = vectors.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = linked.unionByName(alone).select("id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return joined.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
