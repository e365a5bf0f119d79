import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pyarrow as pa
import pytest

from wirefold.llm import importance_sample as S

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_force(docs, target, percent=5, min_words=20, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    out = []
    for doc, text in docs:
        n, fs = features(text)
        w = sum(gain[bucket(f)] for f in fs)
        h = int(sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((i for i, r in enumerate(out) if r[1] >= min_words), key=lambda i: (-out[i][4], out[i][0] is None, out[i][0]))
    rank = {i: k + 1 for k, i in enumerate(order[:percent * len(order) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(i)) for i, r in enumerate(out)), key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_draw_equals_brute_force(spark, docs, percent):
    target = spark.createDataFrame([("ban krd vel tix bass",), (None,), ("",), ("mord W1X1 nun\0ress",)], "text string")
    expected = brute_force(plain(docs), [r.text for r in target.collect()], percent)
    assert result(S.importance_resample(docs, target, percent=percent)) == expected


def test_empty_tables(spark, docs, no_docs):
    no_target = spark.createDataFrame([], "text string")
    assert result(S.importance_resample(no_docs, no_target)) == []
    assert result(S.importance_resample(docs, no_target)) == brute_force(plain(docs), [])
    short = docs.where("length(text) < 20 or text is null")  # nothing can be drawn
    assert result(S.importance_resample(short, no_target)) == brute_force(plain(short), [])


@pytest.mark.parametrize("block_rows, digit_bits", [(7, 3), (64, 11), (1000, 5)])
def test_radix_ranks_equal_a_sort(spark, block_rows, digit_bits):
    rng = random.Random(2)
    rows = [(i, rng.choice([5, -3, 2**40, -(2**62), 0, rng.randint(-50, 50)]), rng.choice([None, -(2**63), 2**63 - 1, rng.randint(0, 400)])) for i in range(300)]
    rows += [(1000 + i, 7, i % 40) for i in range(200)]  # one score holds many rows, ids repeat
    df = spark.createDataFrame(rows, "row long, score long, id long").repartition(5)
    ranks = {r.row: r["rank"] for r in S.radix_ranks(df, 450, digit_bits, block_rows).collect()}
    assert sorted(ranks.values()) == list(range(1, 451))
    by = {row: (-score, id is None, id or 0) for row, score, id in rows}
    inside = sorted(ranks, key=ranks.get)
    assert [by[r] for r in inside] == sorted(by.values())[:450]


def test_feature_buckets_of_long_and_odd_words():
    texts = ["a", "", None, "A b-C", "é" * 200 + " x\ty " + "q" * 65 + " " + "r" * 64, "0 1 2 3 \U0001F600"]
    for piece_bytes in (1, 4 << 20):
        S.ts.PIECE_BYTES, before = piece_bytes, S.ts.PIECE_BYTES
        try:
            found = [b.tolist() for _, f in S.feature_buckets(pa.array(texts)) for _, b in f]
        finally:
            S.ts.PIECE_BYTES = before
        assert Counter(x for b in found for x in b) == Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])


def test_ranks_do_not_depend_on_partitions(spark, docs):
    target = docs.select("text").limit(5)
    unique = docs.dropDuplicates(["doc_id"])
    assert result(S.importance_resample(unique.repartition(7), target, percent=50)) == result(S.importance_resample(unique.coalesce(1), target, percent=50))
