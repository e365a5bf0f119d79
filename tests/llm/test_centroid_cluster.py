import math
from hashlib import sha256

import numpy as np
import pytest

from wirefold.llm import centroid_cluster as C


def vectors(spark, scale=1.0):
    rng = np.random.default_rng(8)
    middle = rng.standard_normal((9, 64))
    rows = [(i, (middle[i % 9] * scale + rng.standard_normal(64) * 0.4 * scale).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(80)] + [(3, rows[3][1]), (None, rows[4][1]), (None, rows[5][1])]
    rows += [(600, None), (601, []), (602, [0.5] * 63), (603, [0.5] * 65), (604, [None] + [0.5] * 63), (605, [float("nan")] * 64),
             (606, [float("-inf")] + [0.0] * 63), (607, [0.0] * 64), (608, [-0.001] * 64)]
    return spark.createDataFrame([(a, b, 1, "x", 2, 3.0) for a, b in rows],
                                 "vec_id long, embedding array<double>, cluster int, ids string, distance int, inertia double")


def brute_force(rows, k=40, rounds=5):
    """Lloyd's rounds in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        x, c = np.array([v for _, v in kept], dtype=object), np.array(centroids, dtype=object)
        d = np.stack([((x - m) ** 2).sum(axis=1) for m in c], axis=1)
        return [(min(range(len(row)), key=lambda j: (row[j], j))) for row in d], d

    for _ in range(rounds):
        best, _ = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), b in zip(kept, best) if b == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    best, d = assign()
    inertia = [sum(int(d[i][b]) for i, b in enumerate(best) if b == j) for j in range(len(centroids))]
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, b, int(d[n][b]), inertia[b], sum(inertia), digest[b]) for n, ((i, _), b) in enumerate(zip(kept, best))), key=repr)


def result(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("scale, block_rows", [(1.0, 1 << 14), (1.0, 13), (1e4, 64)])
def test_clusters_equal_brute_force(spark, scale, block_rows):
    df = vectors(spark, scale).repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(C.cluster_report(df, block_rows=block_rows)) == brute_force(rows)


def test_few_vectors_and_none(spark):
    df = vectors(spark)
    few = df.where("vec_id < 7")
    assert result(C.cluster_report(few)) == brute_force([(r.vec_id, r.embedding) for r in few.collect()])
    one = df.where("vec_id = 9")
    assert [r[1:5] for r in result(C.cluster_report(one))] == [(0, 0, 0, 0)]
    assert result(C.cluster_report(df.limit(0))) == [] == result(C.cluster_report(df.where("vec_id between 600 and 606")))


def test_components_beyond_the_range_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="must not exceed"):
        C.cluster_report(df).collect()


def test_bounds_skip_most_scans_and_stay_exact():
    rng = np.random.default_rng(1)
    middle = rng.integers(-200, 200, (12, 64))
    x = middle[rng.integers(0, 12, 4000)] + rng.integers(-40, 40, (4000, 64))
    centroids, drift, scanned = x[:12].copy(), np.zeros(12), []
    m = C.Members(x, 12)
    m.start(centroids, drift)
    for _ in range(12):
        before = centroids
        centroids = np.where(m.counts[:, None] > 0, m.sums // np.maximum(m.counts, 1)[:, None], centroids)
        move = np.sqrt(((centroids - before) ** 2).sum(axis=1)) * C._UP
        drift = drift + move + np.array([max(np.delete(move, c)) for c in range(12)])
        m = C.Members.unpack(x, m.pack())
        scanned.append(m.advance(centroids, drift))
        d = C.squared_distances(x, centroids)
        assert (m.cluster == d.argmin(axis=1)).all()
        assert (m.counts == np.bincount(m.cluster, minlength=12)).all()
        assert all((m.sums[c] == x[m.cluster == c].sum(axis=0)).all() for c in range(12))
        assert sum(map(len, m.heaps)) == len(x)
    assert scanned[-1] < len(x) // 10
