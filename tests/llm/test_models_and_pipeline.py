import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from wirefold.llm import embedding_dedup as E
from wirefold.llm import quality_rank as Q

SMALL = "/root/testdata/sf0.001"


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        rows.append((i, rng.standard_normal(64).tolist(), i % 3))
    for i in range(40):  # near copies of a few, below and above the threshold
        base = np.array(rows[i % 5][1])
        rows.append((100 + i, (base + rng.standard_normal(64) * (0.15 if i % 2 else 0.45)).tolist(), rows[i % 5][2] if i % 7 else 99))
    for i in range(30):
        rows.append((200 + i, rows[7][1], 1))
    rows += [(500, None, 1), (501, [0.0] * 64, 1), (502, [1.0] * 63 + [float("nan")], 1), (503, rows[7][1], None), (504, [1.0] * 63 + [None], 1),
             (505, [float("inf")] + [1.0] * 63, 1), (506, rows[7][1][:10], 1), (507, [], 1), (508, (np.array(rows[7][1]) * 1e300).tolist(), 1),
             (508, (np.array(rows[7][1]) * 1e-300).tolist(), 1), (None, rows[7][1], 1)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, vector string")


def brute_force(rows, threshold=0.93):
    unit, n = [], [0] * len(rows)
    for r in rows:
        v = r.embedding
        ok = r.label is not None and v and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        x = np.array(v, float) if ok else None
        unit.append(None if x is None else (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i].label == rows[j].label and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            low[find(i)] = min(r.vec_id, low.get(find(i), r.vec_id))
    return sorted(((r.vec_id, n[i], low.get(find(i)), low.get(find(i)) == r.vec_id) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("chunk_rows", [512, 7])
def test_vector_links_equal_brute_force(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(E, "CHUNK_ROWS", chunk_rows)
    rows = vectors(spark).collect()
    got = sorted((tuple(r) for r in E.near_duplicate_vectors(vectors(spark)).collect()), key=repr)
    assert got == brute_force(rows)


@pytest.mark.parametrize("chunk_rows", [512, 7])
def test_vectors_of_every_length_are_compared(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(E, "CHUNK_ROWS", chunk_rows)
    rng = np.random.default_rng(8)
    rows = []
    for dim, n in ((64, 40), (48, 30), (200, 12), (3, 4), (1, 9)):
        base = rng.standard_normal((n, dim))
        for x in (base, base + rng.standard_normal((n, dim)) * 0.1, base[:3]):
            rows += [(len(rows) + i, v.tolist(), i % 2) for i, v in enumerate(x)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    linked = np.array([[i != j and a[2] == b[2] and len(x) == len(y) and x @ y >= 0.93 for j, (b, y) in enumerate(zip(rows, unit))]
                       for i, (a, x) in enumerate(zip(rows, unit))])
    low = np.arange(len(rows))
    for _ in rows:
        low = np.minimum(low, np.where(linked, low, len(rows)).min(axis=1))
    want = [(i, int(linked[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(len(rows))]
    assert {len(rows[i][1]) for i, n, _, _ in want if n} == {64, 48, 200, 3, 1}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(tuple(r) for r in E.near_duplicate_vectors(table).collect()) == want


def test_vectors_without_any_pair(spark):
    v = vectors(spark)
    assert E.near_duplicate_vectors(v.limit(0)).collect() == []
    assert [tuple(r) for r in E.near_duplicate_vectors(v.where("vec_id = 3")).collect()] == [(3, 0, 3, True)]
    assert [tuple(r) for r in E.near_duplicate_vectors(v.where("vec_id = 500")).collect()] == [(500, 0, 500, True)]


def test_recall_at_the_threshold():
    """Pairs just above the threshold meet in a table and pass the Hamming radius."""
    rng = np.random.default_rng(4)
    x = E.unit_rows(rng.standard_normal((4000, 64)))
    t = E.Tables(x, 20_000)
    z = rng.standard_normal(x.shape)
    z = E.unit_rows(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * z
    (cx, kx), (cy, ky) = t.encode(x), t.encode(y)
    met = np.zeros(len(x), bool)
    for i in range(t.count):
        differ = sum(np.bitwise_count(a ^ b).astype(int) for a, b in zip(t.carried(cx, i), t.carried(cy, i)))
        met |= (kx[:, i] == ky[:, i]) & (differ <= t.radius)
    assert met.mean() > 0.98
    assert abs(np.unpackbits(cx.view(np.uint8)).mean() - 0.5) < 0.02  # balanced codes


def test_rotation_lowers_the_quantisation_error():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 16)) * np.linspace(3, 0.2, 16)
    x = E.unit_rows(x)
    mean, p = E.learn_rotations(x, 1, 16)
    basis = np.linalg.eigh((x - mean).T @ (x - mean))[1]
    error = lambda v: np.linalg.norm(np.where(v >= 0, 1, -1) - v)
    assert error((x - mean) @ p[0]) < error((x - mean) @ basis)
    assert np.allclose(p[0].T @ p[0], np.eye(16))


def labelled(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, 0.5, 1))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(9000, None, 0.1, 0), (9001, "", 0.1, 0), (9001, "", 0.1, 0), (None, "x " * 50_000, 0.1, 0)]
    labels += [(1, None, 1), (77777, 0, 0), (None, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_ranking_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    out = Q.score_documents(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 9000 and r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out if r.doc_id is not None)
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 5 != 0) for r in held) / len(held) > 0.97


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = labelled(spark)
    a = {(r.doc_id, r.score) for r in Q.score_documents(docs, labels).collect()}
    flipped = labels.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["x"]).when(
        Q.held_out(labels["doc_id"]), 1 - labels["quality"]).otherwise(labels["quality"]))
    b = {(r.doc_id, r.score) for r in Q.score_documents(docs.drop("score").repartition(5), flipped).collect()}
    assert a == b


def test_without_a_class_every_document_is_kept(spark):
    docs, labels = labelled(spark)
    assert {r.score for r in Q.score_documents(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert Q.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert Q.keep_good(docs.limit(0), labels).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from wirefold.llm import decontaminate, secret_scan
    from wirefold.llm.common import materialize, read_table
    from wirefold.llm.jaccard_join import jaccard_components

    source = read_table(spark, SMALL, "documents")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    docs, kept = source, [{r.doc_id for r in source.collect()}]
    for name, stage in P.STAGES[:-1]:
        after = materialize(stage(spark, docs, SMALL), name)
        assert after.schema.names == source.schema.names
        ids = [r.doc_id for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept[-1]
        if name == "quality":
            scores = Q.score_documents(docs, read_table(spark, SMALL, "labels")).collect()
            assert set(ids) == {r.doc_id for r in scores if r.predicted == 1}
        elif name == "near_duplicates":
            assert set(ids) == {r.doc_id for r in jaccard_components(docs).collect() if r.component_id == r.doc_id}
        elif name == "decontamination":
            report = decontaminate.contamination_report(docs, read_table(spark, SMALL, "benchmark")).collect()
            assert set(ids) == {r.doc_id for r in report if not r.contaminated}
        else:
            assert set(ids) == kept[-1]
            a = secret_scan.automaton()
            assert all(not secret_scan.secret_spans(r.text, a) and r.n_chars == len(r.text) for r in after.collect())
        kept.append(set(ids))
        docs = after
    final = P.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in final} == kept[-1]
    totals = defaultdict(int)
    for r in final:
        totals[r.bin_id] += r.n_tokens
    assert max(totals.values()) <= 2048
    assert sorted(map(tuple, final)) == sorted(map(tuple, P.run(spark, SMALL).collect()))


def test_pipeline_takes_an_empty_table(spark):
    import corpus_pipeline as P
    from wirefold.llm.common import read_table

    docs = read_table(spark, SMALL, "documents").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.collect() == []


def test_exact_vectors_and_copies(spark):
    """Without an index every link is found; copies are counted, not compared."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.standard_normal(16) * 0.1).tolist(), i % 2) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(400)] + [(None, rows[0][1], rows[0][2]), (2000, [-0.0] + rows[0][1][1:], 0), (2001, [0.0] + rows[0][1][1:], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    x = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    linked = np.array(x) @ np.array(x).T >= 0.93
    label = np.array([r[2] for r in rows])
    linked &= label[:, None] == label[None, :]
    np.fill_diagonal(linked, False)
    want = sorted(((r[0], int(n)) for r, n in zip(rows, linked.sum(axis=1))), key=repr)
    E_chunk, E.CHUNK_ROWS = E.CHUNK_ROWS, 50
    try:
        out = E.near_duplicate_vectors(df, exact=True).collect()
        indexed = E.near_duplicate_vectors(df).collect()
    finally:
        E.CHUNK_ROWS = E_chunk
    assert sorted(((r.vec_id, r.n_links) for r in out), key=repr) == want
    assert sum(r.n_links for r in indexed) >= 0.9 * sum(n for _, n in want)
    component = {r.vec_id: r.component_id for r in out}
    assert all(component[1000 + i] == component[i % 3] <= i % 3 for i in range(400))


def test_filters_keep_columns_of_any_name(spark):
    from wirefold.llm.decontaminate import drop_contaminated

    docs = spark.createDataFrame([(i, f"words of text number {i} " * 9, 0.5, 7) for i in range(20)], "doc_id long, text string, _quality double, _hit_0 int")
    items = spark.createDataFrame([(1, "words of text number 3 words of text number 3 words")] * 5, "item_id long, text string")
    clean = drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [i for i in range(20) if i != 3]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {(r._quality, r._hit_0) for r in kept.collect()} <= {(0.5, 7)}


def test_ranking_equals_an_independent_fit(spark, docs):
    """The weights solve the penalised Bradley-Terry equations of the pairs, found here by plain gradient steps."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 5))
    good = x @ np.array([1.0, -2.0, 0.0, 0.5, 0.0]) + rng.standard_normal(120) > 0
    pairs = [(i, j) for i in np.flatnonzero(good) for j in np.flatnonzero(~good)]
    d = np.array([x[i] - x[j] for i, j in pairs])
    w = Q._logistic_on_differences(d)
    v, step = np.zeros(5), 1 / (0.25 * np.linalg.norm(d, 2) ** 2 + Q.RIDGE)
    for _ in range(20_000):
        v += step * (d.T @ (1 / (1 + np.exp(d @ v))) - Q.RIDGE * v)
    assert np.allclose(w, v, atol=1e-3)


def test_scores_of_an_empty_table(spark, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert Q.score_documents(no_docs, labels).collect() == []
    from wirefold.llm.secret_scan import find_secrets, redact_secrets

    assert find_secrets(no_docs).collect() == [] and redact_secrets(no_docs).collect() == []
