import re

import numpy as np

from wirefold.llm import jaccard_join as J
from wirefold.llm.common import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, x) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return sorted(((i, len(x), low.get(find(a)) if x else i) for a, (i, x) in enumerate(sets)), key=repr)


def test_components_equal_brute_force(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr)
    assert got == brute_force(rows)


def test_drop_linked_keeps_rows_and_columns(docs):
    kept = J.drop_linked(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    expected = [i for i, _, c in brute_force([(r.doc_id, r.text or "") for r in docs.collect()]) if i is None or c is None or c >= i]
    assert sorted(ids, key=repr) == sorted(expected, key=repr)


def test_empty_table(no_docs):
    assert J.jaccard_components(no_docs).collect() == []


def test_chunks_do_not_change_the_result(docs, monkeypatch):
    monkeypatch.setattr(J, "CHUNK_ROWS", 2)
    got = sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr)
    assert got == brute_force([(r.doc_id, r.text or "") for r in docs.collect()])


def test_a_unit_holds_a_class_once(docs, monkeypatch):
    real = J.runs

    def checked(batches, keys):
        for t in real(batches, keys):
            if "class_id" in t.column_names:  # a unit, not a packed row
                ids = t["class_id"].to_pylist()
                assert len(ids) == len(set(ids)), "a copy came along"
            yield t

    some = docs.where("doc_id in (0, 100, 1, 101)")
    for _ in range(5):
        some = some.union(some)  # 32 equal rows each
    monkeypatch.setattr(J, "runs", checked)
    got = {(r.doc_id, r.component_id) for r in J.jaccard_components(some).collect()}
    assert got == {(0, 0), (100, 0), (1, 1), (101, 1)}


def test_linked_sets_share_a_signature_in_their_prefix():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 4, 5, 7, 8, 12, 15, 16, 17, 40, 63, 64, 200, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            drop = J._max_diff(size) // 2
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, drop, dtype=np.uint64)]))
            if J._similar(a, b):
                x = {k: set(s.tolist()) for k, _, s in J.set_signatures(a, np.array([0, len(a)]))}
                y = {k: set(s.tolist()) for k, _, s in J.set_signatures(b, np.array([0, len(b)]))}
                shared = set().union(*x.values()) & set().union(*y.values())
                assert shared
                for k, s in x.items():
                    assert len(s) - len(s & set().union(*y.values())) <= J._max_diff(len(a)) or k & 1


def test_bit_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:200], rng.integers(0, 2**64, 90, dtype=np.uint64)]))
    bits = J._bit_sketches([a, b])
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    e = spark.createDataFrame(chain + hub, "src long, dst long")
    got = {r.node: r.root for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(300)}}


def test_sets_of_many_texts_equal_those_of_each(docs):
    import pyarrow as pa

    texts = [r.text for r in docs.collect()] + ["", None, "a", "a b c d", "a b c d e", "a a a a a a a"] * 2
    together = [h[x:y].tolist() for h, first, _ in J.text_sets(pa.array(texts), 5) for x, y in zip(first[:-1], first[1:])]
    apart = [h.tolist() for t in texts for h, _, _ in J.text_sets(pa.array([t], pa.string()), 5)]
    counts = [len({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}) if w else 0
              for w in (re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts)]
    assert together == apart and [len(s) for s in together] == counts
    ids = [J._class_ids(h, first).tolist() for h, first, _ in J.text_sets(pa.array(texts), 5)][0]
    same = {}
    for i, s in zip(ids, together):
        assert same.setdefault(tuple(s), i) == i
    assert len(set(same.values())) == len(same)


def test_signatures_that_many_sets_share(spark, monkeypatch):
    """A passage in every document: its signatures are one entry of each block, and the result is that of brute force."""
    monkeypatch.setattr(J, "COMMON", 3)
    monkeypatch.setattr(J, "BLOCK_SIGNATURES", 300)
    monkeypatch.setattr(J, "PART_SIGNATURES", 64)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"w{i // 2}x{j}" for j in range(25 + i % 3))) for i in range(60)]
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(80))) for i in range(40)] + [(200 + i, rows[i][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr)
    assert got == brute_force(rows)


def test_copies_of_reused_ids_stay(spark):
    """An id that names a copy and another text: the other text is compared."""
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    near = b.replace("b49", "c49")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, near), (None, a)], "doc_id long, text string")
    got = sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr)
    assert got == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_passages_that_documents_share_make_no_large_cluster(spark, monkeypatch):
    """Every document has passages of its neighbours: tied all along, but only near copies are compared as sets."""
    passage = [" ".join(f"p{i}x{j}" for j in range(100)) for i in range(304)]
    rows = [(i, " ".join(passage[i:i + 4])) for i in range(300)]
    rows += [(1000 + i, rows[i][1].replace(f"p{i}x30 ", "")) for i in range(0, 300, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compared = []
    monkeypatch.setattr(J, "LOOSE_ROWS", 20, raising=False)

    def spy(docs, classes, clusters, *args, real=J.verified_links):
        compared.append(sorted(r["count"] for r in clusters.groupBy("root").count().collect()))
        return real(docs, classes, clusters, *args)

    monkeypatch.setattr(J, "verified_links", spy)
    got = sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr)
    assert len(compared[0]) >= 10 and compared[0][-1] <= 20 and got == brute_force(rows)


def test_sketched_clusters_do_not_change_the_result(docs, monkeypatch):
    want = brute_force([(r.doc_id, r.text or "") for r in docs.collect()])
    monkeypatch.setattr(J, "LOOSE_ROWS", 1)
    for rows in (1 << 15, 2):
        monkeypatch.setattr(J, "SKETCH_ROWS", rows)
        assert sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=repr) == want


def test_near_links_hold_all_linked_pairs():
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 2, 3, 5, 8, 15, 16, 17, 21, 60, 64, 66, 85, 300, 500, 520, 9000):
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            drop = J._max_diff(size) // 2
            sets += [a, np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, drop, dtype=np.uint64)])), a[J._max_diff(size) // 2:]]
    first = np.cumsum([0, *map(len, sets)])
    links = {}
    rows = {}
    for band, guest, of, bits in J.set_sketches(np.concatenate(sets), first):
        rows.setdefault(band, []).extend((int(i), guest, b) for i, b in zip(of, bits))
    for band, held in rows.items():
        ids, guest = (np.array(x) for x in zip(*((i, g) for i, g, _ in held)))
        bits = np.stack([b for *_, b in held]).view(np.uint64)
        n = np.array([len(sets[i]) for i in ids])
        for cross in (False, True):
            side = (ids % 2).astype(np.int8)
            links.setdefault(cross, []).extend(J._near_links(ids, n, guest, side, bits, cross))
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if J._similar(sets[i], sets[j])]
    for cross, found in links.items():
        low = list(range(len(sets)))
        for _ in sets:
            for i, j in found:
                low[i] = low[j] = min(low[i], low[j])
        assert all(low[i] == low[j] for i, j in linked if not cross or (i - j) % 2)
    assert len(linked) > len(sets) // 2 and len(links[False]) < 2 * len(sets)
