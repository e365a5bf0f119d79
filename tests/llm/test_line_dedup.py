import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from wirefold.llm import line_dedup as L

LINE = "This line is long enough to be compared, number"


def repeated_lines(spark):
    rng = random.Random(11)
    pool = [f"{LINE} {i:02d}." for i in range(30)] + ["short line"] * 3 + ["", "  ", "é" * 39, "é" * 40, "ſ" + "x" * 39]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
        lines = [rng.choice(["{}", " {}", "\t{}\r", "{}\x0b\x0c"]).format(x.upper() if rng.random() < 0.3 else x) for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, rows[5][1]), (70, None), (71, ""), (72, "\n"), (73, "\n" + pool[0] + "\n"),
             (74, "\n".join(pool[0] for _ in range(20))), (75, " ".join(f"w{i}" for i in range(50_000)))]
    for k in range(9):  # held by documents without id alone, and by four documents only
        rows.append((None if k < 5 else 200 + k, f"{LINE} {'without id' if k < 5 else 'of four'}"))
    return spark.createDataFrame([(a, b, 1, "x", 2, False) for a, b in rows],
                                 "doc_id long, text string, block int, h string, n int, answer boolean")


def brute_force(rows, min_docs=5):
    """Documents in a list, lines compared as strings."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    keys = [[(x, re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(lower)) for x in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for i, lines in enumerate(keys):
        for _, k in lines:
            if len(k) >= 40:
                holders[k].add(i)
    out = []
    for (doc, _), lines in zip(rows, keys):
        kept = []
        for x, k in lines:
            ids = [rows[i][0] for i in holders.get(k, ())]
            top = max((i for i in ids if i is not None), default=None)
            if len(ids) < min_docs or doc == top:
                kept.append(x)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


@pytest.mark.parametrize("batches, fan_out, block_bytes", [(4, 3, 8 << 20), (7, 2, 400), (1, 2, 400)])
def test_lines_equal_brute_force(spark, monkeypatch, batches, fan_out, block_bytes):
    from wirefold.llm import lm_score

    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block_bytes)
    docs = repeated_lines(spark).repartition(3)
    expected = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert result(L.drop_repeated_lines(docs, batches=batches, fan_out=fan_out)) == expected
    assert sum(r[3] for r in expected) > 50


def test_awkward_documents(spark, docs, no_docs):
    assert result(L.drop_repeated_lines(docs)) == brute_force([(r.doc_id, r.text) for r in docs.collect()])
    empty = L.drop_repeated_lines(no_docs)
    assert empty.columns == ["doc_id", "text", "n_lines", "n_dropped"] and empty.count() == 0


def test_string_ids_and_other_names(spark):
    docs = spark.createDataFrame([(f"d{i}", f"{LINE} 1\nown line {i}") for i in range(6)], "key string, body string")
    kept = {r.key: r.text for r in L.drop_repeated_lines(docs, "key", "body").collect()}
    assert kept["d5"].startswith(LINE) and all(kept[f"d{i}"] == f"own line {i}" for i in range(5))


def test_runs_are_sorted_compacted_and_anti_joined(spark):
    state = L.SortedRuns(min_docs=2, fan_out=3)
    batches = [[(1, 9), (2, 5), (1, 4)], [(1, 3), (3, 1)], [(1, 12), (2, 6)], [(4, 1)], [(1, 2), (4, 2)]]
    sizes = []
    for b in batches:
        state.add(spark.createDataFrame([(k, -k, 1, top) for k, top in b], "h long, g long, n long, top long"))
        sizes.append([len(level) for level in state.levels])
    assert sizes == [[1], [2], [0, 1], [1, 1], [2, 1]]
    # Line 1 was settled by the first batch with id 9: it left the second and the last batch, not the third, which has a larger id.
    entries = {r.h: (r.n, r.top) for r in state.entries().collect()}
    assert entries == {1: (3, 12), 2: (2, 6), 3: (1, 1), 4: (2, 2)}
    for level in state.levels:
        for run in level:
            for part in run.rdd.glom().collect():
                assert part == sorted(part, key=lambda r: (r.h, r.g))


def test_line_bounds_next_to_empty_texts():
    texts = pa.array(["", "a\n", None, "\nb", "", "x" * 40 + "\n"])
    start, end, doc, at, h, g = L.line_keys(texts)
    assert doc.tolist() == [0, 1, 1, 2, 3, 3, 4, 5, 5]
    assert (end - start).tolist() == [0, 1, 0, 0, 0, 1, 0, 40, 0] and at.tolist() == [7] and len(h) == len(g) == 1
