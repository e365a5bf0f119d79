import zlib

import numpy as np
import pyarrow as pa
import pytest

from wirefold.llm import token_repair as T
from wirefold.llm.common import shared_dir

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return t.encode(text, add_special_tokens=False).ids


def ids_of_all(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def test_files_hold_the_tokenizer_ids(docs):
    got = sorted((tuple(r) for r in T.token_blocks(docs, TOKENIZER, shards=3, block_ids=2000).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    lengths = {}
    at = 0
    by_id = {}
    for (known, key), text in rows:
        ids = np.array(ids_of(text) + [2], "<u4")
        by_id.setdefault(key if known else None, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for key, start, n, crc in got:
        assert start == at
        at += n
        lengths.setdefault(key, []).append((n, crc))
    assert [r[0] for r in got] == [k if known else None for (known, k), _ in rows]
    assert {k: sorted(v) for k, v in lengths.items()} == {k: sorted(v) for k, v in by_id.items()}


def test_empty_table(no_docs):
    assert T.token_blocks(no_docs, TOKENIZER).collect() == []


@pytest.mark.parametrize("ids", [[], [5], [1, 1, 1, 1, 1] * 50, list(range(300)), [7, 8, 9] * 200 + [7, 8], [0, 50256, 0, 50256] * 99])
def test_grammar_round_trip_and_random_access(ids):
    a = np.array(ids, "<u4")
    cut = np.array([len(a) // 3, 0, len(a) - len(a) // 3])
    r = T.Block(T.pack_block(a, cut))
    assert np.array_equal(r.ids(), a)
    for s, e in ((0, len(a)), (len(a) // 2, len(a)), (1, 2), (3, 3)):
        if e <= len(a):
            assert np.array_equal(r.range(s, e), a[s:e])
    at = np.concatenate([[0], np.cumsum(cut)])
    for i in range(3):
        assert np.array_equal(r.document(i), a[at[i]:at[i + 1]])


def test_repetitive_ids_shrink():
    rng = np.random.default_rng(0)
    a = np.tile(rng.integers(0, 50000, 64, dtype=np.uint32), 500)
    assert len(T.pack_block(a, np.array([len(a)]))) < 4 * len(a) / 5


def test_cut_encoding_equals_the_tokenizer():
    texts = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "x\ty z", "don't it's", "é à  ü", "1 22 333,4", "<|endoftext|> a",
             "a b  c", "tab\t tab", "a\x00b", "a\x85 b", "日本 語", "x\r\ny z", "!? ... a", "\U0001F600 \U0001F600", "x <|endoftext|>y", "end.", " .", ".a", "a.b. c..",
             "café, naïve. × 2×2, ÷. ɐx. ǅ.", "a b c", "a b", "a—b “q”.", "a　b", "word's words'. 3.5 x2. ª. µ,",
             "\n", "a\n", "\na", "a\n b", "one\ntwo three\nfour,", "n" * 70_000, "q " * 20 + "q"]
    enc = T.Encoder(TOKENIZER)
    for piece_bytes in (1 << 20, 1 << 20, 10):
        T.PIECE_BYTES, before = piece_bytes, T.PIECE_BYTES
        try:
            assert [x.tolist() for x in enc(pa.array([*texts, None]))] == [ids_of(t) for t in [*texts, ""]]
        finally:
            T.PIECE_BYTES = before
    assert len(enc.known) > 40 and enc(pa.array([], pa.string())) == []


def test_random_texts_equal_the_tokenizer():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcXYZéßłɐ中019.,!'\"-$ \n\t "))
    share = np.array([6.0] * 6 + [2, 2, 1, 0.2, 0.2] + [1] * 3 + [1.5] * 7 + [9, 2, 0.03, 0.03])
    texts = ["".join(rng.choice(letters, n, p=share / share.sum())) for n in rng.integers(0, 90, 3000)]
    enc = T.Encoder(TOKENIZER)
    assert [x.tolist() for x in enc(pa.array(texts))] == ids_of_all(texts)


def test_cache_bound_keeps_results(monkeypatch):
    monkeypatch.setattr(T, "CACHED_PIECES", 4)
    enc = T.Encoder(TOKENIZER)
    for t in ["one two three four", "five six one two", "seven one", "one two three. four, five"] * 2:
        assert enc(pa.array([t]))[0].tolist() == ids_of(t)
        assert len(enc.known) <= 4


def test_table_of_pieces_grows_and_shrinks():
    rng = np.random.default_rng(7)
    known, all_keys, ids = T._Known(), np.zeros(0, np.uint64), {}
    for n in (10, 200_000, 5, 60_000):
        key = rng.integers(0, 2**64, n, dtype=np.uint64)
        key[::7] &= np.uint64(0xFFFF)  # many want the same slots
        key = np.setdiff1d(key, all_keys)
        known.add(key, key ^ np.uint64(5), [[int(k) % 1000] * (int(k) % 3) for k in key])
        all_keys = np.concatenate([all_keys, key])
        at = known.find(all_keys, all_keys ^ np.uint64(5))
        assert (known.key[at] == all_keys).all() and 2 * len(known) <= len(known.slots)
        assert (known.find(all_keys, all_keys) < 0).all() and (known.find(rng.integers(0, 2**64, 99, dtype=np.uint64), np.zeros(99, np.uint64)) < 0).all()
    known.hits[:] = 1
    known.hits[:1000] = 9
    best = known.key[:1000].copy()
    known.shrink(100_000)
    assert len(known) == 50_000 and (known.find(best, best ^ np.uint64(5)) >= 0).all()
    for k in best[:50]:
        at = known.find(np.array([k]), np.array([k ^ np.uint64(5)]))
        assert known.gather(at).tolist() == [int(k) % 1000] * (int(k) % 3)


def test_pairs_are_replaced_until_none_is_frequent():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 50_000, 500)
    cases = [np.concatenate([np.concatenate([passage, rng.integers(0, 50_000, 30)]) for _ in range(100)]), rng.integers(0, 6, 20_000), np.zeros(5_000, int),
             np.tile([1, 2, 1, 1, 2], 700), np.arange(40)]
    for ids in cases:
        rules, seq, first, lengths = T.compress(ids.astype(np.uint32))
        assert np.array_equal(T.expand(seq, rules, first), ids)
        assert [len(T.expand(np.array([first + i]), rules, first)) for i in range(len(rules))] == lengths.tolist()
        # Occurrences of a pair that don't overlap: fewer than the minimum for every pair that is left.
        last, times = {}, {}
        for i, p in enumerate(zip(seq.tolist(), seq[1:].tolist())):
            if last.get(p) != i - 1:
                last[p], times[p] = i, times.get(p, 0) + 1
        assert max(times.values(), default=0) < T.MIN_PAIR_COUNT
    # A passage that repeats costs its own length once, not in every place.
    rules, seq, _, _ = T.compress(cases[0].astype(np.uint32))
    assert 3 * len(rules) + len(seq) < 3 * 500 + 100 * 34


def test_table_of_blocks_is_readable_later(spark, docs):
    path = shared_dir(spark, "token-test")
    T.write_token_blocks(docs, path, TOKENIZER, shards=2)
    row = spark.read.parquet(path).orderBy("shard", "block").first()
    assert T.Block(bytes(row.record)).doc_lengths.sum() == row.n_ids and len(row["keys"]) == len(T.Block(bytes(row.record)).doc_lengths)
