import random

import numpy as np
import pyarrow as pa
import pytest

from captures_fixture import capture, eth, ipv4, udp
from wirefold.sources.capture_format import iter_records
from wirefold.streaming import growing_captures as G


def sizes_as_classes():
    def by_size(packets: pa.Array, linktype: int) -> np.ndarray:
        """Class of a packet: its length modulo 4; -1 for short ones."""
        n = np.array([len(p.as_py()) for p in packets])
        return np.where(n < 50, -1, n % 4)

    return by_size  # an inner function travels to the workers by value


by_size = sizes_as_classes()


def whole(content):
    votes = np.zeros(4, int)
    records = list(iter_records(content))
    for r in records:
        if len(r.data) >= 50:
            votes[len(r.data) % 4] += 1
    n = int(votes.sum())
    return len(records), n, int(votes.argmax()) if n else None


@pytest.mark.parametrize("magic", ["A1B2C3D4", "4D3CB2A1"])
def test_any_cuts_and_order_give_the_label_of_the_whole(magic):
    rng = random.Random(3)
    frames = [eth(0x0800, ipv4(17, udp(1, 2, rng.randbytes(rng.randint(0, 90))))) for _ in range(60)] + [b"z" * 200_000, b"", b"q" * 77]
    content = capture(frames, magic=magic)
    for _ in range(40):
        cuts = sorted(rng.sample(range(len(content)), rng.randint(1, 25)))
        pieces = list(enumerate(content[a:b] for a, b in zip([0, *cuts], [*cuts, len(content)])))
        rng.shuffle(pieces)
        state = None
        for seq, piece in pieces + pieces[:3]:  # some pieces come twice
            f = G.Follower(4, state)
            f.add(seq, piece, by_size)
            state = f.state()
            assert len(f.rest) <= 16 + 0xFFFF
        assert G.Follower(4, state).row("p")[2:5] == whole(content)


def test_what_is_no_capture_is_named():
    f = G.Follower(4)
    f.add(0, b"no capture, but long enough for a header", by_size)
    assert f.row("p") == ("p", 0, 0, 0, None, "bad magic")


def test_stream_follows_files_as_they_grow(spark, tmp_path):
    from wirefold.streaming.capture_stream import run_until_done

    rng = random.Random(9)
    files = {f"c{i}": capture([rng.randbytes(rng.randint(0, 120)) for _ in range(5 * i)]) for i in range(5)}
    folder, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    seen = []
    for k in range(3):
        rows = [(n, k, bytearray(c[len(c) * k // 3:len(c) * (k + 1) // 3])) for n, c in files.items()]
        spark.createDataFrame(rows, G.PIECES).coalesce(1).write.mode("append").parquet(folder)
        run_until_done(G.label_growing_captures(spark, folder, out, ckpt, by_size, 4, "traffic"))
        labels = {r.path: r for r in G.newest_labels(spark.read.parquet(out)).collect()}
        seen.append(sum(r.n_records for r in labels.values()))
        assert all(r.seq == k for r in labels.values())
    assert {n: (r.n_records, r.n_packets, r.prediction) for n, r in labels.items()} == {n: whole(c) for n, c in files.items()}
    assert seen == sorted(seen) and seen[0] < seen[-1] == sum(5 * i for i in range(5))


def test_captures_of_a_key_are_scored_together(spark, tmp_path):
    from wirefold.streaming.capture_stream import run_until_done

    rng = random.Random(11)
    files = {f"c{i}": capture([rng.randbytes(rng.randint(0, 120)) for _ in range(i % 9)], linktype=1 + 100 * (i % 2)) for i in range(40)}
    folder, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    calls = spark.sparkContext.accumulator(0)

    def counted(packets, linktype, by_size=by_size):
        calls.add(1)
        return by_size(packets, linktype)

    for k in (1, 0):  # the first half comes last
        rows = [(n, k, bytearray(c[len(c) * k // 2:len(c) * (k + 1) // 2])) for n, c in files.items()]
        spark.createDataFrame(rows, G.PIECES).coalesce(1).write.mode("append").parquet(folder)
        run_until_done(G.label_growing_captures(spark, folder, out, ckpt, counted, 4, "traffic", keys=3))
    labels = G.newest_labels(spark.read.parquet(out)).collect()
    assert {r.path: (r.n_records, r.n_packets, r.prediction) for r in labels} == {n: whole(c) for n, c in files.items()}
    assert calls.value <= 2 * 3  # both link types of each key, once
