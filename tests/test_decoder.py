import gzip
import io
import struct

import pytest
from pyspark.sql import functions as F

from captures_fixture import capture, eth, ipv4, pcapng, tcp, udp
from wirefold.sources import captures as C
from wirefold.sources.capture_format import format_error, iter_records, read_records


def caps_df(spark, items):
    return spark.createDataFrame([(name, bytearray(b)) for name, b in items], "path string, content binary")


FRAME = eth(0x0800, ipv4(6, tcp(1234, 80, 0x18, b"hello")))


def test_format_errors():
    assert format_error(b"") == "empty"
    assert format_error(b"abc") == "bad magic"
    assert format_error(bytes.fromhex("A1B2C3D4") + b"\0" * 16) == "too short"
    assert format_error(capture([])) is None


@pytest.mark.parametrize("magic", ["A1B2C3D4", "D4C3B2A1", "A1B23C4D", "4D3CB2A1"])
def test_four_magics_same_packet(magic):
    recs = list(iter_records(capture([FRAME], magic=magic)))
    assert len(recs) == 1 and recs[0].data == FRAME and recs[0].linktype == 1
    nano = magic in ("A1B23C4D", "4D3CB2A1")
    assert recs[0].ts_nanos == 1_700_000_000 * 10**9 + 123 * (1 if nano else 1000)


def test_truncated_records():
    full = capture([FRAME, FRAME])
    assert len(list(iter_records(full[:-3]))) == 2  # body cut: shorter packet kept
    assert list(iter_records(full[:-3]))[1].data == FRAME[:-3]
    assert len(list(iter_records(full[: 24 + 16 + len(FRAME) + 10]))) == 1  # header cut: stop


def test_gzip_and_pcapng():
    assert [r.data for r in iter_records(gzip.compress(capture([FRAME])))] == [FRAME]
    recs = list(iter_records(pcapng([FRAME, FRAME])))
    assert [r.data for r in recs] == [FRAME, FRAME]
    assert recs[1].ts_nanos == (1_700_000_001 * 1_000_000 + 5) * 1000


def test_decode_in_spark_with_rejects(spark):
    items = [("a.pcap", capture([FRAME, FRAME], magic="D4C3B2A1")), ("empty.pcap", b""),
             ("bad.pcap", b"xyz123"), ("short.pcap", bytes.fromhex("A1B2C3D4") + b"\0" * 10),
             ("hdr.pcap", capture([])), ("ng.pcapng", pcapng([FRAME]))]
    caps = caps_df(spark, items)
    pk = C.decode_packets(caps).select("path", "packet_no", "caplen", "wirelen", "data").collect()
    assert sorted((r.path, r.packet_no) for r in pk) == [("a.pcap", 0), ("a.pcap", 1), ("ng.pcapng", 0)]
    rej = {r.path: r.format_error for r in C.capture_rejects(caps).collect()}
    assert rej == {"empty.pcap": "empty", "bad.pcap": "bad magic", "short.pcap": "too short"}
    fmt = {r.path: r for r in C.capture_format(caps).collect()}
    assert fmt["a.pcap"].endian == "little" and fmt["a.pcap"].linktype == 1 and fmt["a.pcap"].snaplen == 65535
    with pytest.raises(Exception):
        C.decode_packets(caps, mode="FAILFAST").count()


def test_truncated_flag(spark):
    caps = caps_df(spark, [("t.pcap", capture([FRAME], wirelen_extra=100))])
    r = C.packet_lengths(C.decode_packets(caps)).first()
    assert r.truncated and r.wirelen == r.caplen + 100


def test_spread_packets_keeps_rows(spark):
    caps = caps_df(spark, [("big.pcap", capture([FRAME] * 50))])
    pk = C.spread_packets(C.decode_packets(caps), 4)
    assert pk.rdd.getNumPartitions() == 4 and pk.count() == 50


def damaged_files():
    def block(kind, body):
        n = 12 + len(body)
        return struct.pack("<II", kind, n) + body + struct.pack("<I", n)

    good = capture([FRAME, FRAME])
    return [("good.pcap", good), ("good.pcapng", pcapng([FRAME])), ("nested.gz", gzip.compress(gzip.compress(good))),
            ("link.pcap", good[:20] + b"\x80\x00\x00\x01" + good[24:]),
            ("time.pcapng", pcapng([FRAME]) + block(6, struct.pack("<IIIII", 0, 0xFFFFFFFF, 0, 0, 0))),
            ("time.pcapng.gz", gzip.compress(pcapng([FRAME]) + block(6, struct.pack("<IIIII", 0, 0xFFFFFFFF, 0, 0, 0)))),
            ("cut.gz", gzip.compress(good)[:-9]), ("bits.gz", gzip.compress(good * 3)[:40] + b"\xff" * 9 + gzip.compress(good * 3)[49:]),
            ("section.pcapng", pcapng([])[:20]), ("nothing.pcap", None)]


REASONS = {"nested.gz": "gzip inside gzip", "link.pcap": "bad link type", "time.pcapng": "bad time", "time.pcapng.gz": "bad time",
           "cut.gz": "bad gzip", "bits.gz": "bad gzip", "section.pcapng": "too short", "nothing.pcap": "empty"}


def test_one_damaged_capture_stops_nothing(spark, tmp_path):
    from wirefold.sources.pcap_source import read_pcap

    files = damaged_files()
    caps = spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in files], "path string, content binary")
    assert {r.path: r.format_error for r in C.capture_rejects(caps).collect()} == REASONS
    good = [("good.pcap", 0), ("good.pcap", 1), ("good.pcapng", 0)]
    assert sorted((r.path, r.packet_no) for r in C.decode_packets(caps).collect()) == good
    for name, content in files:
        (tmp_path / name).write_bytes(content or b"")
    read = read_pcap(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.packet_no) for r in read) == good
    with pytest.raises(Exception, match="gzip inside gzip"):
        C.decode_packets(caps.where("path = 'nested.gz'"), mode="FAILFAST").count()


class Counting(io.BytesIO):
    """A stream that knows how much was asked for at once."""

    largest = 0

    def read(self, n=-1):
        self.largest = max(self.largest, len(self.getvalue()) if n is None or n < 0 else n)
        return super().read(n)


@pytest.mark.parametrize("form", ["classic", "blocks", "gzip"])
def test_captures_are_read_in_bounded_pieces(form):
    big = b"z" * 3_000_000  # one packet of several pieces, cut to the MTU
    content = {"classic": capture([big, FRAME]), "blocks": pcapng([big, FRAME]), "gzip": gzip.compress(capture([big, FRAME]) * 1)}[form]
    f = Counting(content)
    records = list(read_records(f))
    assert [(r.caplen, r.data) for r in records] == [(len(big), big[:0xFFFF]), (len(FRAME), FRAME)]
    assert f.largest <= 1 << 20


def test_sections_interfaces_and_members():
    two = pcapng([FRAME], linktype=101) + pcapng([FRAME, FRAME])
    assert [(r.packet_no, r.linktype) for r in iter_records(two)] == [(0, 101), (1, 1), (2, 1)]
    whole = capture([FRAME, FRAME])
    members = gzip.compress(whole[:50]) + gzip.compress(whole[50:])
    assert [r.data for r in iter_records(members)] == [FRAME, FRAME]
    assert len(list(iter_records(two[:-5]))) == 2  # the last block is cut
