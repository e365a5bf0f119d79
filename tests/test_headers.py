import struct

from pyspark.sql import functions as F

from captures_fixture import capture, eth, ipv4, tcp, udp
from wirefold.functions import packet as P
from wirefold.operators import features as FE
from wirefold.sources import captures as C


def hdrs(spark, frames, linktype=1):
    caps = spark.createDataFrame([("x.pcap", bytearray(capture(frames, linktype=linktype)))],
                                 "path string, content binary")
    return C.decode_packets(caps).orderBy("packet_no")


def test_fields_tcp_udp_vlan_options(spark):
    frames = [
        eth(0x0800, ipv4(6, tcp(1234, 443, 0x10))) + b"\0" * 6,           # bare ACK padded to 60
        eth(0x0800, ipv4(17, udp(5000, 53, b"q" * 10))),                    # DNS over UDP
        eth(0x0800, ipv4(6, tcp(1, 2, 0x18, b"abc")), vlan=7),              # VLAN
        eth(0x0800, ipv4(6, tcp(1, 2, 0x18, b"abc"), options=b"\x01" * 8)),  # IP options
        eth(0x0806, b"\x00" * 28),                                          # ARP
    ]
    rows = hdrs(spark, frames).select("hdr", P.is_tcp_control().alias("c"), P.is_dns().alias("d")).collect()
    h0, h1, h2, h3, h4 = [r.hdr for r in rows]
    assert (h0.proto, h0.tcp_flags, h0.payload_len, h0.pad_len, rows[0].c) == (6, 0x10, 0, 6, True)
    assert (h1.proto, h1.dport, h1.payload_len, rows[1].d) == (17, 53, 10, True)
    assert (h2.l2_off, h2.ip_off, h2.l4_off, h2.payload_len, rows[2].c) == (18, 18, 38, 3, False)
    assert (h3.ip_hlen, h3.l4_off, h3.payload_len) == (28, 42, 3)
    assert h4.ethertype == 0x0806 and h4.ip_version is None and rows[4].c is False


def test_raw_ipv6_and_unknown_linktype(spark):
    v6 = (bytes([0x60, 0, 0, 0]) + struct.pack(">HBB", 23, 6, 64) + b"\x20" * 32 + tcp(9, 10, 0x02, b"abc"))
    r = hdrs(spark, [v6], linktype=101).first().hdr
    assert (r.ip_version, r.proto, r.l4_off, r.payload_len, r.sport) == (6, 6, 40, 3, 9)
    assert hdrs(spark, [b"\x01\x02\x03"], linktype=999).first().hdr is None


def test_feature_rewrites(spark):
    body = b"p" * 4
    fr = eth(0x0800, ipv4(17, udp(7, 8, body))) + b"\0" * 14  # padded to 60
    pk = hdrs(spark, [fr])
    head = FE.feature_bytes(pk).first().fbytes
    end = FE.feature_bytes(pk, udp_pad="end").first().fbytes
    ip = bytearray(fr[14:])
    ip[12:20] = b"\0" * 8
    assert bytes(head) == bytes(ip[:28]) + b"\0" * 12 + bytes(ip[28:])
    assert bytes(end) == bytes(ip[:32]) + b"\0" * 12 + bytes(ip[32:])
    vec = FE.to_features(pk).first().feature
    assert len(vec) == 1500 and vec[0] == 0x45 / 255 and vec[len(head)] == 0.0


def test_vector_truncates_at_1500_and_sparse_roundtrip(spark):
    big = eth(0x0800, ipv4(17, udp(7, 8, bytes(range(256)) * 8)))
    pk = hdrs(spark, [big])
    f = FE.to_features(pk).select("feature", P.to_sparse("feature").alias("sp"))
    d = f.select("feature", P.to_dense("sp").alias("dense")).first()
    assert len(d.feature) == 1500 and list(d.dense) == list(d.feature)


def test_zero_total_length_means_all_captured_bytes(spark):
    fr = eth(0x0800, ipv4(6, tcp(1, 2, 0x10, b"xyz"), total=0))
    h = hdrs(spark, [fr]).select("hdr", P.is_tcp_control().alias("c")).first()
    assert (h.hdr.total_len, h.hdr.payload_len, h.hdr.pad_len, h.c) == (0, 3, 0, False)


def v6(next_header, body, length=None, ext=()):
    """IPv6 packet; ``ext`` = (type, total bytes) of extension headers in order."""
    kinds = [t for t, _ in ext] + [next_header]
    chain = b"".join(bytes([kinds[i + 1], n // 8 - 1]) + b"\x01\x04" + b"\0" * (n - 4) for i, (_, n) in enumerate(ext))
    body = chain + body
    return bytes([0x60, 0, 0, 0]) + struct.pack(">HBB", len(body) if length is None else length, kinds[0], 64) + b"\x20" * 32 + body


def test_no_cap_on_tags_and_extension_headers(spark):
    tagged = eth(0x0800, ipv4(17, udp(5000, 53, b"q" * 10)), vlan=7)
    for _ in range(3):
        tagged = tagged[:12] + b"\x81\x00\x00\x05" + tagged[12:]
    frames = [
        tagged,                                                                      # four VLAN tags
        eth(0x86DD, v6(17, udp(5000, 53, b"q" * 10), ext=[(0, 8), (60, 8), (43, 8), (60, 8), (60, 8), (60, 8)])),
        eth(0x86DD, v6(17, udp(5000, 53, b"q" * 10), ext=[(60, 2048)])),             # L4 far behind byte 256
        eth(0x86DD, v6(6, tcp(9, 10, 0x10, b"x" * 100), length=0)),                  # length field 0
    ]
    rows = hdrs(spark, frames).select("hdr", P.is_tcp_control().alias("c"), P.is_dns().alias("d")).collect()
    assert [r.d for r in rows] == [True, True, True, False]
    assert (rows[0].hdr.l2_off, rows[0].hdr.ip_version, rows[0].hdr.dport) == (30, 4, 53)
    assert (rows[1].hdr.proto, rows[1].hdr.payload_len) == (17, 10)
    assert (rows[2].hdr.sport, rows[2].hdr.l4_off) == (5000, 14 + 40 + 2048)
    assert (rows[3].hdr.payload_len, rows[3].hdr.pad_len, rows[3].c) == (100, 0, False)


def test_later_ipv6_fragments_have_no_ports(spark):
    def fragment(offset, body):
        return eth(0x86DD, v6(44, struct.pack(">BBHI", 17, 0, offset << 3 | 1, 7) + body))

    frames = [fragment(0, udp(5000, 53, b"q" * 10)), fragment(100, b"\x00\x35\x00\x35" + b"z" * 20)]
    rows = hdrs(spark, frames).select("hdr", P.is_dns().alias("d")).collect()
    assert rows[0].d and rows[0].hdr.dport == 53
    assert not rows[1].d and rows[1].hdr.sport is None and rows[1].hdr.proto == 17 and rows[1].hdr.l4_off is None


def test_addresses_behind_many_tags_are_masked(spark):
    frame = eth(0x0800, ipv4(6, tcp(1, 2, 0x18, b"abc")), vlan=7)
    for _ in range(3):
        frame = frame[:12] + b"\x81\x00\x00\x05" + frame[12:]
    row = FE.feature_bytes(hdrs(spark, [frame])).first()
    assert bytes(row.fbytes)[30 - 14 + 12:30 - 14 + 20] == b"\0" * 8
    v = FE.to_features(hdrs(spark, [frame])).first().feature
    assert len(v) == 1500 and [round(x * 255) for x in v[:len(row.fbytes)]] == list(row.fbytes)


def test_vector_of_null_empty_and_long_bytes(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(range(256)) * 8)], "k int, data binary")
    rows = {r.k: r.v for r in df.select("k", P.byte_vector("data").alias("v")).collect()}
    assert rows[1] is None and rows[2] == [0.0] * 1500 and rows[3] == [i % 256 / 255 for i in range(1500)]


def test_layers_behind_tunnels(spark):
    inner = ipv4(17, udp(5000, 53, b"q" * 10))
    qinq = eth(0x9100, b"\x00\x05\x08\x00" + inner)
    pppoe = eth(0x8864, b"\x11\x00\x00\x01" + struct.pack(">HH", len(inner) + 2, 0x21) + inner)
    mpls = eth(0x8847, b"\x00\x00\xa0\x40" * 5 + b"\x00\x00\xb1\x40" + inner)
    ipip = eth(0x0800, ipv4(4, ipv4(4, inner)))
    gre = eth(0x0800, ipv4(47, b"\xb0\x00\x08\x00" + b"\0" * 12 + inner))  # checksum, key, sequence number
    bridged = eth(0x86DD, v6(47, b"\x00\x00\x65\x58" + eth(0x0800, inner, vlan=9)))
    sealed = eth(0x0800, ipv4(51, bytes([17, 4]) + b"\0" * 22 + udp(5000, 53, b"q" * 10)))
    rows = hdrs(spark, [qinq, pppoe, mpls, ipip, gre, bridged, sealed]).select("hdr", P.is_dns().alias("d")).collect()
    assert all(r.d and (r.hdr.proto, r.hdr.sport, r.hdr.payload_len) == (17, 5000, 10) for r in rows)
    assert [r.hdr.ip_layers for r in rows] == [1, 1, 1, 3, 2, 2, 1]
    assert [r.hdr.ip4_off for r in rows] == [18, 22, 14 + 24, 14, 14, 14 + 40 + 4 + 18, 14]
    assert [r.hdr.l4_off for r in rows] == [38, 42, 58, 74, 14 + 20 + 16 + 20, 14 + 40 + 4 + 18 + 20, 58]
    assert [r.hdr.ip_off for r in rows] == [18, 22, 38, 14, 14, 14, 14]


def test_first_ipv4_layer_is_masked_at_any_depth(spark):
    inner = ipv4(17, udp(7, 8, b"pay"))
    frames = [eth(0x0800, ipv4(4, inner)), eth(0x86DD, v6(4, inner)), eth(0x8847, b"\x00\x00\xa1\x40" + inner)]
    masked = [bytes(r.fbytes) for r in FE.feature_bytes(hdrs(spark, frames)).orderBy("packet_no").collect()]
    zeros = b"\0" * 8
    assert masked[0][12:20] == zeros and masked[0][32:40] == inner[12:20]  # the outer one alone
    assert masked[1][52:60] == zeros and masked[2][16:24] == zeros
    assert [len(m) for m in masked] == [len(f) - 14 + 12 for f in frames]  # UDP inside is widened


def test_walk_ends_on_any_bytes():
    import random

    import numpy as np
    import pyarrow as pa

    from wirefold.functions.headers import HDR_FIELDS, header_arrays

    rng = random.Random(7)
    starts = ["", "0800", "86DD", "8847", "8864110000010016" + "0021", "8100", "9100", "080045000020000040004" + "02f"]
    packets = [bytes.fromhex("02" * 12 + s + "0" * (len(s) % 2)) + rng.choice([rng.randbytes(rng.randint(0, 90)), b"\0" * 70, b"\x45\0" * 40, b"\x88\x47" * 30])
               for s in starts for _ in range(200)]
    packets += [None, b"", b"\x02" * 12 + b"\x81\x00\x00\x05" * 16_000, b"\x40" + b"\0" * 8 + b"\x04" * 60]
    linktypes = np.array([rng.choice([1, 1, 1, 101, 113, 276, 0, 999]) for _ in packets[:-1]] + [101])
    out = header_arrays(pa.array(packets, pa.binary()), linktypes)
    assert len(out) == len(HDR_FIELDS) and all(len(a) == len(packets) for a in out)


def test_vectors_stay_in_one_python_step(spark):
    rows = spark.createDataFrame([(1, bytearray(b"\x00\x07\x00\xff")), (2, None), (3, bytearray())], "k int, b binary")
    sparse = rows.select("k", P.byte_vector("b", 6).alias("v")).select("k", P.to_sparse("v").alias("s"))
    digest = P.with_digest(sparse.select("k", P.to_dense("s", 6).alias("v")), "v")
    plan = digest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(map(tuple, digest.collect())) == [(1, 6, 2, 262, 2 * 7 + 4 * 255), (2, None, None, None, None), (3, 6, 0, 0, 0)]
    beyond = spark.createDataFrame([([(1, 2.0), (4, 3.0)],), ([],), (None,)], "s array<struct<i:int,v:double>>")
    assert [r.d for r in beyond.select(P.to_dense("s", 3).alias("d")).collect()] == [[0.0, 2.0, 0.0, 0.0, 3.0], [0.0] * 3, None]
    holes = spark.createDataFrame([([1.0, None, 0.0, 5.0],)], "v array<double>")
    assert [tuple(e) for e in holes.select(P.to_sparse("v").alias("s")).first().s] == [(0, 1.0), (3, 5.0)]


def test_frames_are_built_behind_the_only_shuffle(spark):
    from tables import SF_SMALL
    from wirefold.sources.synthetic import captures_from_events

    plan = captures_from_events(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "frame_hex" not in plan[plan.index("Exchange"):]
