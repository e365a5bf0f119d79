"""Capture files derived from the ``events`` table.

The repository ships no real captures, so every capture the queries read is
built by Spark from ``events``: one Ethernet/IPv4/TCP-or-UDP frame per event,
grouped into classic capture files (one per user and event-id range; by
user, big-endian microsecond, little-endian microsecond or big-endian
nanosecond format). The oracle side answers the same questions from the ``events``
columns directly, so the decoder and the header parser are checked
independently of this builder.

Frame layout per event (all hex, big endian):

* Ethernet: dst 02:00:00:00:00:01, src 02:00:00:00:00:02, type 0800
* IPv4: 45 00, total length, id = event_id % 65536, 4000 (DF), TTL 40,
  protocol 11 (UDP) when event_id % 3 = 0 else 06 (TCP), checksum 0000,
  source 10.0.0.(user_id % 256), destination 10.0.0.1
* ports: source 1024 + event_id % 60000, destination 53 when event_id % 7 = 0
  else 443
* UDP: length, checksum 0000; TCP: seq 1, ack 2, offset 5, flags by event
  type, window FFFF, checksum 0000, urgent 0000
* payload: the ``props`` text, none for ``error`` events
* frames shorter than 60 bytes are zero-padded to 60 (Ethernet minimum)

A capture holds at most ``RECORDS_PER_CAPTURE`` event ids of one user, so
no capture grows with the table (captures rotate like ``tcpdump -C``).
"""

from __future__ import annotations

import gzip
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.sources.capture_format import iter_records

from wirefold.session import read_table

# Fixed values of the synthetic fixture.
PREFIXES = ["Email1a", "netflix1", "vpn_email2a", "mystery"]
TCP_FLAGS_BY_EVENT = {"click": "02", "view": "10", "signup": "18", "error": "11", "purchase": "08"}
RECORDS_PER_CAPTURE = 65536
GLOBAL_HEADER_HEX = "A1B2C3D4" + "0002" + "0004" + "00000000" + "00000000" + "0000FFFF" + "00000001"
# Capture format per user (user_id % 3): big-endian microseconds, little-endian
# microseconds, big-endian nanoseconds — so the decoder sees three of the four magics.
FORMATS = [
    ("A1B2C3D4", False, False),
    ("D4C3B2A1", True, False),
    ("A1B23C4D", False, True),
]
MIN_FRAME = 60


def global_header_hex(magic: str, little: bool) -> str:
    def w16(v: int) -> str:
        h = f"{v:04X}"
        return h[2:] + h[:2] if little else h

    def w32(v: int) -> str:
        h = f"{v:08X}"
        return "".join(reversed([h[i:i + 2] for i in range(0, 8, 2)])) if little else h

    return magic + w16(2) + w16(4) + w32(0) + w32(0) + w32(65535) + w32(1)


def _h(expr: str, width: int) -> str:
    return f"lpad(hex({expr}), {width}, '0')"


def frame_columns_sql() -> list[str]:
    """Projection list (SQL text) adding the frame pieces to ``events``."""
    flags = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TCP_FLAGS_BY_EVENT.items())
    return [
        "event_id", "user_id", "event_type", "ts",
        "event_id % 3 = 0 AS is_udp",
        "CASE WHEN event_id % 7 = 0 THEN 53 ELSE 443 END AS dport",
        "1024 + event_id % 60000 AS sport",
        "CASE WHEN event_type = 'error' THEN '' ELSE hex(props) END AS payload_hex",
        f"CASE event_type {flags} ELSE '00' END AS flags_hex",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS ts_us",
    ]


def frame_hex_sql(idiv: str = "DIV") -> str:
    """SQL text of one frame's hex, over the columns of ``frame_columns_sql``.

    The same text runs in Spark and DuckDB; only integer division is spelt
    differently (``idiv='//'`` for DuckDB).
    """
    plen = f"(length(payload_hex) {idiv} 2)"
    l4len = "(CASE WHEN is_udp THEN 8 ELSE 20 END)"
    ip_total = f"(20 + {l4len} + {plen})"
    eth = "'020000000001' || '020000000002' || '0800'"
    ip = (
        f"'4500' || {_h(ip_total, 4)} || {_h('event_id % 65536', 4)} || '4000' || '40' || "
        f"(CASE WHEN is_udp THEN '11' ELSE '06' END) || '0000' || "
        f"'0A0000' || {_h('user_id % 256', 2)} || '0A000001'"
    )
    ports = f"{_h('sport', 4)} || {_h('dport', 4)}"
    l4rest = (
        f"(CASE WHEN is_udp THEN {_h('8 + ' + plen, 4)} || '0000' "
        f"ELSE '00000001' || '00000002' || '50' || flags_hex || 'FFFF' || '0000' || '0000' END)"
    )
    body = f"{eth} || {ip} || {ports} || {l4rest} || payload_hex"
    pad = f"repeat('00', greatest(0, {MIN_FRAME} - (14 + {ip_total})))"
    return f"({body} || {pad})"


def _u32(expr: str, little: str) -> str:
    """u32 as hex in the capture's byte order (``little`` is a SQL boolean)."""
    h = _h(expr, 8)
    le = f"concat(substr({h}, 7, 2), substr({h}, 5, 2), substr({h}, 3, 2), substr({h}, 1, 2))"
    return f"(CASE WHEN {little} THEN {le} ELSE {h} END)"


def record_hex_sql(frame: str) -> str:
    """Record header (sec, usec or nsec, caplen, wirelen) in the capture's byte order + the frame of column ``frame``, as hex."""
    flen = f"(length({frame}) DIV 2)"
    little = f"(user_id % {len(FORMATS)} = 1)"
    frac = f"(ts_us % 1000000) * (CASE WHEN user_id % {len(FORMATS)} = 2 THEN 1000 ELSE 1 END)"
    return (
        f"{_u32('ts_us DIV 1000000', little)} || {_u32(frac, little)} || "
        f"{_u32(flen, little)} || {_u32(flen, little)} || {frame}"
    )


def event_frames(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """One row per event with its frame hex and capture key, in ``tasks`` tasks if given (else as many as Spark finds fit)."""
    # The events of a capture meet before their frames are built: rows are smaller than frames, and a table in one
    # file is read by few tasks.  Grouping by capture needs no further shuffle.
    ev = read_table(spark, sf_dir, "events").select("*", F.expr(f"event_id DIV {RECORDS_PER_CAPTURE} AS chunk"))
    ev = ev.repartition(tasks, "user_id", "chunk") if tasks else ev.repartition("user_id", "chunk")
    # The frame is a column of its own: the record header reads its length several times.
    ev = ev.selectExpr(*frame_columns_sql(), "chunk").selectExpr(
        "event_id", "user_id", "event_type", "ts", "ts_us", "chunk", f"{frame_hex_sql()} AS frame_hex")
    prefixes = "array(" + ", ".join(f"'{p}'" for p in PREFIXES) + ")"
    return ev.selectExpr(
        "event_id", "user_id", "event_type", "ts",
        f"element_at({prefixes}, CAST(user_id % {len(PREFIXES)} AS INT) + 1) AS prefix",
        "chunk",
        f"{record_hex_sql('frame_hex')} AS rec_hex",
    )


def capture_path_sql(root: str = "/captures") -> str:
    return f"concat('{root}/', prefix, '.', user_id, '.', chunk, '.pcap')"


def captures_from_events(spark: SparkSession, sf_dir: str, root: str = "/captures", tasks: int | None = None) -> DataFrame:
    """``captures(path, modificationTime, length, content)`` built from ``events``.

    Same schema as the built-in ``binaryFile`` source, so every capture
    operator runs unchanged on real files.  ``tasks``: number of tasks, for work that Spark can't tell from the size
    of the events (a sample's vector is hundreds of times as large as its event).
    """
    frames = event_frames(spark, sf_dir, tasks)
    grouped = frames.groupBy("prefix", "user_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "rec_hex"))).alias("recs"),
        F.max("ts").alias("last_ts"),
    )
    headers = "element_at(array(" + ", ".join(f"'{global_header_hex(m, le)}'" for m, le, _n in FORMATS) + \
        f"), CAST(user_id % {len(FORMATS)} AS INT) + 1)"
    return grouped.selectExpr(
        f"{capture_path_sql(root)} AS path",
        "CAST(last_ts AS TIMESTAMP) AS modificationTime",
        f"unhex({headers} || concat_ws('', transform(recs, r -> r.rec_hex))) AS content",
    ).withColumn("length", F.length("content").cast("bigint")).select(
        "path", "modificationTime", "length", "content"
    )


def _as_pcapng(content: bytes) -> bytes:
    """A classic capture as a block-format one: a section, one interface in nanoseconds, one block per packet."""
    def block(kind: int, body: bytes) -> bytes:
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = [block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))]
    described = False
    for r in iter_records(content):
        if not described:
            out.append(block(1, struct.pack("<HHI", r.linktype, 0, r.snaplen) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0)))
            described = True
        t = r.ts_nanos
        out.append(block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, r.caplen, r.wirelen) + r.data))
    return b"".join(out)


def recoded_captures(captures: DataFrame, form: str) -> DataFrame:
    """The same captures as ``gzip`` or ``pcapng`` files."""
    recode = {"gzip": lambda b: gzip.compress(b, mtime=0), "pcapng": _as_pcapng}[form]

    def run(contents):
        return pa.array([None if b is None else recode(b) for b in contents.to_pylist()], pa.binary())

    run.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    return captures.withColumn("content", F.arrow_udf(run, "binary")(F.col("content")))


def damaged(captures: DataFrame) -> DataFrame:
    """The captures damaged by user (``user_id % 5``).

    0 gzip inside gzip, 1 a link type beyond 31 bits, 2 a block format whose last packet has a time beyond 64 bits of
    nanoseconds, 3 cut within the file header, 4 sound.
    """
    def run(paths, contents):
        out = []
        for path, content in zip(paths.to_pylist(), contents.to_pylist()):
            kind = int(path.split(".")[-3]) % 5
            if kind == 0:
                content = gzip.compress(gzip.compress(content, mtime=0), mtime=0)
            elif kind == 1:
                content = content[:20] + b"\xff" * 4 + content[24:]
            elif kind == 2:
                late = struct.pack("<IIIII", 0, 0xFFFFFFFF, 0, 0, 0)
                content = _as_pcapng(content) + struct.pack("<II", 6, 32) + late + struct.pack("<I", 32)
            elif kind == 3:
                content = content[:23]
            out.append(content)
        return pa.array(out, pa.binary())

    run.__annotations__ = {"paths": pa.Array, "contents": pa.Array, "return": pa.Array}
    return captures.withColumn("content", F.arrow_udf(run, "binary")("path", "content"))


def mixed_packets(spark: SparkSession, sf: str) -> DataFrame:
    """One packet per event in eight shapes (``event_id % 8``), for the header parser.

    0 Ethernet, 1 one VLAN tag, 2 three tags, 3 raw IP, 4 IPv6, 5 IPv6 with two
    extension headers, 6 a later IPv6 fragment, 7 IPv4 options. Every second
    event of shape 4 has an IPv6 length field of 0. Ports and payload as in the
    capture fixture, TCP flags PSH and ACK; captured length below the wire's.
    """
    word = lambda x: f"lpad(hex({x}), 4, '0')"
    l4 = (f"concat({word('sport')}, {word('dport')}, if(udp, concat({word('8 + plen')}, '0000'), "
          "'00000001000000025018FFFF00000000'), hex(props))")
    v4 = (f"concat(if(shape = 7, '47', '45'), '00', {word('if(shape = 7, 28, 20) + l4len + plen')}, '0000400040', proto, "
          "'00000A0000010A000002', if(shape = 7, repeat('01', 8), ''), l4)")
    ext = (f"CASE shape WHEN 5 THEN concat('3C00010400000000', proto, '01010C', repeat('00', 12)) "
           f"WHEN 6 THEN concat(proto, '00', '0321', '00000007') ELSE '' END")
    first = "CASE shape WHEN 5 THEN '00' WHEN 6 THEN '2C' ELSE proto END"
    v6 = (f"concat('60000000', {word('if(shape = 4 and event_id % 16 = 4, 0, length(ext) / 2 + l4len + plen)')}, {first}, '40', "
          "repeat('20', 16), repeat('21', 16), ext, l4)")
    link = ("CASE shape WHEN 1 THEN concat(eth, '810000070800') WHEN 2 THEN concat(eth, '88A8000581000006810000070800') "
            "WHEN 3 THEN '' WHEN 0 THEN concat(eth, '0800') WHEN 7 THEN concat(eth, '0800') ELSE concat(eth, '86DD') END")
    e = read_table(spark, sf, "events").selectExpr(
        "event_id", "props", "cast(event_id % 8 as int) AS shape", "event_id % 3 = 0 AS udp", "octet_length(props) AS plen",
        "1024 + event_id % 60000 AS sport", "if(event_id % 7 = 0, 53, 443) AS dport", "'020000000001020000000002' AS eth")
    e = e.selectExpr("*", "if(udp, '11', '06') AS proto", "if(udp, 8, 20) AS l4len")
    e = e.selectExpr("*", f"{l4} AS l4", f"{ext} AS ext")
    e = e.selectExpr("event_id", "shape", f"unhex(concat({link}, if(shape IN (4, 5, 6), {v6}, {v4}))) AS data")
    return e.select("event_id", "shape", F.when(F.col("shape") == 3, 101).otherwise(1).alias("linktype"), "data")


def tunnelled_packets(spark: SparkSession, sf: str) -> DataFrame:
    """One packet per event behind other layers, in eight shapes (``event_id % 8``).

    0 PPPoE, 1 two MPLS labels, 2 IPv4 in IPv4, 3 GRE with a key, 4 IPv4 in
    IPv6, 5 IPv6 in IPv4, 6 Ethernet bridged over GRE, 7 a tag of type 9100.
    Ports and payload as in ``mixed_packets``; outer IPv4 addresses 10.0.0.10 and
    10.0.0.11, inner ones 10.0.0.1 and 10.0.0.2.
    """
    word = lambda x: f"lpad(hex({x}), 4, '0')"
    l4 = (f"concat({word('sport')}, {word('dport')}, if(udp, concat({word('8 + plen')}, '0000'), "
          "'00000001000000025018FFFF00000000'), hex(props))")
    size = "(length(l4) / 2)"

    def v4(proto: str, addresses: str, body: str, length: str) -> str:
        return f"concat('4500', {word(f'20 + {length}')}, '0000400040', {proto}, '0000', '{addresses}', {body})"

    def v6(proto: str, body: str, length: str) -> str:
        return f"concat('60000000', {word(length)}, {proto}, '40', repeat('20', 16), repeat('21', 16), {body})"

    outer, inner = "0A00000A0A00000B", "0A0000010A000002"
    plain = v4("proto", inner, "l4", size)
    shapes = [
        f"concat(eth, '8864', '11000001', {word(f'22 + {size}')}, '0021', {plain})",
        f"concat(eth, '8847', '0000A040', '0000B140', {plain})",
        "concat(eth, '0800', " + v4("'04'", outer, plain, f"20 + {size}") + ")",
        "concat(eth, '0800', " + v4("'2F'", outer, f"concat('20000800', '0000002A', {plain})", f"28 + {size}") + ")",
        "concat(eth, '86DD', " + v6("'04'", plain, f"20 + {size}") + ")",
        "concat(eth, '0800', " + v4("'29'", outer, v6("proto", "l4", size), f"40 + {size}") + ")",
        "concat(eth, '0800', " + v4("'2F'", outer, f"concat('00006558', eth, '0800', {plain})", f"38 + {size}") + ")",
        f"concat(eth, '9100', '0007', '0800', {plain})",
    ]
    e = read_table(spark, sf, "events").selectExpr(
        "event_id", "props", "cast(event_id % 8 as int) AS shape", "event_id % 3 = 0 AS udp", "octet_length(props) AS plen",
        "1024 + event_id % 60000 AS sport", "if(event_id % 7 = 0, 53, 443) AS dport", "'020000000001020000000002' AS eth")
    e = e.selectExpr("*", "if(udp, '11', '06') AS proto", f"{l4} AS l4")
    frames = "CASE shape " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes)) + " END"
    # MPLS labels: the first one isn't the bottom of the stack, the second one is.
    return e.selectExpr("event_id", "shape", "1 AS linktype", f"unhex({frames}) AS data")
