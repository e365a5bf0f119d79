"""Packet header fields, predicates and byte rewrites as Spark column expressions.

Header offsets come from one vectorised numpy pass per Arrow batch
(``wirefold.functions.headers``); predicates and byte rewrites are built-in
column expressions, and the byte vector is one more numpy pass over each
batch. Offsets in the header struct are 0-based byte offsets into ``data``.

Header struct (``hdr``): l2_off, ethertype, ip_version, ip_hlen, ip_off,
ip_flags, proto, total_len, l4_off, sport, dport, tcp_flags, l4_hlen,
payload_off, payload_len, pad_len, ip4_off, ip6_off, ip_layers. The ip_*
fields and pad_len describe the outermost IP layer; proto, the ports and the
payload the innermost one; ip4_off and ip6_off are the first IPv4 and the
first IPv6 layer at any depth. Unknown link type -> ``hdr`` is null and the
packet is kept as raw bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.functions.headers import HDR_FIELDS, header_arrays

# Protocol numbers, DNS ports, TCP flag mask, vector width.
LINKTYPE_ETHERNET = 1
PROTO_TCP = 6
PROTO_UDP = 17
DNS_UDP_PORTS = (53, 5353)
DNS_TCP_PORTS = (53,)
TCP_FIN_SYN_ACK = 0x13
FEATURE_LEN = 1500
UDP_PAD_BYTES = 12


def hdr_struct(prefix: str = "_hdr_") -> Column:
    """Pack the flat ``_hdr_*`` columns into the ``hdr`` struct (null for unknown link types)."""
    return F.when(F.col(prefix + "l2_off").isNull(), F.lit(None)).otherwise(
        F.struct(*[F.col(prefix + f).alias(f) for f in HDR_FIELDS]))


HDR_FLAT_FIELDS = [T.StructField("_hdr_" + f, T.IntegerType(), True) for f in HDR_FIELDS]


def with_headers(df: DataFrame, data: str = "data", linktype: str = "linktype", out: str = "hdr") -> DataFrame:
    """P1 + P2: add the header struct ``out`` parsed from ``data``.

    One Arrow-batched pass; the decoder already does this in its own pass, so
    this is only needed for packets from elsewhere.
    """
    schema = T.StructType(df.schema.fields + HDR_FLAT_FIELDS)

    def run(batches):
        for b in batches:
            linktypes = b.column(linktype).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            found = header_arrays(b.column(data), linktypes)
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *(f.name for f in HDR_FLAT_FIELDS)])

    flat = df.mapInArrow(run, schema)
    return flat.withColumn(out, hdr_struct()).drop(*[f.name for f in HDR_FLAT_FIELDS])


def _in(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


# --- P6-P8: keep / omit predicates ----------------------------------------------------

def is_tcp_control(hdr: str = "hdr", flags_from: str = "tcp") -> Column:
    """TCP with FIN/SYN/ACK set and no payload (trailing link padding is not payload).

    ``flags_from='outermost'`` tests the IPv4 flag bits instead, as a layered
    packet's ``flags`` attribute resolves to the outermost layer having one.
    """
    flags = f"{hdr}.tcp_flags" if flags_from == "tcp" else f"coalesce({hdr}.ip_flags, {hdr}.tcp_flags)"
    return F.expr(
        f"coalesce({hdr}.proto = {PROTO_TCP} AND {hdr}.tcp_flags IS NOT NULL "
        f"AND ({flags} & {TCP_FIN_SYN_ACK}) != 0 AND {hdr}.payload_len = 0, false)"
    )


def is_dns(hdr: str = "hdr") -> Column:
    """A DNS message — UDP port 53/5353 or TCP port 53, with a non-empty payload."""
    u, t = _in(DNS_UDP_PORTS), _in(DNS_TCP_PORTS)
    return F.expr(
        f"coalesce({hdr}.payload_len > 0 AND ("
        f"({hdr}.proto = {PROTO_UDP} AND ({hdr}.sport IN {u} OR {hdr}.dport IN {u})) OR "
        f"({hdr}.proto = {PROTO_TCP} AND ({hdr}.sport IN {t} OR {hdr}.dport IN {t}))), false)"
    )


def should_omit(hdr: str = "hdr", flags_from: str = "tcp") -> Column:
    """Packets that yield no sample."""
    return is_tcp_control(hdr, flags_from) | is_dns(hdr)


def keep_packets(df: DataFrame, hdr: str = "hdr", flags_from: str = "tcp") -> DataFrame:
    return df.where(~should_omit(hdr, flags_from))


# --- P3-P5: byte rewrites ---------------------------------------------------------------

def strip_link(data: str = "data", linktype: str = "linktype") -> Column:
    """Drop the 14-byte Ethernet header; other link types unchanged."""
    return F.expr(f"CASE WHEN {linktype} = {LINKTYPE_ETHERNET} THEN substring({data}, 15, length({data})) "
                  f"ELSE {data} END")


def link_shift(linktype: str = "linktype") -> Column:
    """Bytes removed in front by ``strip_link`` (offsets move left by this much)."""
    return F.expr(f"CASE WHEN {linktype} = {LINKTYPE_ETHERNET} THEN 14 ELSE 0 END")


def mask_ipv4(data: str, ip_off: str, is_v4: str) -> Column:
    """Zero the IPv4 source and destination (8 bytes at ip_off + 12)."""
    return F.expr(f"CASE WHEN {is_v4} AND length({data}) >= {ip_off} + 20 "
                  f"THEN overlay({data} PLACING X'0000000000000000' FROM {ip_off} + 13 FOR 8) "
                  f"ELSE {data} END")


def mask_ipv6(data: str, ip_off: str, is_v6: str) -> Column:
    """P4 option: zero the IPv6 source and destination (32 bytes at ip_off + 8)."""
    zeros = "X'" + "00" * 32 + "'"
    return F.expr(f"CASE WHEN {is_v6} AND length({data}) >= {ip_off} + 40 "
                  f"THEN overlay({data} PLACING {zeros} FROM {ip_off} + 9 FOR 32) ELSE {data} END")


def pad_udp(data: str, at: str, is_udp: str) -> Column:
    """P5: insert 12 zero bytes at 0-based offset ``at`` of UDP packets."""
    zeros = "X'" + "00" * UDP_PAD_BYTES + "'"
    return F.expr(f"CASE WHEN {is_udp} THEN concat(substring({data}, 1, {at}), {zeros}, "
                  f"substring({data}, {at} + 1, length({data}))) ELSE {data} END")


# --- P9-P11: vectors -------------------------------------------------------------------

def byte_vector(data: str = "data", n: int = FEATURE_LEN) -> Column:
    """First ``n`` bytes / 255, zero-padded on the right to ``n`` doubles; null for null.

    One numpy pass over each Arrow batch: the bytes of all packets are one
    buffer, and the vectors one flat array of doubles.
    """

    def vectors(packets):
        if isinstance(packets, pa.ChunkedArray):
            packets = packets.combine_chunks()
        packets = packets.cast(pa.large_binary())
        offsets = np.frombuffer(packets.buffers()[1], np.int64)[packets.offset:packets.offset + len(packets) + 1]
        flat = np.frombuffer(packets.buffers()[2] or b"", np.uint8)
        taken = np.minimum(np.diff(offsets), n)
        if packets.null_count:
            taken = np.where(packets.is_null().to_numpy(zero_copy_only=False), 0, taken)
        out = np.zeros((len(packets), n))
        for row, start, size in zip(out, offsets[:-1].tolist(), taken.tolist()):
            row[:size] = flat[start:start + size]
        out /= 255.0
        ends = np.arange(len(packets) + 1, dtype=np.int32) * n
        mask = packets.is_null() if packets.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=mask)

    vectors.__annotations__ = {"packets": pa.Array, "return": pa.Array}
    return F.arrow_udf(vectors, "array<double>")(F.col(data))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray | None]:
    """(offsets, values, mask of nulls or None) of a list column; a null list has no values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    mask = column.is_null() if column.null_count else None
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), column.flatten(), mask


def to_sparse(vec: str = "feature") -> Column:
    """P10: non-zero entries as ``array<struct<i INT, v DOUBLE>>`` (0-based i), cut out of each Arrow batch at once."""

    def entries(vectors):
        offsets, values, mask = _lists(vectors)
        x = values.to_numpy(zero_copy_only=False)
        kept = x != 0
        if values.null_count:
            kept &= values.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kept)
        ends = np.searchsorted(at, offsets).astype(np.int32)
        place = at - np.repeat(offsets[:-1], np.diff(ends))
        pairs = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(x[at], pa.float64())], ["i", "v"])
        return pa.ListArray.from_arrays(pa.array(ends), pairs, mask=mask)

    entries.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(entries, "array<struct<i:int,v:double>>")(F.col(vec))


def to_dense(sparse: str = "sparse", n: int = FEATURE_LEN) -> Column:
    """Sparse entries (sorted by index) back to ``n`` doubles (more where an entry lies beyond), scattered per Arrow batch."""

    def dense(column):
        offsets, values, mask = _lists(column)
        place = values.field("i").to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.full(len(column), n, np.int64)
        filled = np.diff(offsets) > 0
        sizes[filled] = np.maximum(n, place[offsets[1:][filled] - 1] + 1)
        if mask is not None:
            sizes[mask.to_numpy(zero_copy_only=False)] = 0
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(ends[-1])
        out[np.repeat(ends[:-1], np.diff(offsets)) + place] = values.field("v").to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=mask)

    dense.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(dense, "array<double>")(F.col(sparse))


def with_dense(df: DataFrame, sparse: str = "sparse", out: str = "feature", n: int = FEATURE_LEN) -> DataFrame:
    return df.withColumn(out, to_dense(sparse, n))


DIGEST_FIELDS = ("vec_len", "n_nonzero", "byte_sum", "weighted_sum")
DIGEST_ROWS = 256  # vectors of a batch digested at a time


def _digest(vec: str) -> Column:
    def digest(vectors):
        offsets, values, mask = _lists(vectors)
        x = values.to_numpy(zero_copy_only=False)
        sums = np.zeros((3, len(vectors)), np.int64)
        for lo in range(0, len(vectors), DIGEST_ROWS):
            ends = offsets[lo:lo + DIGEST_ROWS + 1]
            row = np.repeat(np.arange(lo, lo + len(ends) - 1), np.diff(ends))
            part = x[ends[0]:ends[-1]]
            at = np.flatnonzero(part != 0)
            row, place, b = row[at], at + ends[0], np.rint(part[at] * 255).astype(np.int64)
            for out, weights in zip(sums, (np.ones(len(at), np.int64), b, b * (place - offsets[row] + 1))):
                np.add.at(out, row, weights)
        return pa.StructArray.from_arrays([pa.array(np.diff(offsets).astype(np.int32)), pa.array(sums[0].astype(np.int32)), pa.array(sums[1]),
                                           pa.array(sums[2])], list(DIGEST_FIELDS), mask=mask)

    digest.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(digest, "struct<vec_len:int,n_nonzero:int,byte_sum:bigint,weighted_sum:bigint>")(F.col(vec))


def vector_digest(vec: str = "feature") -> list[Column]:
    """Integer summary of a byte vector (exact under hashing): size, non-zero count,
    byte sum and position-weighted byte sum (1-based positions)."""
    d = _digest(vec)
    return [d[c].alias(c) for c in DIGEST_FIELDS]


def with_digest(df: DataFrame, vec: str = "feature") -> DataFrame:
    """``vec`` replaced by the columns of ``vector_digest``.

    The vector is named once, so Spark runs the passes that make it and the
    digest one after the other in one Python step, and no vector leaves it.
    """
    others = [c for c in df.columns if c != vec]
    return df.select(*others, _digest(vec).alias("_digest")).select(*others, *(F.col(f"_digest.{c}") for c in DIGEST_FIELDS))


# Texts of the values that ``byte_vector`` yields, by byte.
BYTE_TEXTS = [repr(b / 255.0) for b in range(256)]


def _number_text(x: float) -> str:
    """A double in JSON, as Spark writes it: what isn't a number is a string."""
    if math.isfinite(x):
        return repr(x)
    return '"NaN"' if math.isnan(x) else '"Infinity"' if x > 0 else '"-Infinity"'


def vector_json(vec: str = "feature") -> Column:
    """The vector as text, a JSON array that reads back as the same doubles; null for null.

    Every value gets the number of its text (0 to 255 for the bytes' values, more for others); the zeros
    at a vector's end are written at once.
    """

    def texts(vectors):
        offsets, values, _ = _lists(vectors)
        x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        absent = ~values.is_valid().to_numpy(zero_copy_only=False) if values.null_count else np.zeros(len(x), bool)
        out = []
        for lo in range(0, len(vectors), DIGEST_ROWS):
            ends = offsets[lo:lo + DIGEST_ROWS + 1]
            bits = np.ascontiguousarray(x[ends[0]:ends[-1]]).view(np.int64)
            at = np.flatnonzero(bits)  # -0.0 is among them
            v = bits[at].view(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                b = np.rint(v * 255)
            known = (b > 0) & (b < 256) & (b / 255.0 == v)
            others, place = np.unique(bits[at[~known]], return_inverse=True)
            numbers = [*BYTE_TEXTS, *map(_number_text, others.view(np.float64).tolist()), "null"]
            codes = np.zeros(len(bits), np.int64)
            codes[at[known]] = b[known]
            codes[at[~known]] = len(BYTE_TEXTS) + place
            codes[absent[ends[0]:ends[-1]]] = len(numbers) - 1
            ends = ends - ends[0]
            used = np.concatenate([[-1], np.flatnonzero(codes)])
            stops = np.maximum(used[np.searchsorted(used, ends[1:]) - 1] + 1, ends[:-1])
            for start, stop, end in zip(ends[:-1].tolist(), stops.tolist(), ends[1:].tolist()):
                head = ",".join([numbers[c] for c in codes[start:stop].tolist()])
                zeros = ",0.0" * (end - stop)
                out.append(f"[{head}{zeros if head else zeros[1:]}]")
        return pa.array(out, pa.string(), mask=vectors.is_null().to_numpy(zero_copy_only=False) if vectors.null_count else None)

    texts.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(texts, "string")(F.col(vec))


def omitted(fields: dict[str, np.ndarray]) -> np.ndarray:
    """P8 over header arrays (-1 where a field does not exist), for code that scores packets inside a Python task."""
    proto, sport, dport, size = (fields[k] for k in ("proto", "sport", "dport", "payload_len"))
    control = (proto == PROTO_TCP) & (fields["tcp_flags"] >= 0) & (fields["tcp_flags"] & TCP_FIN_SYN_ACK != 0) & (size == 0)
    dns = np.select([proto == PROTO_UDP, proto == PROTO_TCP],
                    [np.isin(sport, DNS_UDP_PORTS) | np.isin(dport, DNS_UDP_PORTS), np.isin(sport, DNS_TCP_PORTS) | np.isin(dport, DNS_TCP_PORTS)], False)
    return control | (dns & (size > 0))
