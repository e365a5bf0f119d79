"""Registered queries for sources, packet expressions and labels (S, P, L).

Every query reads the given tables (captures are built by Spark from
``events``) and returns a DataFrame whose columns equal the oracle SQL's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions import packet as P
from wirefold.operators import features as FE
from wirefold.operators import labels as L
from wirefold.plans.oracle_base import byte_digest_sql, with_ev, with_kept
from wirefold.plans.registry import register
from wirefold.sources import captures as C
from wirefold.sources import files as FS
from wirefold.sources.synthetic import captures_from_events, damaged, mixed_packets, recoded_captures, tunnelled_packets


def packets(spark: SparkSession, sf: str) -> DataFrame:
    return C.decode_packets(captures_from_events(spark, sf))


def _hdr_cols() -> list:
    return [F.col(f"hdr.{f}").alias(f) for f in P.HDR_FIELDS]


# --- sources -------------------------------------------------------------------------

@register("capture_manifest", with_ev("""
SELECT prefix || '.' || user_id || '.' || chunk || '.pcap' AS name,
       CAST(24 + sum(16 + frame_len) AS BIGINT) AS length
FROM ev GROUP BY prefix, user_id, chunk"""))
def capture_manifest(spark, sf):
    """Captures written as files, listed back with the ``binaryFile`` source."""
    caps = captures_from_events(spark, sf)
    folder = FS.write_capture_files(caps, spark, folders=FS.folder_count(caps))
    listed = C.capture_manifest(C.listed_captures(spark, FS.capture_folders(spark, folder), glob="*.pcap"))
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@register("packet_decode", with_ev("""
SELECT path, packet_no, CAST(frame_len AS BIGINT) AS caplen, CAST(frame_len AS BIGINT) AS wirelen,
       CAST(1 AS INTEGER) AS linktype, CAST(65535 AS BIGINT) AS snaplen, md5(unhex(frame_hex)) AS data_md5
FROM ev"""))
def packet_decode(spark, sf):
    """One row per record, bytes checked by md5."""
    return packets(spark, sf).select("path", "packet_no", "caplen", "wirelen", "linktype", "snaplen",
                                     F.md5("data").alias("data_md5"))


_DECODED = """
SELECT path, packet_no, CAST(frame_len AS BIGINT) AS caplen, CAST(frame_len AS BIGINT) AS wirelen,
       CAST(1 AS INTEGER) AS linktype, CAST({} AS BIGINT) AS snaplen, CAST(ts_us * 1000 AS BIGINT) AS ts_nanos,
       md5(unhex(frame_hex)) AS data_md5
FROM ev"""


def _decoded(captures: DataFrame) -> DataFrame:
    return C.decode_packets(captures).select("path", "packet_no", "caplen", "wirelen", "linktype", "snaplen", "ts_nanos",
                                             F.md5("data").alias("data_md5"))


@register("gzip_decode", with_ev(_DECODED.format(65535)))
def gzip_decode(spark, sf):
    """Gzip captures."""
    return _decoded(recoded_captures(captures_from_events(spark, sf), "gzip"))


@register("pcapng_decode", with_ev(_DECODED.format(65535)))
def pcapng_decode(spark, sf):
    """Block-format captures."""
    return _decoded(recoded_captures(captures_from_events(spark, sf), "pcapng"))


@register("capture_rejects", with_ev("""
SELECT DISTINCT path, CASE prefix WHEN 'netflix1' THEN 'too short' WHEN 'vpn_email2a' THEN 'bad gzip' ELSE 'bad magic' END AS format_error
FROM ev WHERE prefix <> 'Email1a'"""))
def capture_rejects(spark, sf):
    """Damaged captures are skipped by the decoder and reported with a reason; a sound one is neither."""
    caps = captures_from_events(spark, sf)
    kind = F.lower(F.element_at(F.split("path", "/"), -1))
    whole = recoded_captures(caps.where(kind.startswith("vpn_")), "gzip")
    damaged = caps.where(~kind.startswith("vpn_")).withColumn(
        "content", F.when(kind.startswith("netflix"), F.expr("substring(content, 1, 20)"))
        .when(kind.startswith("mystery"), F.expr("overlay(content PLACING X'00' FROM 1 FOR 1)")).otherwise(F.col("content")))
    damaged = damaged.unionByName(whole.withColumn("content", F.expr("substring(content, 1, length(content) - 9)")))
    rejected = C.capture_rejects(damaged).select("path", "format_error")
    read = C.decode_packets(damaged).select("path").distinct()
    return rejected.join(read, "path", "left_anti")


@register("capture_format", with_ev("""
SELECT DISTINCT path, ['A1B2C3D4', 'D4C3B2A1', 'A1B23C4D'][user_id % 3 + 1] AS magic,
       CASE WHEN user_id % 3 = 1 THEN 'little' ELSE 'big' END AS endian, user_id % 3 = 2 AS nano,
       CAST(NULL AS VARCHAR) AS format_error, CAST(2 AS INTEGER) AS version_major,
       CAST(4 AS INTEGER) AS version_minor, CAST(65535 AS BIGINT) AS snaplen, CAST(1 AS INTEGER) AS linktype
FROM ev"""))
def capture_format(spark, sf):
    """S3: magic, byte order, precision, header fields, reject reason."""
    fmt = C.capture_format(captures_from_events(spark, sf))
    return fmt.select("path", "magic", "endian", "nano", "format_error", "version_major",
                      "version_minor", "snaplen", "linktype")


@register("packet_time", with_ev("""
SELECT path, packet_no, CAST(ts_us * 1000 AS BIGINT) AS ts_nanos, CAST(ts_us AS BIGINT) AS ts_micros FROM ev"""))
def packet_time(spark, sf):
    """Exact nanoseconds and the TIMESTAMP view."""
    return packets(spark, sf).select("path", "packet_no", "ts_nanos", F.unix_micros("ts").alias("ts_micros"))


@register("packet_lengths", with_ev("""
SELECT path, packet_no, CAST(frame_len AS BIGINT) AS caplen, CAST(frame_len AS BIGINT) AS wirelen,
       CAST(frame_len AS INTEGER) AS stored_len, false AS truncated FROM ev"""))
def packet_lengths(spark, sf):
    """Captured / wire length, truncated flag."""
    return C.packet_lengths(packets(spark, sf))


# --- packet expressions ----------------------------------------------------------------

@register("link_dispatch", with_ev("""
SELECT CAST(1 AS INTEGER) AS linktype, CAST(14 AS INTEGER) AS l2_off, CAST(2048 AS INTEGER) AS ethertype,
       count(*) AS n FROM ev"""))
def link_dispatch(spark, sf):
    """Link type -> link header length and ethertype."""
    return packets(spark, sf).groupBy("linktype", F.col("hdr.l2_off").alias("l2_off"),
                                      F.col("hdr.ethertype").alias("ethertype")).agg(F.count("*").alias("n"))


@register("packet_headers", with_ev("""
SELECT path, packet_no, CAST(14 AS INTEGER) AS l2_off, CAST(2048 AS INTEGER) AS ethertype,
       CAST(4 AS INTEGER) AS ip_version, CAST(20 AS INTEGER) AS ip_hlen, CAST(14 AS INTEGER) AS ip_off,
       CAST(2 AS INTEGER) AS ip_flags, CAST(CASE WHEN is_udp THEN 17 ELSE 6 END AS INTEGER) AS proto,
       CAST(ip_total AS INTEGER) AS total_len, CAST(34 AS INTEGER) AS l4_off, CAST(sport AS INTEGER) AS sport,
       CAST(dport AS INTEGER) AS dport, CAST(CASE WHEN is_udp THEN NULL ELSE flags_int END AS INTEGER) AS tcp_flags,
       CAST(l4len AS INTEGER) AS l4_hlen, CAST(34 + l4len AS INTEGER) AS payload_off,
       CAST(plen AS INTEGER) AS payload_len, CAST(pad_len AS INTEGER) AS pad_len,
       CAST(14 AS INTEGER) AS ip4_off, CAST(NULL AS INTEGER) AS ip6_off, CAST(1 AS INTEGER) AS ip_layers
FROM ev"""))
def packet_headers(spark, sf):
    """Every header field of every packet."""
    return packets(spark, sf).select("path", "packet_no", *_hdr_cols())


@register("strip_link", with_ev("""
SELECT path, packet_no, CAST(frame_len - 14 AS INTEGER) AS n_bytes, md5(unhex(substr(frame_hex, 29))) AS bytes_md5
FROM ev"""))
def strip_link(spark, sf):
    """Bytes after the Ethernet header."""
    s = packets(spark, sf).select("path", "packet_no", P.strip_link().alias("b"))
    return s.select("path", "packet_no", F.length("b").alias("n_bytes"), F.md5("b").alias("bytes_md5"))


@register("mask_ip", with_ev("""
SELECT path, packet_no,
       md5(unhex(substr(frame_hex, 1, 52) || '0000000000000000' || substr(frame_hex, 69))) AS bytes_md5
FROM ev"""))
def mask_ip(spark, sf):
    """IPv4 source and destination zeroed (frame kept whole)."""
    s = packets(spark, sf).select("path", "packet_no",
                                  P.mask_ipv4("data", "hdr.ip_off", "hdr.ip_version = 4").alias("b"))
    return s.select("path", "packet_no", F.md5("b").alias("bytes_md5"))


@register("pad_udp", with_ev("""
SELECT path, packet_no,
       CAST(frame_len + CASE WHEN is_udp THEN 12 ELSE 0 END AS INTEGER) AS n_bytes,
       md5(unhex(CASE WHEN is_udp THEN substr(frame_hex, 1, 84) || repeat('00', 12) || substr(frame_hex, 85)
                      ELSE frame_hex END)) AS bytes_md5
FROM ev"""))
def pad_udp(spark, sf):
    """P5: 12 zero bytes after each UDP header (frame kept whole)."""
    is_udp = f"(hdr.proto = {P.PROTO_UDP} AND hdr.l4_hlen IS NOT NULL)"
    s = packets(spark, sf).select("path", "packet_no", P.pad_udp("data", "hdr.l4_off + 8", is_udp).alias("b"))
    return s.select("path", "packet_no", F.length("b").alias("n_bytes"), F.md5("b").alias("bytes_md5"))


@register("omit_tcp_control", with_ev("SELECT path, packet_no, is_control FROM ev"))
def omit_tcp_control(spark, sf):
    """Bare TCP control packets."""
    return packets(spark, sf).select("path", "packet_no", P.is_tcp_control().alias("is_control"))


@register("omit_dns", with_ev("SELECT path, packet_no, is_dns FROM ev"))
def omit_dns(spark, sf):
    """DNS messages."""
    return packets(spark, sf).select("path", "packet_no", P.is_dns().alias("is_dns"))


@register("packet_filter", with_ev("""
SELECT path, count(*) AS n_packets, count(*) FILTER (WHERE NOT is_control AND NOT is_dns) AS n_kept
FROM ev GROUP BY path"""))
def packet_filter(spark, sf):
    """Packets kept per capture."""
    return packets(spark, sf).groupBy("path").agg(
        F.count("*").alias("n_packets"), F.count_if(~P.should_omit()).alias("n_kept"))


@register("byte_vector", with_kept(f"SELECT path, packet_no, {byte_digest_sql('fhex')} FROM kept"))
def byte_vector(spark, sf):
    """P9 (via P12): 1500-double vector of each kept packet, as an exact integer digest."""
    return P.with_digest(FE.to_features(packets(spark, sf)))


@register("sparse_vector", with_kept(f"""
SELECT path, packet_no, n_nonzero AS n_entries, byte_sum AS v_sum, weighted_sum AS iv_sum
FROM (SELECT path, packet_no, {byte_digest_sql('fhex')} FROM kept)"""))
def sparse_vector(spark, sf):
    """P10: non-zero entries (0-based index) of each vector."""
    f = FE.to_features(packets(spark, sf)).select("path", "packet_no", P.to_sparse("feature").alias("sp"))
    return f.select(
        "path", "packet_no", F.size("sp").alias("n_entries"),
        F.expr("CAST(aggregate(sp, 0L, (a, e) -> a + CAST(round(e.v * 255D) AS BIGINT)) AS BIGINT)").alias("v_sum"),
        F.expr("CAST(aggregate(sp, 0L, (a, e) -> a + (e.i + 1) * CAST(round(e.v * 255D) AS BIGINT)) AS BIGINT)")
        .alias("iv_sum"))


@register("dense_vector", with_kept(f"SELECT path, packet_no, {byte_digest_sql('fhex')} FROM kept"))
def dense_vector(spark, sf):
    """Sparse -> dense round trip equals the original vector."""
    f = FE.to_features(packets(spark, sf)).select("path", "packet_no", P.to_sparse("feature").alias("sparse"))
    d = P.with_dense(f, "sparse", "dense")
    return P.with_digest(d.select("path", "packet_no", "dense"), "dense")


@register("packet_features", with_kept(f"""
SELECT path, packet_no, md5(unhex(fhex)) AS bytes_md5, {byte_digest_sql('fhex')} FROM kept"""))
def packet_features(spark, sf):
    """Kept packets -> rewritten bytes -> vector."""
    fb = FE.feature_bytes(packets(spark, sf)).select(
        "path", "packet_no", F.md5("fbytes").alias("bytes_md5"), P.byte_vector("fbytes").alias("feature"))
    return P.with_digest(fb)


# --- labels ------------------------------------------------------------------------------

_APP = "CASE lprefix WHEN 'email1a' THEN 1 WHEN 'netflix1' THEN 7 END"
_TRAFFIC = "CASE lprefix WHEN 'email1a' THEN 1 WHEN 'netflix1' THEN 3 WHEN 'vpn_email2a' THEN 7 END"


@register("preprocess_pipeline", with_kept(f"""
SELECT CAST({_APP} AS BIGINT) AS app_label, CAST({_TRAFFIC} AS BIGINT) AS traffic_label,
       count(*) AS n, CAST(sum(bs) AS BIGINT) AS byte_sum
FROM (SELECT lprefix, byte_sum AS bs FROM (SELECT lprefix, {byte_digest_sql('fhex')} FROM kept))
GROUP BY 1, 2"""))
def preprocess_pipeline(spark, sf):
    """Captures -> labelled samples."""
    s = FE.preprocess(captures_from_events(spark, sf))
    d = s.select("app_label", "traffic_label", P.vector_digest("feature")[2])
    return d.groupBy("app_label", "traffic_label").agg(
        F.count("*").alias("n"), F.sum("byte_sum").cast("bigint").alias("byte_sum"))


@register("capture_prefix", with_ev("SELECT DISTINCT path, lprefix AS prefix FROM ev"))
def capture_prefix(spark, sf):
    """L1: file name up to the first '.', lower-cased."""
    return captures_from_events(spark, sf).select("path", L.capture_prefix("path").alias("prefix"))


@register("label_app", with_ev(f"""
SELECT lprefix AS prefix, CAST({_APP} AS BIGINT) AS app_label, count(*) AS n FROM ev GROUP BY 1, 2"""))
def label_app(spark, sf):
    """L2: application id per capture prefix (null when unmapped)."""
    s = L.attach_labels(packets(spark, sf))
    return s.groupBy(L.capture_prefix("path").alias("prefix"), "app_label").agg(F.count("*").alias("n"))


@register("label_traffic", with_ev(f"""
SELECT lprefix AS prefix, CAST({_TRAFFIC} AS BIGINT) AS traffic_label, count(*) AS n FROM ev GROUP BY 1, 2"""))
def label_traffic(spark, sf):
    """L3: traffic id per capture prefix (null when unmapped)."""
    s = L.attach_labels(packets(spark, sf))
    return s.groupBy(L.capture_prefix("path").alias("prefix"), "traffic_label").agg(F.count("*").alias("n"))


@register("label_name", with_ev(f"""
SELECT lprefix AS prefix, CASE lprefix WHEN 'email1a' THEN 'Email' WHEN 'netflix1' THEN 'Netflix' END AS app_name,
       CASE lprefix WHEN 'email1a' THEN 'Email' WHEN 'netflix1' THEN 'Streaming'
                    WHEN 'vpn_email2a' THEN 'VPN: Email' END AS traffic_name,
       count(*) AS n
FROM ev GROUP BY 1, 2, 3"""))
def label_name(spark, sf):
    """L4: ids -> display names for both tasks."""
    s = L.attach_labels(packets(spark, sf))
    s = L.label_name(s, "app", "app_label", "app_name")
    s = L.label_name(s, "traffic", "traffic_label", "traffic_name")
    return s.groupBy(L.capture_prefix("path").alias("prefix"), "app_name", "traffic_name").agg(
        F.count("*").alias("n"))


@register("task_projection", """
SELECT c_mktsegment AS label, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum
FROM customer WHERE c_acctbal > 0 GROUP BY 1""")
def task_projection(spark, sf):
    """Only rows labelled for the task, label renamed (customers with a positive balance
    carry their segment as label; the rest are unlabelled)."""
    from wirefold.session import read_table

    cust = read_table(spark, sf, "customer").select(
        F.array(F.col("c_custkey").cast("double")).alias("feature"), "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    t = L.task_projection(cust, "segment", keep_key=("c_custkey",))
    return t.groupBy("label").agg(F.count("*").alias("n"), F.sum("c_custkey").cast("bigint").alias("key_sum"))


@register("pcap_source", with_ev("""
SELECT prefix || '.' || user_id || '.' || chunk || '.pcap' AS name, packet_no, CAST(frame_len AS BIGINT) AS caplen,
       CAST(sport AS INTEGER) AS sport, CAST(plen AS INTEGER) AS payload_len, md5(unhex(frame_hex)) AS data_md5
FROM ev"""))
def pcap_source(spark, sf):
    """S2 second form: capture files read by the ``pcap`` data source (one partition per file, streamed)."""
    from wirefold.sources.pcap_source import read_pcap

    caps = captures_from_events(spark, sf)
    folder = FS.write_capture_files(caps, spark, folders=FS.folder_count(caps))
    pk = read_pcap(spark, folder)
    return pk.select(F.element_at(F.split("path", "/"), -1).alias("name"), "packet_no", "caplen",
                     F.col("hdr.sport").alias("sport"), F.col("hdr.payload_len").alias("payload_len"),
                     F.md5("data").alias("data_md5"))


_MIXED = """
WITH m AS (SELECT event_id, event_id % 8 AS shape, event_id % 3 = 0 AS udp, strlen(props) AS plen, 1024 + event_id % 60000 AS sport,
                  CASE WHEN event_id % 7 = 0 THEN 53 ELSE 443 END AS dport FROM events),
x AS (SELECT *, CASE shape WHEN 1 THEN 18 WHEN 2 THEN 26 WHEN 3 THEN 0 ELSE 14 END AS l2,
             CASE WHEN shape IN (4, 5, 6) THEN 40 ELSE 20 END + CASE shape WHEN 5 THEN 24 WHEN 6 THEN 8 WHEN 7 THEN 8 ELSE 0 END AS hlen FROM m),
y AS (SELECT *, shape <> 6 AND plen > 0 AND CASE WHEN udp THEN sport IN (53, 5353) OR dport IN (53, 5353) ELSE sport = 53 OR dport = 53 END AS is_dns,
             shape <> 6 AND NOT udp AND plen = 0 AS is_control FROM x)
"""


@register("mixed_headers", _MIXED + """
SELECT event_id, CAST(l2 AS INTEGER) AS l2_off, CAST(CASE WHEN shape IN (4, 5, 6) THEN 6 ELSE 4 END AS INTEGER) AS ip_version,
       CAST(CASE WHEN udp THEN 17 ELSE 6 END AS INTEGER) AS proto, CAST(hlen AS INTEGER) AS ip_hlen,
       CAST(CASE WHEN shape <> 6 THEN l2 + hlen END AS INTEGER) AS l4_off, CAST(CASE WHEN shape <> 6 THEN sport END AS INTEGER) AS sport,
       CAST(CASE WHEN shape <> 6 THEN dport END AS INTEGER) AS dport, CAST(CASE WHEN shape <> 6 THEN plen END AS INTEGER) AS payload_len,
       is_dns, is_control
FROM y""")
def mixed_headers(spark, sf):
    """Headers behind tags, options, extension headers and fragments, with and without a length."""
    d = P.with_headers(mixed_packets(spark, sf))
    return d.select("event_id", *[F.col("hdr." + c).alias(c) for c in (
        "l2_off", "ip_version", "proto", "ip_hlen", "l4_off", "sport", "dport", "payload_len")], P.is_dns().alias("is_dns"),
                    P.is_tcp_control().alias("is_control"))


@register("unmasked_addresses", _MIXED + """
SELECT CAST(shape AS INTEGER) AS shape, count(*) AS n_kept, CAST(0 AS BIGINT) AS n_unmasked
FROM y WHERE NOT is_dns AND NOT is_control GROUP BY shape""")
def unmasked_addresses(spark, sf):
    """No kept packet of any shape shows an IP address of the fixture."""
    kept = FE.feature_bytes(P.with_headers(mixed_packets(spark, sf)), mask_v6=True)
    seen = F.instr(F.hex("fbytes"), "0A0000010A000002") + F.instr(F.hex("fbytes"), "20" * 16) + F.instr(F.hex("fbytes"), "21" * 16)
    return kept.groupBy("shape").agg(F.count("*").alias("n_kept"), F.count(F.when(seen > 0, 1)).alias("n_unmasked"))


_TUNNELS = _MIXED + """,
t AS (SELECT m.event_id, m.shape, CASE WHEN udp THEN 17 ELSE 6 END AS proto, sport, dport, plen,
             [14, 14, 14, 14, 14, 14, 14, 18][m.shape + 1] AS l2, [34916, 34887, 2048, 2048, 34525, 2048, 2048, 2048][m.shape + 1] AS ethertype,
             [22, 22, 14, 14, 14, 14, 14, 18][m.shape + 1] AS ip, [22, 22, 14, 14, 54, 14, 14, 18][m.shape + 1] AS ip4,
             [NULL, NULL, NULL, NULL, 14, 34, NULL, NULL][m.shape + 1] AS ip6, [1, 1, 2, 2, 2, 2, 2, 1][m.shape + 1] AS layers,
             [42, 42, 54, 62, 74, 74, 72, 38][m.shape + 1] AS l4,
             plen > 0 AND CASE WHEN udp THEN sport IN (53, 5353) OR dport IN (53, 5353) ELSE sport = 53 OR dport = 53 END AS is_dns,
             NOT udp AND plen = 0 AS is_control FROM m)
"""


@register("tunnel_headers", _TUNNELS + """
SELECT event_id, CAST(l2 AS INTEGER) AS l2_off, CAST(ethertype AS INTEGER) AS ethertype, CAST(ip AS INTEGER) AS ip_off, CAST(ip4 AS INTEGER) AS ip4_off,
       CAST(ip6 AS INTEGER) AS ip6_off, CAST(layers AS INTEGER) AS ip_layers, CAST(proto AS INTEGER) AS proto, CAST(l4 AS INTEGER) AS l4_off,
       CAST(sport AS INTEGER) AS sport, CAST(dport AS INTEGER) AS dport, CAST(plen AS INTEGER) AS payload_len, is_dns, is_control
FROM t""")
def tunnel_headers(spark, sf):
    """Layers at any depth, behind PPPoE, MPLS, GRE, IP in IP and bridged Ethernet."""
    d = P.with_headers(tunnelled_packets(spark, sf))
    return d.select("event_id", *[F.col("hdr." + c).alias(c) for c in (
        "l2_off", "ethertype", "ip_off", "ip4_off", "ip6_off", "ip_layers", "proto", "l4_off", "sport", "dport", "payload_len")],
        P.is_dns().alias("is_dns"), P.is_tcp_control().alias("is_control"))


@register("tunnel_addresses", _TUNNELS + """
SELECT CAST(shape AS INTEGER) AS shape, count(*) AS n_kept, CAST(0 AS BIGINT) AS n_outer,
       CASE WHEN shape IN (2, 3, 6) THEN count(*) ELSE 0 END AS n_inner, CAST(sum(CASE WHEN proto = 17 THEN 12 ELSE 0 END) AS BIGINT) AS n_widened
FROM t WHERE NOT is_dns AND NOT is_control GROUP BY shape""")
def tunnel_addresses(spark, sf):
    """The first IPv4 layer at any depth is masked, layers inside it are kept; UDP is widened at any depth."""
    packets = P.with_headers(tunnelled_packets(spark, sf))
    kept = FE.feature_bytes(packets).withColumn("wider", F.length("fbytes") + 14 - F.length("data"))
    seen = lambda addresses: F.count_if(F.instr(F.hex("fbytes"), addresses) > 0)
    return kept.groupBy("shape").agg(F.count("*").alias("n_kept"), seen("0A00000A0A00000B").alias("n_outer"),
                                     seen("0A0000010A000002").alias("n_inner"), F.sum("wider").cast("bigint").alias("n_widened"))


@register("damaged_captures", with_ev("""
SELECT DISTINCT path, CASE user_id % 5 WHEN 0 THEN 'gzip inside gzip' WHEN 1 THEN 'bad link type' WHEN 2 THEN 'bad time' WHEN 3 THEN 'too short' END AS format_error,
       CAST(CASE WHEN user_id % 5 = 4 THEN count(*) OVER (PARTITION BY path) ELSE 0 END AS BIGINT) AS n_packets
FROM ev"""))
def damaged_captures(spark, sf):
    """Damaged captures of every form next to sound ones: each rejected with its reason, the sound ones read whole."""
    caps = damaged(captures_from_events(spark, sf))
    counts = C.decode_packets(caps).groupBy("path").agg(F.count("*").alias("n_packets"))
    named = caps.select("path").join(C.capture_rejects(caps).select("path", "format_error"), "path", "left")
    return named.join(counts, "path", "left").select("path", "format_error", F.coalesce("n_packets", F.lit(0)).cast("bigint").alias("n_packets"))


_SPLIT_SQL = with_ev("""
SELECT prefix || '.' || user_id || '.' || chunk || '.pcap' AS name, packet_no, CAST(frame_len AS BIGINT) AS caplen,
       CAST(ts_us * 1000 AS BIGINT) AS ts_nanos, CAST(sport AS INTEGER) AS sport, md5(unhex(frame_hex)) AS data_md5
FROM ev""")


def _split_read(spark, sf, through: str) -> DataFrame:
    from wirefold.sources.capture_ranges import read_captures

    caps = captures_from_events(spark, sf)
    folder = FS.write_capture_files(caps, spark, folders=FS.folder_count(caps))
    pk = read_captures(spark, FS.capture_folders(spark, folder), range_bytes=1000, through=through)
    return pk.select(F.element_at(F.split("path", "/"), -1).alias("name"), "packet_no", "caplen", "ts_nanos",
                     F.col("hdr.sport").alias("sport"), F.md5("data").alias("data_md5"))


@register("split_captures", _SPLIT_SQL)
def split_captures(spark, sf):
    """Every capture read in ranges of 1000 bytes, each by itself, with the packets and numbers of a sequential reader."""
    return _split_read(spark, sf, "arrow")


@register("split_captures_spark", _SPLIT_SQL)
def split_captures_spark(spark, sf):
    """The same with all bytes read by Spark, so on any file system that Spark reaches."""
    return _split_read(spark, sf, "spark")
