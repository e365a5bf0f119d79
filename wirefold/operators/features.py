"""Packets -> feature rows, captures -> labelled samples.

One chained projection over ``packets``: headers, keep filter, strip the
Ethernet header, widen UDP headers, mask IPv4 addresses, bytes -> vector.
No shuffle; the 1500-double vector is derived last so nothing wide is ever
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import packet as P
from wirefold.operators.labels import attach_labels
from wirefold.sources.captures import decode_packets, spread_packets


def ensure_headers(packets: DataFrame) -> DataFrame:
    """Packets from the decoder already carry ``hdr``; others get it parsed here."""
    return packets if "hdr" in packets.columns else P.with_headers(packets)


def feature_bytes(packets: DataFrame, udp_pad: str = "header", mask_v6: bool = False,
                  flags_from: str = "tcp", out: str = "fbytes") -> DataFrame:
    """Kept packets with their rewritten bytes (before the /255 vector).

    ``udp_pad='header'`` inserts the 12 zeros right after the UDP header (the
    stated intent); ``udp_pad='end'`` puts them after the payload, in front of
    any link padding (where a layered packet builder emits a padding layer).
    """
    if udp_pad not in ("header", "end"):
        raise ValueError(f"udp_pad must be 'header' or 'end', not {udp_pad!r}")
    df = P.keep_packets(ensure_headers(packets), flags_from=flags_from)
    df = df.withColumns({"_s": P.strip_link(), "_sh": P.link_shift()})
    is_udp = f"(hdr.proto = {P.PROTO_UDP} AND hdr.l4_hlen IS NOT NULL)"
    at = ("hdr.l4_off - _sh + 8" if udp_pad == "header"
          else "hdr.payload_off + hdr.payload_len - _sh")
    df = df.withColumn("_p", P.pad_udp("_s", at, is_udp))
    df = df.withColumn("_m", P.mask_ipv4("_p", "hdr.ip4_off - _sh", "hdr.ip4_off IS NOT NULL"))
    if mask_v6:
        df = df.withColumn("_m", P.mask_ipv6("_m", "hdr.ip6_off - _sh", "hdr.ip6_off IS NOT NULL"))
    return df.withColumn(out, F.col("_m")).drop("_s", "_sh", "_p", "_m")


def to_features(packets: DataFrame, n: int = P.FEATURE_LEN, keep: tuple[str, ...] = ("path", "packet_no"),
                **opts) -> DataFrame:
    """``(keep..., feature ARRAY<DOUBLE>)`` for every kept packet."""
    fb = feature_bytes(packets, **opts)
    return fb.select(*keep, P.byte_vector("fbytes", n).alias("feature"))


def preprocess(captures: DataFrame, n: int = P.FEATURE_LEN, with_key: bool = True, as_bytes: bool = False,
               num_partitions: int | None = None, **opts) -> DataFrame:
    """Captures -> ``samples(app_label, traffic_label, feature)``.

    With ``with_key`` the stable row key ``(path, packet_no)`` is kept too, so
    later splits do not depend on partitioning. With ``as_bytes`` the sample
    keeps the rewritten packet bytes (``fbytes``, tens of bytes) instead of the
    1500-double vector (12 kB); ``with_feature`` derives the vector later.
    ``num_partitions`` deals the decoded packets anew, for a few huge captures.
    """
    packets = decode_packets(captures)
    if num_partitions:
        packets = spread_packets(packets, num_partitions)
    fb = feature_bytes(packets, **opts)
    keep = ["path", "packet_no"] if with_key else []
    if as_bytes:
        return attach_labels(fb.select("path", "packet_no", "fbytes")).select(
            *keep, "app_label", "traffic_label", "fbytes")
    # Bytes go through the join, the vector comes after it.
    labelled = attach_labels(fb.select("path", "packet_no", "fbytes"))
    return labelled.select(*keep, "app_label", "traffic_label", P.byte_vector("fbytes", n).alias("feature"))


def with_feature(samples: DataFrame, n: int = P.FEATURE_LEN) -> DataFrame:
    """Derive ``feature`` from stored ``fbytes`` (no-op when the vector is already there)."""
    if "feature" in samples.columns or "fbytes" not in samples.columns:
        return samples
    return samples.withColumn("feature", P.byte_vector("fbytes", n)).drop("fbytes")
