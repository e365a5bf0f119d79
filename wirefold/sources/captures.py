"""Capture scans and the packet decoder.

``captures`` = the built-in ``binaryFile`` schema
``(path, modificationTime, length, content)``; any DataFrame with a
``content BINARY`` column (an upload, a table of blobs) is a capture source.
``decode_packets`` turns captures into ``packets``: one row per record, one
task per group of files, no shuffle. Files too large for a BINARY cell go
through the ``pcap`` data source (``wirefold.sources.pcap_source``), one
large classic capture is read by many tasks (``wirefold.sources.capture_ranges``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.functions.packet import HDR_FLAT_FIELDS, hdr_struct
from wirefold.session import shared_dir
from wirefold.sources.capture_format import MTU, format_error
from wirefold.sources.files import listing_rounds
from wirefold.sources.record_batches import decoded, gathered

PACKET_FIELDS = [
    ("path", T.StringType()),
    ("packet_no", T.LongType()),
    ("ts_nanos", T.LongType()),
    ("linktype", T.IntegerType()),
    ("snaplen", T.LongType()),
    ("caplen", T.LongType()),
    ("wirelen", T.LongType()),
    ("data", T.BinaryType()),
]
DECODED_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in PACKET_FIELDS])
PACKET_COLUMNS = ["path", "packet_no", "ts_nanos", "ts", "linktype", "snaplen", "caplen", "wirelen", "data"]


def scan_captures(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Every file of a folder (or of several), one row each (built-in ``binaryFile`` source)."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def few_tasks(captures: DataFrame) -> DataFrame:
    """Scanned captures in tasks of many files: Spark packs only a handful of small files into one, and every task costs driver memory."""
    return captures.coalesce(4 * captures.sparkSession.sparkContext.defaultParallelism)


def listed_captures(spark: SparkSession, folders: list[str], glob: str | None = None) -> DataFrame:
    """``(path, modificationTime, length)`` of every file of many folders, scanned a few folders at a time, each once, and written."""
    out = shared_dir(spark, "listed")
    columns = ["path", "modificationTime", "length"]
    for part in listing_rounds(spark, folders):
        found = few_tasks(scan_captures(spark, part, glob)).select(*columns)
        found.write.mode("append").parquet(out)
    return spark.read.schema(found.schema).parquet(out)


def capture_manifest(captures: DataFrame) -> DataFrame:
    """File list without the bytes, ordered by name (display order only)."""
    return captures.select("path", "modificationTime", "length").orderBy(F.element_at(F.split("path", "/"), -1), "path")


# --- S3: format detection as column expressions -------------------------------------

def _word(hex_col: str, byte_off: int, little: str) -> str:
    """u32 at ``byte_off`` of a hex string, byte order chosen per row."""
    s = 2 * byte_off + 1
    be = f"substr({hex_col}, {s}, 8)"
    le = (f"concat(substr({hex_col}, {s + 6}, 2), substr({hex_col}, {s + 4}, 2), "
          f"substr({hex_col}, {s + 2}, 2), substr({hex_col}, {s}, 2))")
    return f"CAST(conv(CASE WHEN {little} THEN {le} ELSE {be} END, 16, 10) AS BIGINT)"


def _half(hex_col: str, byte_off: int, little: str) -> str:
    s = 2 * byte_off + 1
    be = f"substr({hex_col}, {s}, 4)"
    le = f"concat(substr({hex_col}, {s + 2}, 2), substr({hex_col}, {s}, 2))"
    return f"CAST(conv(CASE WHEN {little} THEN {le} ELSE {be} END, 16, 10) AS INT)"


def capture_format(captures: DataFrame) -> DataFrame:
    """Add ``magic, endian, nano, format_error, version_major, version_minor, snaplen, linktype``.

    Classic captures are fully described by column expressions; block-format
    and gzip files are recognised by their magic and described by the decoder.
    """
    hdr = "hex(substring(content, 1, 24))"
    magic = "substr(_fh, 1, 8)"
    little = f"{magic} IN ('D4C3B2A1', '4D3CB2A1')"
    classic = f"(length(content) >= 24 AND {magic} IN ('A1B2C3D4', 'A1B23C4D', 'D4C3B2A1', '4D3CB2A1'))"
    df = captures.withColumn("_fh", F.expr(hdr))
    return df.selectExpr(
        "*",
        f"{magic} AS magic",
        f"""CASE WHEN {magic} IN ('A1B2C3D4', 'A1B23C4D') THEN 'big'
                 WHEN {little} THEN 'little'
                 WHEN {magic} = '0A0D0D0A' THEN 'pcapng'
                 WHEN substr(_fh, 1, 4) = '1F8B' THEN 'gzip' END AS endian""",
        f"{magic} IN ('A1B23C4D', '4D3CB2A1') AS nano",
        f"""CASE WHEN length(content) = 0 THEN 'empty'
                 WHEN substr(_fh, 1, 4) = '1F8B' THEN NULL
                 WHEN {magic} = '0A0D0D0A' THEN CASE WHEN length(content) < 28 THEN 'too short' END
                 WHEN {magic} NOT IN ('A1B2C3D4', 'A1B23C4D', 'D4C3B2A1', '4D3CB2A1') THEN 'bad magic'
                 WHEN length(content) < 24 THEN 'too short' END AS format_error""",
        f"CASE WHEN {classic} THEN {_half('_fh', 4, little)} END AS version_major",
        f"CASE WHEN {classic} THEN {_half('_fh', 6, little)} END AS version_minor",
        f"CASE WHEN {classic} THEN {_word('_fh', 16, little)} END AS snaplen",
        f"CASE WHEN {classic} THEN try_cast({_word('_fh', 20, little)} AS INT) END AS linktype",
    ).drop("_fh")


# --- S2: decoder ---------------------------------------------------------------------

def with_packet_time(packets: DataFrame) -> DataFrame:
    """``ts`` from the exact nanosecond count (microsecond TIMESTAMP)."""
    return packets.withColumn("ts", F.timestamp_micros(F.expr("ts_nanos DIV 1000")))


def decode_packets(captures: DataFrame, mode: str = "PERMISSIVE", mtu: int = MTU,
                   headers: bool = True) -> DataFrame:
    """Captures -> packets, narrow (no shuffle), one output row per record.

    ``mode='PERMISSIVE'`` skips unreadable captures (see ``capture_rejects``);
    ``mode='FAILFAST'`` raises on the first one. With ``headers`` the header
    struct ``hdr`` (P1/P2) is parsed in the same pass, vectorised per batch.
    """
    failfast = mode.upper() == "FAILFAST"
    src = captures.select(
        F.col("path") if "path" in captures.columns else F.lit(None).cast("string").alias("path"),
        "content",
    )
    schema = T.StructType(DECODED_SCHEMA.fields + (HDR_FLAT_FIELDS if headers else []))

    def decode(batches):
        cells = ((p.as_py(), c.as_py()) for b in batches for p, c in zip(b.column("path"), b.column("content")))
        return gathered(decoded(cells, mtu, failfast), headers)

    out = with_packet_time(src.mapInArrow(decode, schema))
    if headers:
        return out.select(*PACKET_COLUMNS, hdr_struct().alias("hdr"))
    return out.select(*PACKET_COLUMNS)


def capture_rejects(captures: DataFrame) -> DataFrame:
    """Captures the decoder skips in PERMISSIVE mode, with the decoder's own reason (damaged gzip too)."""

    def reasons(contents):
        return pa.array([format_error(b or b"") for b in contents.to_pylist()], pa.string())

    reasons.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    checked = captures.select("path", F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("length"),
                              F.arrow_udf(reasons, "string")(F.col("content")).alias("format_error"))
    return checked.where(F.col("format_error").isNotNull())


def packet_lengths(packets: DataFrame) -> DataFrame:
    """Captured / wire length and the truncated flag."""
    return packets.select(
        "path", "packet_no", "caplen", "wirelen",
        F.length("data").alias("stored_len"),
        (F.col("caplen") < F.col("wirelen")).alias("truncated"),
    )


def spread_packets(packets: DataFrame, num_partitions: int) -> DataFrame:
    """Re-balance packets after decoding when a few huge captures made a few huge tasks.

    A capture cannot be split while it is read (no sync marker), so one big
    file is one read task; hashing on ``(path, packet_no)`` spreads its packets
    over ``num_partitions`` tasks for the feature and model stages (one
    shuffle of the packet bytes, never of the 1500-double vectors).
    """
    return packets.repartition(num_partitions, "path", "packet_no")
