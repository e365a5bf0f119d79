"""Packets as Arrow batches: record headers and bytes of many records are cut out of a buffer at once."""

from __future__ import annotations

import io
import struct
from typing import Iterator

import numpy as np
import pyarrow as pa

from wirefold.functions.headers import HDR_FIELDS, header_arrays
from wirefold.sources.capture_format import (CLASSIC, FILE_HEADER, MTU, RECORD_HEADER, CaptureError, ClassicHeader, Record, classic_header,
                                             read_records)

RECORD_SCHEMA = pa.schema([("path", pa.string()), ("packet_no", pa.int64()), ("ts_nanos", pa.int64()), ("linktype", pa.int32()),
                           ("snaplen", pa.int64()), ("caplen", pa.int64()), ("wirelen", pa.int64()), ("data", pa.binary())])
BATCH_ROWS = 8192
BATCH_BYTES = 32 << 20  # packet bytes held before a batch is handed on


def record_chain(buf: bytes | memoryview, start: int, stop: int, endian: str) -> tuple[list[int], int]:
    """Starts of the records from ``start`` on that begin before ``stop``, and where the next one would begin.

    The chain ends where ``buf`` has no whole record header left.
    """
    caplen = struct.Struct(endian + "I").unpack_from
    last = min(stop, len(buf) - RECORD_HEADER + 1)
    at, found = start, []
    while at < last:
        found.append(at)
        at += RECORD_HEADER + caplen(buf, at + 8)[0]
    return found, at


def classic_batch(path: str | None, buf: bytes | memoryview, starts: list[int], first_no: int, header: ClassicHeader, mtu: int = MTU) -> pa.RecordBatch:
    """The records of a classic capture that start at ``starts`` of ``buf`` (ascending); bytes that ``buf`` doesn't hold are missing."""
    raw = np.frombuffer(buf, np.uint8)
    at = np.array(starts, np.int64)
    fields = raw[at[:, None] + np.arange(RECORD_HEADER)].view(header.endian + "u4").astype(np.int64)
    sec, frac, caplen, wirelen = (np.ascontiguousarray(c) for c in fields.T)
    begin = at + RECORD_HEADER
    end = np.minimum(begin + np.minimum(caplen, mtu), len(raw))
    # Every second value of an array over the whole buffer: bytes of a record, bytes up to the next one, and so on.
    cuts = np.stack([begin, end], 1).ravel()
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(cuts) - 1), [None, pa.py_buffer(cuts), pa.py_buffer(buf)])
    data = spans.take(pa.array(np.arange(0, len(spans), 2))).cast(pa.binary())
    n = len(at)
    nanos = sec * 1_000_000_000 + frac * (1 if header.nano else 1000)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array(np.arange(first_no, first_no + n)), pa.array(nanos),
         pa.array(np.full(n, header.linktype, np.int32)), pa.array(np.full(n, header.snaplen)), pa.array(caplen), pa.array(wirelen), data],
        schema=RECORD_SCHEMA)


def _listed(path: str | None, records: list[Record]) -> pa.RecordBatch:
    columns = list(zip(*records))
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(records), pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, list(RECORD_SCHEMA)[1:]))],
        schema=RECORD_SCHEMA)


def file_batches(path: str | None, f, mtu: int = MTU) -> Iterator[pa.RecordBatch]:
    """The packets of a capture read as a stream, some thousand at a time."""
    held, size = [], 0
    for r in read_records(f, mtu):
        held.append(r)
        size += len(r.data)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _listed(path, held)
            held, size = [], 0
    if held:
        yield _listed(path, held)


def content_batches(path: str | None, content: bytes, mtu: int = MTU) -> Iterator[pa.RecordBatch]:
    """The packets of a capture held in memory; CaptureError before the first batch if it is rejected."""
    if content[:4] not in CLASSIC:
        yield from file_batches(path, io.BytesIO(content), mtu)
        return
    header = classic_header(content[:FILE_HEADER])
    starts, _ = record_chain(content, FILE_HEADER, len(content), header.endian)
    lo = 0
    while lo < len(starts):
        hi = min(lo + BATCH_ROWS, len(starts))
        while hi > lo + 1 and starts[hi - 1] - starts[lo] > BATCH_BYTES:
            hi = (lo + hi + 1) // 2
        yield classic_batch(path, content, starts[lo:hi], lo, header, mtu)
        lo = hi


def with_header_columns(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the ``_hdr_*`` columns of its packets."""
    linktypes = batch.column("linktype").fill_null(-1).to_numpy(zero_copy_only=False)
    found = header_arrays(batch.column("data"), linktypes)
    return pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *("_hdr_" + f for f in HDR_FIELDS)])


def gathered(batches: Iterator[pa.RecordBatch], headers: bool) -> Iterator[pa.RecordBatch]:
    """Small batches put together (so that many small captures cost few steps), with the header columns if wanted."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def flush() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        return with_header_columns(whole) if headers else whole

    for b in batches:
        if held and (rows + b.num_rows > BATCH_ROWS or size + b.nbytes > BATCH_BYTES):
            yield flush()
            held, rows, size = [], 0, 0
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
    if held:
        yield flush()


def decoded(captures: Iterator[tuple[str | None, bytes | None]], mtu: int, failfast: bool) -> Iterator[pa.RecordBatch]:
    """The packets of all (path, content) pairs; rejected captures have none, or raise with ``failfast``."""
    for path, content in captures:
        try:
            yield from content_batches(path, content or b"", mtu)
        except CaptureError as e:
            if failfast:
                raise ValueError(f"{path}: not a readable capture ({e})") from None
