"""E5 for captures that are still being written: labels that follow every append.

A growing classic capture arrives as rows ``(path, seq, content)``, the
``seq``-th piece of the file's bytes (0 the first), cut anywhere.  Per capture a
keyed state holds the file header, the bytes of the record at hand, the votes so
far, and pieces that came early.  So a piece is decoded once, whole records are
scored as soon as they are there, and the state never holds more than one record
(cut to the MTU) besides early pieces.  After the last piece the label is that
of the batch job over the whole file.

Captures share the keys of the state by the hash of their path, a few dozen
each: a call of a task's function costs milliseconds whatever it does, and the
packets of all captures of a key are scored together.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirefold.operators.labels import label_name
from wirefold.sources.capture_format import FILE_HEADER, MTU, RECORD_HEADER, CaptureError, classic_header

PIECES = "path string, seq long, content binary"
LABELS = "path string, seq long, n_records long, n_packets long, prediction int, error string"
STATE = "followers binary"
KEYS = 4096
SCORED_BYTES = 32 << 20  # packet bytes held before they are scored
# (packets, link type) -> class per packet, -1 where it has no vote.
Classify = Callable[[pa.Array, int], np.ndarray]


class Follower:
    """The state of one capture between its pieces."""

    def __init__(self, classes: int, state: tuple | None = None, mtu: int = MTU):
        self.mtu = mtu
        self.next, self.skip, self.records, self.head, self.rest, votes, early, self.error = state or (0, 0, 0, b"", b"", b"", b"", None)
        self.votes = np.frombuffer(votes, np.int64).copy() if votes else np.zeros(classes, np.int64)
        self.early: dict[int, bytes] = {}
        at = 0
        while at < len(early):
            seq, size = struct.unpack_from("<qq", early, at)
            self.early[seq] = early[at + 16:at + 16 + size]
            at += 16 + size

    def state(self) -> tuple:
        early = b"".join(struct.pack("<qq", s, len(b)) + b for s, b in sorted(self.early.items()))
        return self.next, self.skip, self.records, bytes(self.head), bytes(self.rest), self.votes.tobytes(), early, self.error

    def add(self, seq: int, content: bytes, classify: Classify) -> None:
        """Take a piece and score its packets."""
        for packets, linktype in self.take(seq, content):
            self.vote(classify(pa.array(packets, pa.binary()), linktype))

    def take(self, seq: int, content: bytes) -> Iterator[tuple[list[bytes], int]]:
        """The packets that a piece completes, with their link type; pieces come in any order, one that was there before changes nothing."""
        if seq >= self.next:
            self.early[seq] = content
        while self.next in self.early:
            packets, linktype = self._append(self.early.pop(self.next))
            self.next += 1
            if packets:
                yield packets, linktype

    def vote(self, found: np.ndarray) -> None:
        self.votes += np.bincount(found[found >= 0], minlength=len(self.votes))

    def _append(self, content: bytes) -> tuple[list[bytes], int]:
        if self.error:
            return [], 0
        buf = self.rest + content
        if len(self.head) < FILE_HEADER:
            self.head, buf = buf[:FILE_HEADER], buf[FILE_HEADER:]
            if len(self.head) < FILE_HEADER:
                self.rest, self.head = self.head, b""
                return [], 0
        try:
            header = classic_header(bytes(self.head))
        except CaptureError as e:
            self.error = str(e)
            self.rest = b""
            return [], 0
        caplen = struct.Struct(header.endian + "I").unpack_from
        packets, at = [], min(self.skip, len(buf))
        self.skip -= at
        while not self.skip and len(buf) - at >= RECORD_HEADER:
            size = caplen(buf, at + 8)[0]
            taken = min(size, self.mtu)
            if len(buf) - at - RECORD_HEADER < taken:
                break
            packets.append(buf[at + RECORD_HEADER:at + RECORD_HEADER + taken])
            at += RECORD_HEADER + size
            if at > len(buf):  # what lies beyond the MTU is still to come
                self.skip, at = at - len(buf), len(buf)
        self.rest = buf[at:]
        self.records += len(packets)
        return packets, header.linktype

    def row(self, path: str) -> tuple:
        """What is known so far; ties go to the smaller class, no vote to none."""
        n = int(self.votes.sum())
        return path, self.next - 1, self.records, n, int(self.votes.argmax()) if n else None, self.error


class _Scorer:
    """Packets of many captures, scored together."""

    def __init__(self, classify: Classify):
        self.classify, self.held, self.size = classify, {}, 0

    def add(self, follower: Follower, packets: list[bytes], linktype: int) -> None:
        self.held.setdefault(linktype, []).append((follower, packets))
        self.size += sum(map(len, packets))
        if self.size >= SCORED_BYTES:
            self.flush()

    def flush(self) -> None:
        for linktype, parts in self.held.items():
            found = self.classify(pa.array([p for _, packets in parts for p in packets], pa.binary()), linktype)
            at = 0
            for follower, packets in parts:
                follower.vote(found[at:at + len(packets)])
                at += len(packets)
        self.held, self.size = {}, 0


def follow_captures(pieces: DataFrame, classify: Classify, classes: int, mtu: int = MTU, keys: int = KEYS) -> DataFrame:
    """Streaming ``pieces`` to streaming labels: one row per capture that got a new piece, with its votes so far.

    ``keys``: how many keys the captures share, a fixed number for the life of a checkpoint; a new piece rewrites the state
    of the captures of its key, so take one for a few dozen captures.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pickle.loads(state.get[0]) if state.exists else {}
        followers, scorer = {}, _Scorer(classify)
        for f in frames:
            for path, seq, content in zip(f["path"].tolist(), f["seq"].tolist(), f["content"].tolist()):
                if path not in followers:
                    followers[path] = Follower(classes, known.get(path), mtu)
                for packets, linktype in followers[path].take(seq, bytes(content or b"")):
                    scorer.add(followers[path], packets, linktype)
        scorer.flush()
        known.update((path, f.state()) for path, f in followers.items())
        state.update((pickle.dumps(known),))
        out = pd.DataFrame([f.row(path) for path, f in followers.items()], columns=["path", "seq", "n_records", "n_packets", "prediction", "error"])
        yield out.astype({"prediction": "Int32", "error": "object"})

    keyed = pieces.withColumn("key", F.pmod(F.xxhash64("path"), F.lit(keys)))
    return keyed.groupBy("key").applyInPandasWithState(step, LABELS, STATE, "update", GroupStateTimeout.NoTimeout)


def piece_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The pieces that arrive as Parquet files in a folder."""
    return spark.readStream.schema(PIECES).option("maxFilesPerTrigger", max_files).parquet(folder)


def label_growing_captures(spark: SparkSession, folder: str, out: str, checkpoint: str, classify: Classify, classes: int, task: str,
                           available_now: bool = True, max_files: int = 1000, keys: int = KEYS):
    """Start the stream; each micro-batch writes the labels that changed to ``out/batch_id=<id>`` (a retried batch replaces its own)."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        label_name(batch, task, "prediction", "label").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = follow_captures(piece_stream(spark, folder, max_files), classify, classes, keys=keys).writeStream.outputMode("update").foreachBatch(per_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def newest_labels(labels: DataFrame) -> DataFrame:
    """The last label of each capture of a table of labels with ``batch_id``."""
    others = [c for c in labels.columns if c != "path"]
    return labels.groupBy("path").agg(F.max_by(F.struct(*others), "batch_id").alias("last")).select("path", *(F.col(f"last.{c}").alias(c) for c in others))
