"""The first flight of a TCP direction: its contiguous bytes, from segments in order of arrival.

Flows are folded as a stream: rows come partitioned by flow and sorted by arrival, a task holds the flow at hand alone,
and segments after a flow's cap or decision pass by without being kept. Whole streams have no cap: their rows come sorted
by number instead, and a task holds the segment at hand alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.schemas import FLIGHT_BYTES, FLIGHT_SEGMENTS

_WRAP = 1 << 32


@dataclass
class FirstFlight:
    """Contiguous bytes from a baseline: one past a SYN's number, or the number of the first segment seen."""

    max_bytes: int = FLIGHT_BYTES
    max_segments: int = FLIGHT_SEGMENTS
    baseline: int | None = None
    data: bytearray = field(default_factory=bytearray)
    #: Segments beyond a gap, by offset.
    ahead: dict[int, bytes] = field(default_factory=dict)
    segments: int = 0
    full: bool = False

    @property
    def started(self) -> bool:
        return self.baseline is not None

    def clear(self) -> None:
        """Forget the bytes and take no more; late segments still count from the same baseline."""
        self.data, self.ahead, self.full = bytearray(), {}, True

    def add(self, seq: int, syn: bool, payload: bytes | None) -> None:
        if self.full:
            return
        if self.baseline is None:
            self.baseline = (seq + syn) % _WRAP
            if syn:
                return
        if not payload:
            return
        at = (seq - self.baseline) % _WRAP
        if at >= self.max_bytes:  # beyond the cap, or before the baseline
            return
        payload = bytes(payload[: self.max_bytes - at])
        self.segments += 1
        if self.segments > self.max_segments:
            self.full = True
            return
        if at + len(payload) <= len(self.data):
            return
        if at <= len(self.data):
            self.data += payload[len(self.data) - at :]
            self._close_gaps()
        else:
            below = max((k for k in self.ahead if k <= at), default=None)
            if below is not None and below + len(self.ahead[below]) >= at + len(payload):
                return
            self.ahead[at] = payload
            self.full = len(self.ahead) > self.max_segments
        self.full = self.full or len(self.data) >= self.max_bytes or self.segments >= self.max_segments

    def _close_gaps(self) -> None:
        for at in sorted(self.ahead):
            if at > len(self.data) or len(self.data) >= self.max_bytes:
                return
            self.data += self.ahead.pop(at)[len(self.data) - at :]


def by_flow(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, dict]]:
    """(flow, row) of sorted batches, one row at a time."""
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for values in zip(*columns.values()):
            row = dict(zip(columns, values))
            yield tuple(row[c] for c in key), row


def reassemble(segments: DataFrame, max_bytes: int = FLIGHT_BYTES, max_segments: int = FLIGHT_SEGMENTS) -> DataFrame:
    """segments (flow_id, ord, seq, syn, data) -> a row for each flow: segments, contiguous, full, started."""
    schema = pa.schema([("flow_id", pa.string()), ("segments", pa.int32()), ("contiguous", pa.binary()), ("full", pa.bool_()), ("started", pa.bool_())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, flight, out = None, None, []
        for key, row in by_flow(batches, ["flow_id"]):
            if key != flow:
                if flight:
                    out.append((flow[0], flight.segments, bytes(flight.data), flight.full, flight.started))
                flow, flight = key, FirstFlight(max_bytes, max_segments)
            flight.add(row["seq"], row["syn"], row["data"])
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if flight:
            out.append((flow[0], flight.segments, bytes(flight.data), flight.full, flight.started))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ordered = _dealt_out(segments).sortWithinPartitions("flow_id", "ord")
    return ordered.mapInArrow(fold, "flow_id string, segments int, contiguous binary, full boolean, started boolean")


def whole_streams(segments: DataFrame) -> DataFrame:
    """segments (flow_id, ord, seq, syn, data) -> a row for each flow: bytes and MD5 of all its contiguous bytes, however many.

    Numbers count on beyond 2^32. The stream begins one past the SYN's number, or at the lowest number without a SYN. Where
    segments overlap, the one with the lower number gives the bytes, of equal numbers the earlier.
    """
    schema = pa.schema([("flow_id", pa.string()), ("bytes", pa.int64()), ("digest", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, base, size, digest, out = None, 0, 0, None, []
        for key, row in by_flow(batches, ["flow_id"]):
            if key != flow:
                if digest:
                    out.append((flow[0], size, digest.hexdigest()))
                flow, base, size, digest = key, row["seq"] + row["syn"], 0, hashlib.md5(usedforsecurity=False)
            if not row["syn"] and row["data"] and 0 <= row["seq"] - base <= size:
                new = memoryview(row["data"])[size - (row["seq"] - base) :]
                digest.update(new)
                size += len(new)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if digest:
            out.append((flow[0], size, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ordered = _dealt_out(segments).sortWithinPartitions("flow_id", F.desc("syn"), "seq", "ord")
    return ordered.mapInArrow(fold, "flow_id string, bytes long, digest string")


def _dealt_out(segments: DataFrame) -> DataFrame:
    # by a hash of the flow: a union whose parts are each dealt out by flow_id counts as dealt out by it, and when adaptive
    # execution joins small partitions of its parts apart, a flow's rows are not together
    return segments.select("flow_id", "ord", "seq", "syn", "data").repartition(F.xxhash64("flow_id"))


def parse_script(text: str) -> list[tuple[int, bool, bytes]]:
    """Segments of a script with lines `seq syn [hex]`; # begins a comment."""
    out = []
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if len(words) >= 2:
            digits = "".join(c for c in (words[2] if len(words) > 2 else "") if c in "0123456789abcdefABCDEF")
            out.append((int(words[0], 0), words[1] in ("1", "true"), bytes.fromhex(digits[: len(digits) // 2 * 2])))
    return out
