"""Frames as bytes: reading and writing values of an embedded store.

A value is frames one after the other.  A frame is a header (magic number,
schema version, two bytes unused, timestamp in ms, length of the body), the
body (an Arrow stream of exactly one record batch) and a CRC-32C over both, all
little-endian.  Frames with a wrong checksum are passed over; where a header
can't be read the rest of the value is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.errors import CorruptFrameError, InvalidError, SerializationError
from tidemark.sources.frames import frame_schema

# The format's magic number, its header, and the polynomial of CRC-32C, bits reversed.
MAGIC = 0x41524F57
HEADER = struct.Struct("<IHHqI")
HEADER_SIZE, CHECKSUM_SIZE = HEADER.size, 4
POLYNOMIAL = 0x82F63B78


def _table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = np.array(_table(), np.uint32)
_BYTEWISE = _TABLE.tolist()


def _zeros_operator(n: int) -> list[int]:
    """What ``n`` zero bytes do to each bit of a CRC register."""
    columns = [1 << i for i in range(32)]
    step = [_BYTEWISE[c & 255] ^ c >> 8 for c in columns]  # one byte
    out = columns
    while n:
        if n & 1:
            out = [_apply(step, c) for c in out]
        step = [_apply(step, c) for c in step]
        n >>= 1
    return out


def _apply(operator: list[int], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= operator[low.bit_length() - 1]
        value ^= low
    return out


def crc32c(data: bytes) -> int:
    """CRC-32C.  Long inputs run as many lanes of equal length at once, which are then joined."""
    crc, lanes = 0xFFFFFFFF, 64
    length = len(data) // lanes
    if length >= 64:
        view = np.frombuffer(data, np.uint8, lanes * length).reshape(lanes, length)
        state = np.zeros(lanes, np.uint32)
        state[0] = crc
        for k in range(length):
            state = _TABLE[(state ^ view[:, k]) & np.uint32(255)] ^ state >> np.uint32(8)
        shift, crc = _zeros_operator(length), 0
        for s in state.tolist():
            crc = _apply(shift, crc) ^ s
        data = data[lanes * length :]
    for byte in data:
        crc = _BYTEWISE[(crc ^ byte) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


@dataclass(frozen=True)
class Frame:
    """A frame inside a value: where it is, what its header says, and whether its checksum holds."""

    start: int
    size: int
    version: int
    timestamp: int
    ok: bool


def encode(batch: pa.RecordBatch, version: int, timestamp: int) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    body = sink.getvalue().to_pybytes()
    if len(body) > 0xFFFFFFFF:
        raise InvalidError("a frame's body must be shorter than 4 GB")
    whole = HEADER.pack(MAGIC, version, 0, timestamp, len(body)) + body
    return whole + struct.pack("<I", crc32c(whole))


def header(data: bytes, start: int = 0) -> tuple[int, int, int]:
    """Version, timestamp and size of the frame at ``start``."""
    if len(data) - start < HEADER.size:
        raise InvalidError("too short for a frame's header")
    magic, version, _, timestamp, length = HEADER.unpack_from(data, start)
    if magic != MAGIC:
        raise InvalidError("not a frame: wrong magic number")
    size = HEADER.size + length + 4
    if size > len(data) - start:
        raise InvalidError("a frame's body is longer than its value")
    return version, timestamp, size


def checksum_holds(data: bytes) -> bool:
    """Whether ``data`` is one whole frame with a right checksum."""
    try:
        return header(data)[2] == len(data) and crc32c(data[:-4]) == int.from_bytes(data[-4:], "little")
    except InvalidError:
        return False


def body(data: bytes) -> pa.RecordBatch:
    """The record batch of a frame's Arrow stream; there must be exactly one."""
    try:
        batches = list(pa.ipc.open_stream(data))
    except pa.ArrowInvalid as e:
        raise SerializationError(str(e)) from e
    if len(batches) != 1:
        raise SerializationError(f"a frame holds {len(batches)} record batches")
    return batches[0]


def decode(data: bytes) -> tuple[int, int, pa.RecordBatch]:
    """Version, timestamp and rows of one frame."""
    version, timestamp, size = header(data)
    if size != len(data):
        raise InvalidError("more than one frame")
    if not checksum_holds(data):
        raise CorruptFrameError("CRC32 mismatch")
    return version, timestamp, body(data[HEADER.size : -4])


def scan(value: bytes) -> Iterator[Frame]:
    """The frames of a value, in order, up to the first header that can't be read."""
    start = 0
    while start < len(value):
        try:
            version, timestamp, size = header(value, start)
        except InvalidError:
            return
        yield Frame(start, size, version, timestamp, checksum_holds(value[start : start + size]))
        start += size


def parses(value: bytes) -> bool:
    """Whether headers lead through the whole value."""
    end = 0
    for f in scan(value):
        end = f.start + f.size
    return end == len(value)


def merged(*values: bytes) -> bytes:
    """Values one after the other, without frames whose checksum is wrong and what follows an unreadable header."""
    return b"".join(v[f.start : f.start + f.size] for v in values for f in scan(v) if f.ok)


def key_bytes(uid: int) -> bytes:
    """Eight bytes, the highest first: their order is the numbers' order."""
    return uid.to_bytes(8, "big")


def key_number(data: bytes) -> int:
    """Back from ``key_bytes``; 0 for any other length."""
    return int.from_bytes(data, "big") if len(data) == 8 else 0


def import_values(values: DataFrame, fields: T.StructType, key: str = "key", value: str = "value") -> DataFrame:
    """Frames from rows of key bytes and value bytes; rows of the payload as ``fields``, by name.

    Frames with a wrong checksum come with ``__ok`` false and no rows.  The
    place in the value is the order of arrival.
    """
    schema = frame_schema(fields)
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for raw, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for place, f in enumerate(scan(data or b"")):
                    found = []
                    if f.ok:
                        table = body(data[f.start + HEADER_SIZE : f.start + f.size - CHECKSUM_SIZE])
                        found = [{n: r.get(n) for n in names} for r in table.to_pylist()]
                    rows.append({"uid": key_number(raw), "__timestamp": f.timestamp, "__seq": place, "__op": "APPEND", "__schema_version": f.version, "__ok": f.ok, "payload": found})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return values.select(key, value).mapInArrow(run, schema)


def export_frames(frames: DataFrame, fields: T.StructType) -> DataFrame:
    """uid, __seq and ``frame``: each frame's bytes.  The payload is written in the registered fields' types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            frames_ = [encode(pa.RecordBatch.from_pylist(r["payload"], arrow), r["__schema_version"], r["__timestamp"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["uid"] for r in rows], pa.int64()), pa.array([r["__seq"] for r in rows], pa.int64()), pa.array(frames_, pa.binary())], names=["uid", "__seq", "frame"])

    return frames.select("uid", "__seq", "__schema_version", "__timestamp", "payload").mapInArrow(run, "uid long, `__seq` long, frame binary")
