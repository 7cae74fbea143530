from __future__ import annotations

import json

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidemark.config import DAY_MS, StoreConfig
from tidemark.errors import CorruptFrameError, InvalidError, NotFoundError, SerializationError
from tidemark.functions.metrics import BY_TABLE, GAUGES, HISTOGRAMS, PASSED_THROUGH, Metrics
from tidemark.functions.schemas import SchemaRegistry
from tidemark.operators.projection import check_types, is_identity, resolve
from tidemark.sources import frame_codec as codec

AB = T.StructType.fromDDL("a bigint not null, b int")


def batch(**columns):
    return pa.RecordBatch.from_pydict(columns)


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"db_path": "/x", "ttl_days": 7, "unknown": 1}))
    found = StoreConfig.load(str(path))
    assert (found.db_path, found.ttl_days, found.ttl_ms, found.block_cache_size_mb) == ("/x", 7, 7 * DAY_MS, 512)
    assert json.loads(found.to_json())["ttl_days"] == 7
    for bad in ("{", "[]", '{"db_path": 3}', '{"db_path": "/x", "ttl_days": true}', '{"db_path": "/x", "ttl_days": 99999999999999999999999}', '{"db_path": ""}', '{"db_path": "/x", "ttl_days": 0}', '{"db_path": "/x", "max_background_flushes": -1}'):
        path.write_text(bad)
        with pytest.raises(InvalidError):
            StoreConfig.load(str(path))
    with pytest.raises(OSError):
        StoreConfig.load(str(tmp_path / "none.json"))


def test_registry_versions():
    r = SchemaRegistry()
    r.register(1, 1, AB)
    r.register(1, 5, T.StructType.fromDDL("c string, b int, a bigint not null"))
    for version in (3, 5):
        with pytest.raises(InvalidError):
            r.register(1, version, AB)
    with pytest.raises(InvalidError):  # only the highest version counts: c is missing
        r.register(1, 6, AB)
    assert r.max_version(1) == 5 and r.get(1, 2) is None and r.max_version(2) is None
    r.unregister(1)
    r.register(1, 0, AB)
    for table, version, schema in ((1, 70000, AB), (-1, 1, AB), (3, 1, None), (3, 1, T.StructType.fromDDL("x int, X int")), (3, 1, T.StructType.fromDDL("uid int")), (3, 1, T.StructType.fromDDL("i interval day"))):
        with pytest.raises(InvalidError):
            r.register(table, version, schema)


@pytest.mark.parametrize("ddl", ["a bigint, b int", "a bigint not null, b bigint", "a bigint not null", "a bigint not null, b int, c string not null"])
def test_registry_rejects(ddl):
    r = SchemaRegistry()
    r.register(1, 1, AB)
    with pytest.raises(InvalidError):
        r.register(1, 2, T.StructType.fromDDL(ddl))
    assert r.get(1, 2) is None


def test_projection_plan():
    assert resolve(AB) == ["a", "b"]
    assert resolve(AB, ["b", "a", "b"]) == ["b", "a", "b"]
    assert is_identity(AB, []) and is_identity(AB, ["a", "b"]) and not is_identity(AB, ["b", "a"])
    with pytest.raises(NotFoundError, match="Column not found: A"):
        resolve(AB, ["A"])
    with pytest.raises(InvalidError):
        check_types(AB, T.StructType.fromDDL("b string"))


def test_checksum():
    assert codec.crc32c(b"123456789") == 0xE3069283
    assert codec.crc32c(b"") == 0


@given(st.binary(max_size=20_000))
def test_checksum_lanes(data):
    plain = 0xFFFFFFFF
    for byte in data:
        plain = codec._BYTEWISE[(plain ^ byte) & 255] ^ plain >> 8
    assert codec.crc32c(data) == plain ^ 0xFFFFFFFF


def test_codec_round_trip():
    rows = batch(id=[1, 2, 3], score=[10, 20, 30])
    data = codec.encode(rows, 7, 1712212123123)
    version, timestamp, back = codec.decode(data)
    assert (version, timestamp, back.to_pydict()) == (7, 1712212123123, rows.to_pydict())
    empty = codec.decode(codec.encode(rows.slice(0, 0), 11, 4000))
    assert empty[2].num_rows == 0 and empty[2].schema == rows.schema


def test_codec_errors():
    data = bytearray(codec.encode(batch(x=[1]), 1, 5))
    with pytest.raises(InvalidError):
        codec.decode(b"\0" + bytes(data[1:]))
    with pytest.raises(InvalidError):
        codec.decode(bytes(data[:10]))
    with pytest.raises(InvalidError):
        codec.decode(bytes(data) + b"x")
    long = bytes(data[:16]) + (1 << 31).to_bytes(4, "little") + bytes(data[20:])
    with pytest.raises(InvalidError):
        codec.header(long)
    data[-1] ^= 1
    assert not codec.checksum_holds(bytes(data))
    with pytest.raises(CorruptFrameError):
        codec.decode(bytes(data))
    with pytest.raises(SerializationError):
        codec.body(b"nothing")


def test_merge_drops_bad_frames_and_lost_tails():
    a, b, c = (codec.encode(batch(x=[i]), 1, 100 * i) for i in (1, 2, 3))
    bad = b[:-1] + bytes([b[-1] ^ 1])
    assert codec.merged(a + b, c) == a + b + c
    assert codec.merged(a + bad, c) == a + c
    assert codec.merged(a + b"junk" + b) == a
    assert codec.parses(a + bad) and not codec.parses(a + b"junk")
    assert [f.timestamp for f in codec.scan(a + b + c)] == [100, 200, 300]


@given(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1))
def test_keys(a, b):
    assert codec.key_number(codec.key_bytes(a)) == a
    assert (codec.key_bytes(a) < codec.key_bytes(b)) == (a < b)
    assert codec.key_number(b"123") == 0


def test_metrics_text():
    m = Metrics()
    m.add("feature_get_total", 3, 2)
    m.move("pinned_buffers", -5)
    m.observe("get_latency_us", 700)
    text = m.text()
    for name in (*(x[0] for x in BY_TABLE), *(x[0] for x in GAUGES), *(x[0] for x in HISTOGRAMS), *PASSED_THROUGH):
        assert name in text
    assert 'feature_get_total{table="3"} 2' in text and "pinned_buffers 0" in text
    assert 'get_latency_us_bucket{le="500"} 0' in text and 'get_latency_us_bucket{le="1000"} 1' in text
