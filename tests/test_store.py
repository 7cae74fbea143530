from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import StoreConfig
from tidemark.errors import CapacityError, ConflictError, InvalidError, NotFoundError, SerializationError
from tidemark.operators import frames as ops
from tidemark.plans.store import Append, Request, VersionedStore
from tidemark.sources import frame_codec as codec
from tidemark.sources.frames import frame_schema, rows_of

A = T.StructType.fromDDL("a bigint")
AB = T.StructType.fromDDL("a bigint, b int")


@pytest.fixture
def rows(spark):
    return lambda *data, ddl="uid long, a long": spark.createDataFrame(list(data), ddl)


def values(frame):
    return [tuple(r) for r in frame.collect()]


def test_append_get_archive_order(store, rows, spark, tmp_path):
    store.register_schema(1, 1, A)
    store.append(1, 1, rows((10, 1)), now_ms=100)
    store.append(1, 1, rows((10, 2)), now_ms=200)
    assert values(store.get(1, 10, 1)) == [(2,)]
    path = str(tmp_path / "deep" / "out.parquet")
    store.archive_table(1, path)
    found = spark.read.parquet(path)
    assert found.columns == ["__uid", "__timestamp", "__schema_version", "a"]
    assert values(found) == [(10, 100, 1, 1), (10, 200, 1, 2)]
    with pytest.raises(NotFoundError, match="table not found"):
        store.get(1, 10, 1)


def test_put(store, rows):
    store.register_schema(1, 1, A)
    store.append(1, 1, rows((1, 1), (2, 5)), now_ms=200)
    store.put(1, 1, rows((1, 2)), timestamp_ms=50)
    assert values(store.get(1, 1, 1)) == [(2,)] and values(store.get(1, 2, 1)) == [(5,)]
    store.put(1, 1, rows((1, 3)), timestamp_ms=9000)
    store.append(1, 1, rows((1, 4)), now_ms=300)
    assert values(store.get(1, 1, 1)) == [(3,)]  # the time decides, not the arrival
    assert store.frames(1).where("uid = 1").count() == 2
    with pytest.raises(InvalidError):
        store.put(1, 1, rows((1, 3)))


def test_ties_and_order_in_a_commit(store, rows):
    store.register_schema(1, 1, A)
    store.append(1, 1, rows((1, 1)), now_ms=100)
    store.append(1, 1, rows((1, 2)), now_ms=100)
    assert values(store.get(1, 1, 1)) == [(2,)]
    store.append(1, 1, rows((1, 9), (1, 7), (1, 8)), now_ms=100, order_by=["a"])
    assert values(store.get(1, 1, 1)) == [(9,)]


def test_frames_of_many_rows_and_of_none(store, spark):
    store.register_schema(1, 1, A)
    nested = lambda *data: spark.createDataFrame(list(data), "uid long, payload array<struct<a: long>>")
    store.append(1, 1, nested((1, [(1,), (2,)]), (2, [(3,)])), now_ms=100)
    assert sorted(values(store.get(1, 1, 1))) == [(1,), (2,)]
    store.append(1, 1, nested((1, [])), now_ms=200)
    assert values(store.get(1, 1, 1)) == []
    found = store.batch_get([Request(1, 1, 1), Request(1, 2, 1)])
    assert [(r.status, r.n_rows) for r in found.status.collect()] == [("OK", 0), ("OK", 1)]
    assert store.archive_frame(1).count() == 3


def test_evolution(store, rows):
    store.register_schema(1, 1, A)
    store.register_schema(1, 2, AB)
    store.append(1, 1, rows((1, 7)), now_ms=1)
    store.append(1, 2, rows((2, 8, 9), ddl="uid long, a long, b int"), now_ms=1)
    assert values(store.get(1, 1, 2)) == [(7, None)]
    assert values(store.get(1, 1, 2, ["b"])) == [(None,)]
    assert values(store.get(1, 2, 2, ["b", "a", "b"])) == [(9, 8, 9)]
    assert values(store.get(1, 2, 1)) == [(8,)]
    assert sorted(values(store.latest(1, 2))) == [(1, 7, None), (2, 8, 9)]
    with pytest.raises(NotFoundError, match="Column not found"):
        store.get(1, 2, 1, ["b"])
    with pytest.raises(NotFoundError, match="schema not found"):
        store.get(1, 1, 3)
    with pytest.raises(NotFoundError):
        store.get(1, 99, 1)


def test_writes_are_checked(store, rows, spark):
    store.register_schema(1, 1, T.StructType.fromDDL("a bigint not null"))
    for bad, ddl in (((1, "x"), "uid long, a string"), ((1, 1, 2), "uid long, a long, z int"), ((1,), "uid long")):
        with pytest.raises(InvalidError):
            store.append(1, 1, rows(bad, ddl=ddl))
    for bad in ((1, None), (-1, 1), (None, 1)):
        with pytest.raises(Exception, match="must"):
            store.append(1, 1, rows(bad))
    assert store.frames(1).count() == 0
    with pytest.raises(NotFoundError):
        store.append(1, 2, rows((1, 1)))


def test_batch_append(store, rows):
    store.register_schema(1, 1, A)
    store.register_schema(2, 1, A)
    assert store.batch_append([]) is not None
    store.batch_append([Append(1, 1, rows((1, 1))), Append(2, 1, rows((1, 2))), Append(1, 1, rows((1, 3)))], now_ms=10)
    assert values(store.get(1, 1, 1)) == [(3,)] and values(store.get(2, 1, 1)) == [(2,)]
    assert sorted(r["__timestamp"] for r in store.frames(1).collect()) == [10, 12]
    for bad, error in ((Append(9, 1, rows((5, 1))), NotFoundError), (Append(1, 1, None), InvalidError)):
        with pytest.raises(error):
            store.batch_append([Append(1, 1, rows((5, 1))), bad])
    with pytest.raises(NotFoundError):
        store.get(1, 5, 1)


def test_batch_get(store, rows):
    store.register_schema(1, 1, A)
    store.append(1, 1, rows((1, 11), (2, 22)), now_ms=1)
    found = store.batch_get([Request(1, 1, 1), Request(1, 77, 1), Request(9, 1, 1), Request(1, 1, 1, ("zz",)), Request(1, 2, 1), Request(1, 1, 1), Request(1, 77, 5), Request(1, 2, 5)])
    assert [(r.req_idx, r.uid, r.status, r.message) for r in found.status.collect()] == [
        (0, 1, "OK", ""), (1, 77, "KeyError", "uid 77 not found"), (2, 1, "KeyError", "table not found"), (3, 1, "KeyError", "Column not found: zz"),
        (4, 2, "OK", ""), (5, 1, "OK", ""), (6, 77, "KeyError", "uid 77 not found"), (7, 2, "KeyError", "schema not found"),
    ]
    assert sorted(values(found.groups[1, 1, ()])) == [(0, 1, 11), (4, 2, 22), (5, 1, 11)]
    assert store.batch_get([]).status.count() == 0


def test_ttl_is_lazy_and_inclusive(store, rows):
    store.register_schema(1, 1, A)
    for uid, at in ((1, 900), (2, 899), (3, 5000)):
        store.append(1, 1, rows((uid, uid)), now_ms=at)
    assert values(store.get(1, 2, 1)) == [(2,)]
    store.compact_range(1, now_ms=1000, ttl_ms=100)
    assert sorted(r.uid for r in store.frames(1).collect()) == [1, 3]
    store.vacuum(older_than_ms=0)
    assert values(store.get(1, 1, 1)) == [(1,)]
    with pytest.raises(NotFoundError):
        store.compact_range(8)
    store.set_ttl(10)
    assert store.get_ttl() == 10
    store.compact_all(now_ms=5000)
    assert [r.uid for r in store.frames(1).collect()] == [3]


def test_compaction_keeps_versions_and_ranges(store, rows):
    store.register_schema(1, 1, A)
    store.register_schema(1, 2, AB)
    store.append(1, 2, rows((1, 1, 5), (4, 4, 5), ddl="uid long, a long, b int"), now_ms=1)
    store.append(1, 1, rows((1, 2), (2, 2)), now_ms=2)
    store.put(1, 1, rows((2, 3)), timestamp_ms=100)
    store.compact_range(1, uid_start=1, uid_end=2, now_ms=101, ttl_ms=99)
    assert sorted((r["uid"], r["__schema_version"], r["__timestamp"]) for r in store.frames(1).collect()) == [(1, 1, 2), (2, 1, 100), (4, 2, 1)]
    assert values(store.get(1, 4, 2)) == [(4, 5)]


def test_compaction_gives_files_ranges_of_their_own(store, spark):
    store.register_schema(1, 1, A)
    for step in range(3):
        store.append(1, 1, spark.range(step, 3000, 3).selectExpr("id as uid", "id as a").repartition(4), now_ms=step)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.compact_range(1, now_ms=10, ttl_ms=1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = store.frames(1).groupBy(F.input_file_name().alias("file")).agg(F.min("uid").alias("low"), F.max("uid").alias("high")).orderBy("low").collect()
    assert len(files) > 1 and all(a.high < b.low for a, b in zip(files, files[1:], strict=False))
    assert store.frames(1).count() == 3000 and values(store.get(1, 2999, 1)) == [(2999,)]


def test_batch_get_reads_once(store, rows):
    store.register_schema(1, 2, AB)
    store.append(1, 2, rows((1, 1, 2), ddl="uid long, a long, b int"))
    found = store.batch_get([Request(1, 1, 2, ("b",)), Request(1, 5, 2, ("b",))])
    plan = found.status._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by") == 1 and plan.count("parquet") == 1
    assert values(found.groups[1, 2, ("b",)]) == [(0, 1, 2)]


def test_invalid_frames(spark):
    frames = spark.createDataFrame([(1, 10, 1, "APPEND", 1, True, [(1,)]), (1, 20, 2, "APPEND", 1, False, [(2,)]), (2, 5, 3, "APPEND", 1, False, [(3,)])], frame_schema(A))
    assert values(rows_of(ops.latest(frames), ["a"])) == [(1, 1)]
    kept = ops.compacted(frames, 1000, 1)
    assert [(r["uid"], r["__ok"]) for r in kept.collect()] == [(2, False)]  # no valid frame: untouched


def test_life_cycle(spark, rows, tmp_path):
    store = VersionedStore(spark, StoreConfig(str(tmp_path / "db"), max_column_families=1))
    store.close()
    with pytest.raises(InvalidError, match="not ready"):
        store.get(1, 1, 1)
    store.init()
    store.register_schema(1, 1, A)
    with pytest.raises(CapacityError):
        store.register_schema(2, 1, A)
    with pytest.raises(InvalidError):
        store.register_schema(1, 2, T.StructType.fromDDL("b int"))
    store.append(1, 1, rows((1, 1)))
    orphan = tmp_path / "db" / "tables" / "t_0007" / "g0"
    orphan.mkdir(parents=True)
    store.close()
    with pytest.raises(InvalidError):
        store.flush_all()
    again = VersionedStore(spark, str(tmp_path / "db")).init()
    assert values(again.get(1, 1, 1)) == [(1,)] and not orphan.exists()
    with pytest.raises(NotFoundError):  # a rejected version wasn't kept
        again.get(1, 1, 2)
    again.drop_table(1)
    again.register_schema(1, 1, A)
    assert again.frames(1).count() == 0
    with pytest.raises(InvalidError, match="db_path"):
        VersionedStore(spark, "").init()


def test_concurrent_appends(store, rows):
    store.register_schema(1, 1, A)
    with ThreadPoolExecutor(4) as pool:
        commits = list(pool.map(lambda i: store.append(1, 1, rows((i, i)), now_ms=i), range(8)))
    assert len(set(commits)) == 8 and store.frames(1).count() == 8


def test_overlapping_compactions_publish_once(store, rows, monkeypatch):
    store.register_schema(1, 1, A)
    for at in (10, 20):
        store.append(1, 1, rows((1, at), (2, at)), now_ms=at)
    stale, newest = store.snapshot(), type(store).snapshot
    store.compact_range(1, now_ms=30, ttl_ms=1000, force_bottommost=True)
    store.append(1, 1, rows((3, 3)), now_ms=40)
    answers = [stale]
    monkeypatch.setattr(type(store), "snapshot", lambda self: answers.pop() if answers else newest(self))
    with pytest.raises(ConflictError):
        store.compact_range(1, now_ms=30, ttl_ms=1000, force_bottommost=True)
    assert sorted((r.uid, r["__timestamp"]) for r in store.frames(1).collect()) == [(1, 10), (1, 20), (2, 10), (2, 20), (3, 40)]
    answers.append(stale)
    store.vacuum()
    assert store.frames(1).count() == 5


def test_changes_from_a_stale_state(store, monkeypatch):
    stale, newest = store.snapshot(), type(store).snapshot
    store.register_schema(1, 1, A)
    answers = [stale]
    monkeypatch.setattr(type(store), "snapshot", lambda self: answers.pop() if answers else newest(self))
    with pytest.raises(InvalidError):
        store.register_schema(1, 1, AB)  # seemed to be free
    assert store.snapshot().registry.get(1, 1) == A
    answers.append(newest(store))
    store.drop_table(1)
    with pytest.raises(NotFoundError):
        store.drop_table(1)


def test_concurrent_registration(store):
    def attempt(version: int) -> bool:
        try:
            store.register_schema(1, version, T.StructType.fromDDL("a long"))
        except InvalidError:
            return False
        return True

    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(attempt, [1] * 6)) == 1


def test_a_batch_is_appended_once(store, rows):
    store.register_schema(1, 1, A)
    for number in (0, 1, 1, 0):
        store.append(1, 1, rows((number, 5)), now_ms=number, batch=("here", number))
    store.append(1, 1, rows((9, 5)), now_ms=9, batch=("there", 0))
    assert sorted(r.uid for r in store.frames(1).collect()) == [0, 1, 9]


def test_import_and_export_of_bytes(spark):
    one = lambda x, version, at: codec.encode(pa.RecordBatch.from_pydict({"a": pa.array([x], pa.int64())}), version, at)
    bad = one(3, 1, 30)
    value = one(1, 1, 10) + one(2, 1, 20) + bad[:-1] + bytes([bad[-1] ^ 1])
    frames = codec.import_values(spark.createDataFrame([(codec.key_bytes(5), value), (codec.key_bytes(6), None)], "key binary, value binary"), AB)
    assert [(r["uid"], r["__seq"], r["__ok"]) for r in frames.collect()] == [(5, 0, True), (5, 1, True), (5, 2, False)]
    assert values(rows_of(ops.latest(frames), ["a", "b"])) == [(5, 2, None)]
    out = codec.export_frames(ops.latest(frames), AB).collect()
    assert codec.decode(bytes(out[0]["frame"]))[2].to_pydict() == {"a": [2], "b": [None]}


def test_no_valid_frame(store, spark):
    store.register_schema(1, 1, A)
    frames = spark.createDataFrame([(1, 10, 1, "APPEND", 1, False, [(1,)])], frame_schema(A))
    path = f"{store.root}/tables/t_0001/g0/c9"
    frames.write.parquet(path)
    store.log.publish(store.log.claim(), [{"kind": "add", "table": 1, "generation": 0, "path": "tables/t_0001/g0/c9", "version": 1, "min_uid": 1, "max_uid": 1, "n": 1, "has_put": False}])
    with pytest.raises(SerializationError):
        store.get(1, 1, 1)
    assert [r.status for r in store.batch_get([Request(1, 1, 1)]).status.collect()] == ["SerializationError"]


def test_plans(spark, store, rows):
    store.register_schema(1, 1, A)
    store.register_schema(1, 2, AB)
    store.append(1, 2, rows((1, 1, 2), ddl="uid long, a long, b int"))
    plan = rows_of(store.frames(1, 2).where("uid = 1"), ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(uid,1)" in plan
    scanned = rows_of(store.frames(1, 2), ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "payload:array<struct<b:int>>" in scanned and "a:bigint" not in scanned
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    latest = store.latest(1, 2, ["b"])
    scanned = latest._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "payload:array<struct<b:int>>" in scanned and "a:bigint" not in scanned and values(latest) == [(1, 2)]
