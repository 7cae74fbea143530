"""The library's queries and the SQL that they are held against.

Frames come from ``events``: an event is a frame of its user, versions 1 and 2
alternate, version 2 adds ``props``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import StoreError
from tidemark.functions.metrics import histogram_frame
from tidemark.functions.schemas import SchemaRegistry
from tidemark.operators import frames as ops
from tidemark.operators.projection import align, project, resolve
from tidemark.plans.store import Append, VersionedStore, archived
from tidemark.sources.frame_codec import export_frames, import_values
from tidemark.sources.frames import one_row_frames, rows_of
from tidemark.streaming.sinks import append_sink

Query = Callable[[SparkSession, str], DataFrame]

V1 = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
V2 = T.StructType([*V1.fields, T.StructField("props", T.StringType())])
#: The time that retention queries take for now: 2024-01-31T00:00Z.
NOW_MS, DAY_MS = 1_706_659_200_000, 86_400_000
TTL_MS = 3 * DAY_MS

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(read(spark, sf_dir, "events"))


def as_events(rows: DataFrame) -> DataFrame:
    """Events with ts_ms, seq, ver, and props that only version 2 has."""
    ts_ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    ver = (1 + F.col("event_id") % 2).cast("int")
    return rows.select(
        F.col("user_id").alias("uid"), ts_ms.cast("long").alias("ts_ms"), F.col("event_id").alias("seq"), ver.alias("ver"), "event_type", "value", F.when(ver == 2, F.col("props")).alias("props"), "ts"
    )


def frames(spark: SparkSession, sf_dir: str, *, timestamp=None, op=None, ok=None) -> DataFrame:
    """Canonical frames, one for each event."""
    return one_row_frames(events(spark, sf_dir), V2.names, uid=F.col("uid"), timestamp=timestamp if timestamp is not None else F.col("ts_ms"), seq=F.col("seq"), version=F.col("ver"), op=op, ok=ok)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name in the folder that all executors share; where it is unset, a local one, which only a local session may use."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir must name a shared folder")
        shared = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def store_at(spark: SparkSession) -> VersionedStore:
    return VersionedStore(spark, new_folder(spark, "store")).init()


def place(frames: DataFrame) -> DataFrame:
    """uid, seq, ts_ms of a store's frames; seq is the place that the event had in its commit."""
    return frames.select("uid", F.col("__seq").bitwiseAND((1 << 32) - 1).alias("seq"), F.col("__timestamp").alias("ts_ms"))


def loaded(spark: SparkSession, sf_dir: str) -> VersionedStore:
    """A store whose table 1 holds all events, version 1 and 2 in files of their own."""
    store = store_at(spark)
    store.register_schema(1, 1, V1)
    store.register_schema(1, 2, V2)
    rows = events(spark, sf_dir).withColumn("__timestamp", F.col("ts_ms")).withColumn("__place", F.col("seq"))
    store.append(1, 1, rows.where("ver = 1").select("uid", "__timestamp", "__place", *V1.names))
    store.append(1, 2, rows.where("ver = 2").select("uid", "__timestamp", "__place", *V2.names))
    return store


# In SQL: the canonical frames.
_F = "(SELECT user_id AS uid, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, CAST(1 + event_id % 2 AS INTEGER) AS ver, event_type, value, CASE WHEN event_id % 2 = 1 THEN props END AS props, ts FROM events)"
_LATEST = "QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts_ms DESC, seq DESC) = 1"


@query(f"SELECT uid, event_type, value, props FROM {_F} WHERE uid = 3 {_LATEST}")
def q_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest frame of one entity; the key reaches the scan as a filter."""
    return rows_of(ops.latest(frames(spark, sf_dir).where("uid = 3")), V2.names)


@query(f"SELECT uid, ts_ms, seq, ver, event_type, value, props FROM {_F} {_LATEST}")
def q_latest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest frame of every entity."""
    found = rows_of(ops.latest(frames(spark, sf_dir)), V2.names, ("uid", "__timestamp", "__seq", "__schema_version"))
    return found.withColumnsRenamed({"__timestamp": "ts_ms", "__seq": "seq", "__schema_version": "ver"})


@query(f"SELECT uid, event_type, value, props FROM {_F} {_LATEST}")
def q_latest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the store: registered, appended, read back."""
    return loaded(spark, sf_dir).latest(1, 2)


@query(f"SELECT uid, CAST(day_ms AS BIGINT) AS day_ms, seq, event_type, value FROM (SELECT *, ts_ms - ts_ms % {DAY_MS} AS day_ms FROM {_F}) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY day_ms DESC, seq DESC) = 1")
def q_latest_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of frames with one timestamp the one that came last wins."""
    day = F.col("ts_ms") - F.col("ts_ms") % DAY_MS
    found = rows_of(ops.latest(frames(spark, sf_dir, timestamp=day)), V1.names, ("uid", "__timestamp", "__seq"))
    return found.withColumnsRenamed({"__timestamp": "day_ms", "__seq": "seq"})


@query(f"SELECT uid, CAST(day_ms AS BIGINT) AS day_ms, seq, event_type, value FROM (SELECT *, ts_ms - ts_ms % {DAY_MS} AS day_ms FROM {_F}) QUALIFY rank() OVER (PARTITION BY uid ORDER BY day_ms DESC) = 1")
def q_latest_multirow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of many rows (an entity's day): all rows of the latest frame."""
    rows = events(spark, sf_dir).withColumn("day_ms", F.col("ts_ms") - F.col("ts_ms") % DAY_MS)
    grouped = rows.groupBy("uid", "day_ms").agg(F.sort_array(F.collect_list(F.struct("seq", *V1.names))).alias("payload"), F.max("seq").alias("__seq"))
    whole = grouped.select("uid", F.col("day_ms").alias("__timestamp"), "__seq", F.lit(True).alias("__ok"), "payload")
    return rows_of(ops.latest(whole), ["seq", *V1.names], ("uid", "__timestamp")).withColumnRenamed("__timestamp", "day_ms")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC) = 1")
def q_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows: all lines of an order with its last ship date."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return ops.latest_rows(lines, "l_orderkey", F.col("l_shipdate"))


@query(f"SELECT uid, seq, event_type, value FROM {_F} WHERE seq % 7 <> 0 {_LATEST}")
def q_latest_skip_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a wrong checksum are passed over."""
    found = ops.latest(frames(spark, sf_dir, ok=F.col("seq") % 7 != 0))
    return rows_of(found, V1.names, ("uid", "__seq")).withColumnRenamed("__seq", "seq")


@query(f"SELECT uid, value, event_type FROM {_F} {_LATEST}")
def q_project_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns in an order of the caller's."""
    return rows_of(ops.latest(frames(spark, sf_dir)), resolve(V2, ["value", "event_type"]))


@query(f"SELECT value, uid FROM {_F}")
def q_project_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-alone projection of rows."""
    return project(events(spark, sf_dir), ["value", "uid"])


@query(f"SELECT uid, props FROM {_F} {_LATEST}")
def q_project_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a column that old frames lack: nulls, one for each of their rows."""
    return loaded(spark, sf_dir).latest(1, 2, ["props"])


@query(f"SELECT uid, event_type, value FROM {_F} {_LATEST}")
def q_project_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of version 2 read as version 1."""
    return loaded(spark, sf_dir).latest(1, 1)


@query(f"SELECT ver, CAST(count(*) AS BIGINT) AS n, CAST(count(props) AS BIGINT) AS n_props FROM {_F} GROUP BY ver")
def q_evolve_nullfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of both versions read as version 2."""
    rows = rows_of(loaded(spark, sf_dir).frames(1, 2), ["props"], ("__schema_version",))
    return rows.groupBy(F.col("__schema_version").alias("ver")).agg(F.count("*").alias("n"), F.count("props").alias("n_props"))


@query(f"SELECT uid, event_type, value, CAST(NULL AS VARCHAR) AS props FROM {_F} WHERE ver = 1")
def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of version 1 in version 2's columns."""
    return align(events(spark, sf_dir).where("ver = 1").select("uid", *V1.names), V2, ("uid",))


_PUT = f"(SELECT *, max(CASE WHEN event_type = 'signup' THEN seq END) OVER (PARTITION BY uid) AS put FROM {_F})"


def put_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir, op=F.when(F.col("event_type") == "signup", "PUT").otherwise("APPEND"))


@query(f"SELECT uid, seq, ts_ms FROM {_PUT} WHERE put IS NULL OR seq >= put")
def q_put_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that no later PUT has replaced."""
    return ops.visible(put_frames(spark, sf_dir)).select("uid", F.col("__seq").alias("seq"), F.col("__timestamp").alias("ts_ms"))


@query(f"SELECT uid, seq, event_type, value FROM {_PUT} WHERE put IS NULL OR seq >= put {_LATEST}")
def q_latest_after_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of the visible frames."""
    return rows_of(ops.latest(ops.visible(put_frames(spark, sf_dir))), V1.names, ("uid", "__seq")).withColumnRenamed("__seq", "seq")


@query(
    f"WITH l AS (SELECT uid, event_type, value FROM {_F} {_LATEST}) SELECT c_custkey AS uid, CASE WHEN l.uid IS NULL THEN 'KeyError' ELSE 'OK' END AS status, event_type, value FROM customer LEFT JOIN l ON l.uid = c_custkey"
)
def q_batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest frame, or that there is none, through the store."""
    store = loaded(spark, sf_dir)
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_idx"), F.lit(1).alias("table_id"), F.col("c_custkey").alias("uid"), F.lit(2).alias("version"), F.array(F.lit("event_type"), F.lit("value")).alias("columns"))
    found = store.batch_get_frame(keys)
    rows = found.groups[1, 2, ("event_type", "value")].drop("uid")
    return found.status.select("req_idx", "uid", "status").join(rows, "req_idx", "left").select("uid", "status", "event_type", "value")


@query(
    f"""WITH e AS (SELECT uid, value FROM {_F} {_LATEST}),
o AS (SELECT o_custkey AS uid, o_totalprice AS total FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
r AS (SELECT c_custkey AS uid FROM customer)
SELECT 2 * r.uid AS req_idx, r.uid, 1 AS table_id, CASE WHEN e.uid IS NULL THEN 'KeyError' ELSE 'OK' END AS status, value AS number FROM r LEFT JOIN e USING (uid)
UNION ALL SELECT 2 * r.uid + 1, r.uid, 2, CASE WHEN o.uid IS NULL THEN 'KeyError' ELSE 'OK' END, total FROM r LEFT JOIN o USING (uid)
UNION ALL SELECT -1, 1, 9, 'KeyError', NULL UNION ALL SELECT -2, 3, 1, 'KeyError', NULL"""
)
def q_batch_get_multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to two tables, to a table that isn't there, and for a column that isn't there."""
    store = loaded(spark, sf_dir)
    store.register_schema(2, 1, T.StructType([T.StructField("total", T.DoubleType())]))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("__timestamp"), F.col("o_totalprice").alias("total"), F.lit(0).alias("__place"))
    store.append(2, 1, orders)
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"))
    ask = lambda k, table, version, column: keys.select((2 * F.col("uid") + k).alias("req_idx"), F.lit(table).alias("table_id"), "uid", F.lit(version).alias("version"), F.array(F.lit(column)).alias("columns"))
    odd = spark.createDataFrame([(-1, 9, 1, 1, ["value"]), (-2, 1, 3, 2, ["nothing"])], "req_idx long, table_id int, uid long, version int, columns array<string>")
    requests = ask(0, 1, 2, "value").unionByName(ask(1, 2, 1, "total")).unionByName(odd)
    found = store.batch_get_frame(requests)
    numbers = [g.select("req_idx", F.col(c[0]).alias("number")) for (_, _, c), g in found.groups.items()]
    rows = numbers[0].unionByName(numbers[1])
    return requests.select("req_idx", "table_id").join(found.status.drop("n_rows", "message"), "req_idx").join(rows, "req_idx", "left").select("req_idx", "uid", "table_id", "status", "number")


@query("SELECT * FROM (VALUES (CAST(7 AS BIGINT), 'third'), (8, 'only')) AS t(uid, name)")
def q_batch_append_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one batch: a later item wins over an earlier one."""
    store = store_at(spark)
    store.register_schema(1, 1, T.StructType([T.StructField("name", T.StringType())]))
    one = lambda uid, name: Append(1, 1, spark.createDataFrame([(uid, name)], "uid long, name string"))
    store.batch_append([one(7, "first"), one(8, "only"), one(7, "second"), one(7, "third")], now_ms=1000)
    return store.latest(1, 1)


@query("SELECT 'KeyError' AS status, CAST(0 AS BIGINT) AS n")
def q_batch_append_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with one item for an unknown table stores nothing."""
    store = store_at(spark)
    store.register_schema(1, 1, V1)
    rows = spark.createDataFrame([(1, "a", 1.0)], "uid long, event_type string, value double")
    status = "OK"
    try:
        store.batch_append([Append(1, 1, rows), Append(9, 1, rows)])
    except StoreError as e:
        status = e.code
    return store.frames(1).agg(F.lit(status).alias("status"), F.count("*").alias("n"))


@query(f"SELECT uid, seq, ts_ms FROM {_F} WHERE {NOW_MS} - ts_ms <= {TTL_MS}")
def q_ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that compaction keeps."""
    found = ops.compacted(frames(spark, sf_dir), NOW_MS, TTL_MS)
    return found.select("uid", F.col("__seq").alias("seq"), F.col("__timestamp").alias("ts_ms"))


@query(f"SELECT uid, CAST(count(*) AS BIGINT) AS n_frames, CAST(count(*) FILTER (WHERE {NOW_MS} - ts_ms <= {TTL_MS}) AS BIGINT) AS n_live FROM {_F} GROUP BY uid HAVING n_live > 0 AND n_live < n_frames")
def q_ttl_partial_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that lose some of their frames, not all."""
    return ops.frame_counts(frames(spark, sf_dir), NOW_MS, TTL_MS).where("n_live > 0 and n_live < n_frames")


@query(f"SELECT uid, max(ts_ms) AS last_ts FROM {_F} GROUP BY uid HAVING {NOW_MS} - max(ts_ms) > {DAY_MS // 2}")
def q_ttl_dead_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that compaction leaves without a frame, at a time to live of 12 hours."""
    return ops.dead_keys(frames(spark, sf_dir), NOW_MS, DAY_MS // 2)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(900 AS BIGINT)), (3, 5000)) AS t(uid, ts_ms)")
def q_ttl_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An age of exactly the time to live stays, one more goes, times to come stay; compacted in the store."""
    store = store_at(spark)
    store.register_schema(1, 1, V1)
    store.append(1, 1, spark.createDataFrame([(1, 900, "a", 1.0), (2, 899, "b", 2.0), (3, 5000, "c", 3.0)], "uid long, `__timestamp` long, event_type string, value double"))
    store.compact_range(1, now_ms=1000, ttl_ms=100)
    return store.frames(1).select("uid", F.col("__timestamp").alias("ts_ms"))


@query(f"SELECT uid, seq, ts_ms FROM {_F} WHERE NOT (uid BETWEEN 3 AND 9) OR {NOW_MS} - ts_ms <= {TTL_MS}")
def q_compact_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction of entities 3 to 9 only."""
    found = ops.compacted(frames(spark, sf_dir), NOW_MS, TTL_MS, 3, 9)
    return found.select("uid", F.col("__seq").alias("seq"), F.col("__timestamp").alias("ts_ms"))


@query(f"SELECT uid, CAST(count(*) AS BIGINT) AS n FROM {_F} WHERE {NOW_MS} - ts_ms <= {TTL_MS} GROUP BY uid")
def q_compact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a compaction of all tables."""
    store = loaded(spark, sf_dir)
    store.set_ttl(TTL_MS)
    store.compact_all(now_ms=NOW_MS)
    return store.frames(1).groupBy("uid").agg(F.count("*").alias("n"))


@query(f'SELECT uid AS "__uid", ts_ms AS "__timestamp", ver AS "__schema_version", event_type, value, props FROM {_F}')
def q_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every frame, in the latest version's columns, with its frame's key, time and version."""
    return archived(frames(spark, sf_dir), V2)


@query(f'SELECT uid AS "__uid", ts_ms AS "__timestamp", ver AS "__schema_version", event_type, value, props FROM {_F}')
def q_archive_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's archive file, read back."""
    store = loaded(spark, sf_dir)
    path = f"{store.root}-archive/events.parquet"
    store.archive_table(1, path)
    return spark.read.parquet(path)


@query("SELECT CAST(2 AS BIGINT) AS uid, 'new' AS event_type, CAST(2 AS DOUBLE) AS value")
def q_drop_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table dropped and made again holds new rows only, also after a restart."""
    store = store_at(spark)
    row = lambda uid, kind: spark.createDataFrame([(uid, kind, float(uid))], "uid long, event_type string, value double")
    store.register_schema(1, 1, V1)
    store.append(1, 1, row(1, "old"))
    store.drop_table(1)
    store.register_schema(1, 1, V1)
    store.append(1, 1, row(2, "new"))
    store.close()
    return VersionedStore(spark, store.root).init().latest(1, 1)


_CASES = (
    ("same", "a bigint not null, b int", "OK"), ("added", "a bigint not null, b int, c string", "OK"), ("reordered", "b int, a bigint not null", "OK"), ("added not null", "a bigint not null, b int, c string not null", "Invalid"),
    ("retyped", "a bigint not null, b bigint", "Invalid"), ("nullable now", "a bigint, b int", "Invalid"), ("dropped", "a bigint not null", "Invalid"), ("lower version", "a bigint not null, b int", "Invalid"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{status}')" for name, _, status in _CASES) + ") AS t(change, status)")
def q_superset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which schemas may follow (a bigint not null, b int)."""
    out = []
    for name, ddl, _ in _CASES:
        registry = SchemaRegistry()
        registry.register(1, 4, T.StructType.fromDDL(_CASES[0][1]))
        try:
            registry.register(1, 2 if name == "lower version" else 7, T.StructType.fromDDL(ddl))
            out.append((name, "OK"))
        except StoreError as e:
            out.append((name, e.code))
    return spark.createDataFrame(out, "change string, status string")


@query("SELECT * FROM (VALUES (1, 2), (2, 5)) AS t(table_id, max_version)")
def q_max_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest registered version of each table, recovered from the log."""
    store = store_at(spark)
    for table, version in ((1, 1), (1, 2), (2, 5)):
        store.register_schema(table, version, V1)
    return VersionedStore(spark, store.root).init().schemas().groupBy("table_id").agg(F.max("version").alias("max_version"))


@query(f"SELECT uid, seq FROM {_F} WHERE uid BETWEEN 5 AND 12 ORDER BY uid, seq")
def q_key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a range of entities in the order of a scan."""
    found = frames(spark, sf_dir).where("uid between 5 and 12")
    return ops.ordered_by_key(found).select("uid", F.col("__seq").alias("seq"))


@query("SELECT le, CAST(n AS BIGINT) AS n FROM (SELECT unnest([1.0::DOUBLE, 10, 100, 1000]) AS le, unnest([sum((value <= 1)::INT), sum((value <= 10)::INT), sum((value <= 100)::INT), sum((value <= 1000)::INT)]) AS n FROM events)")
def q_metrics_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets over a column."""
    return histogram_frame(read(spark, sf_dir, "events"), "value", (1, 10, 100, 1000))


@query(f"SELECT uid, list(seq ORDER BY seq) AS seqs FROM {_F} GROUP BY uid")
def q_ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity's frames as one ordered list, as merging makes it."""
    return frames(spark, sf_dir).groupBy("uid").agg(F.sort_array(F.collect_list("__seq")).alias("seqs"))


@query("SELECT vec_id AS uid, label, len(embedding) AS dims, embedding[1] AS first FROM embeddings")
def q_nested_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold arrays, stored and read back."""
    store = store_at(spark)
    store.register_schema(1, 1, T.StructType([T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    vectors = read(spark, sf_dir, "embeddings")
    store.append(1, 1, vectors.select(F.col("vec_id").alias("uid"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit(0).alias("__place")), now_ms=0)
    return store.latest(1, 1).select("uid", "label", F.size("embedding").cast("long").alias("dims"), F.col("embedding")[0].alias("first"))


@query(f"SELECT o_orderkey, r.uid, seq, value FROM (SELECT o_orderkey, o_custkey AS uid, {NOW_MS} - (o_orderkey % 20) * {DAY_MS} AS at_ms FROM orders) r ASOF LEFT JOIN {_F} f ON r.uid = f.uid AND r.at_ms >= f.ts_ms")
def q_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: each order's customer's latest frame at a time of its own."""
    requests = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"), (F.lit(NOW_MS) - F.col("o_orderkey") % 20 * DAY_MS).alias("at_ms"))
    found = ops.as_of(requests, frames(spark, sf_dir))
    return found.select("o_orderkey", "uid", F.col("__seq").alias("seq"), F.col("payload")[0]["value"].alias("value"))


@query(f"SELECT value, event_type FROM {_F} WHERE uid = 3 {_LATEST}")
def q_store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity's latest frame through the store, two columns of it."""
    return loaded(spark, sf_dir).get(1, 3, 2, ["value", "event_type"])


@query(
    f"SELECT s_suppkey AS uid, 'restock' AS event_type, CAST(s_acctbal AS DOUBLE) AS value, s_name AS props FROM supplier "
    f"UNION ALL (SELECT uid, event_type, value, props FROM {_F} WHERE uid NOT IN (SELECT s_suppkey FROM supplier) {_LATEST})"
)
def q_store_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUT replaces all frames of its entities, also those with later times."""
    store = loaded(spark, sf_dir)
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.lit("restock").alias("event_type"), F.col("s_acctbal").cast("double").alias("value"), F.col("s_name").alias("props"))
    store.put(1, 2, rows, timestamp_ms=0)
    return store.latest(1, 2)


@query(f"SELECT uid, seq, ts_ms FROM {_F} WHERE uid BETWEEN 5 AND 12")
def q_store_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's frames of a range of entities."""
    return place(loaded(spark, sf_dir).frames(1, 2, 5, 12))


@query(f"SELECT uid, seq, ts_ms FROM {_F} WHERE NOT (uid BETWEEN 3 AND 9) OR {NOW_MS} - ts_ms <= {TTL_MS}")
def q_store_compact_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a compaction of entities 3 to 9."""
    store = loaded(spark, sf_dir)
    store.set_ttl(TTL_MS)
    store.compact_range(1, 3, 9, now_ms=NOW_MS)
    store.flush_all()
    return place(store.frames(1))


@query(f"SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(value) AS top FROM (SELECT * FROM {_F} {_LATEST}) GROUP BY event_type")
def q_store_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a table's view."""
    return spark.sql(f"SELECT event_type, count(*) AS n, max(value) AS top FROM {loaded(spark, sf_dir).view(1, 2)} GROUP BY event_type")


@query(f"SELECT uid, seq, ts_ms FROM {_F}")
def q_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a stream appends; the stream started again appends none of them twice."""
    store, checkpoint = store_at(spark), new_folder(spark, "stream")
    store.register_schema(1, 2, V2)
    # A pattern, as a stream's source takes no path of a single file.
    files = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")
    rows = as_events(files).select("uid", F.col("ts_ms").alias("__timestamp"), F.col("seq").alias("__place"), *V2.names)
    for _ in range(2):
        append_sink(rows, store, 1, 2, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return place(store.frames(1))


@query(f"SELECT uid, ts_ms, ver, seq % 7 <> 0 AS ok, CASE WHEN seq % 7 <> 0 THEN event_type END AS event_type, CASE WHEN seq % 7 <> 0 THEN value END AS value, CASE WHEN seq % 7 <> 0 THEN props END AS props FROM {_F}")
def q_codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as bytes under their keys' bytes and back; the checksum finds those whose last byte was changed."""
    changed = F.when(F.expr("substring(frame, -1, 1) = X'00'"), F.expr("X'01'")).otherwise(F.expr("X'00'"))
    spoilt = F.concat(F.expr("substring(frame, 1, length(frame) - 1)"), changed)
    stored = export_frames(frames(spark, sf_dir), V2).withColumn("frame", F.when(F.col("__seq") % 7 == 0, spoilt).otherwise(F.col("frame")))
    found = import_values(stored.select(F.unhex(F.lpad(F.hex("uid"), 16, "0")).alias("key"), F.col("frame").alias("value")), V2)
    row = F.get("payload", F.lit(0))
    return found.select("uid", F.col("__timestamp").alias("ts_ms"), F.col("__schema_version").alias("ver"), F.col("__ok").alias("ok"), *(row[n].alias(n) for n in V2.names))


#: What is asked of a store with version 1 of table 1, and the status that it gets.
_REFUSED: dict[str, tuple[Callable[[VersionedStore, DataFrame], object], str]] = {
    "get: no such table": (lambda s, rows: s.get(9, 1, 1), "KeyError"),
    "get: no such version": (lambda s, rows: s.get(1, 1, 9), "KeyError"),
    "get: no such entity": (lambda s, rows: s.get(1, 77, 1), "KeyError"),
    "get: no such column": (lambda s, rows: s.get(1, 1, 1, ["nothing"]), "KeyError"),
    "append: no such table": (lambda s, rows: s.append(9, 1, rows), "KeyError"),
    "append: a field is missing": (lambda s, rows: s.append(1, 1, rows.drop("value")), "Invalid"),
    "append: a field of another type": (lambda s, rows: s.append(1, 1, rows.withColumn("value", F.lit(1))), "Invalid"),
    "append: no rows given": (lambda s, rows: s.batch_append([Append(1, 1, None)]), "Invalid"),
    "put: no time": (lambda s, rows: s.put(1, 1, rows), "Invalid"),
    "register: a field is gone": (lambda s, rows: s.register_schema(1, 2, T.StructType(V1.fields[:1])), "Invalid"),
    "drop: no such table": (lambda s, rows: s.drop_table(9), "KeyError"),
    "compact: no such table": (lambda s, rows: s.compact_range(9), "KeyError"),
    "archive: no such table": (lambda s, rows: s.archive_frame(9), "KeyError"),
    "get: found": (lambda s, rows: s.get(1, 1, 1), "OK"),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{status}')" for name, (_, status) in _REFUSED.items()) + ") AS t(request, status)")
def q_store_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of requests that a store refuses."""
    store = store_at(spark)
    store.register_schema(1, 1, V1)
    rows = spark.createDataFrame([(1, "a", 1.0)], "uid long, event_type string, value double")
    store.append(1, 1, rows)
    out = []
    for name, (ask, _) in _REFUSED.items():
        try:
            ask(store, rows)
            out.append((name, "OK"))
        except StoreError as e:
            out.append((name, e.code))
    return spark.createDataFrame(out, "request string, status string")
