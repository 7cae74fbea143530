"""The store: tables of versioned frames by entity, over Parquet files and a commit log."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import StoreConfig
from tidemark.errors import CapacityError, ConflictError, InvalidError, NotFoundError, SerializationError, StoreError
from tidemark.functions.metrics import Metrics
from tidemark.functions.schemas import SchemaRegistry, bare, check_id
from tidemark.operators import frames as ops
from tidemark.operators.projection import check_types, is_identity, narrowed, resolve
from tidemark.sources.commit_log import CommitLog
from tidemark.sources.frames import frame_schema, read_frames, rows_of

_LOGGER = logging.getLogger(__name__)

#: Commit numbers stand above so many bits of ``__seq``; the place in a commit below.
_PLACE_BITS = 32
_MAX_UID = (1 << 63) - 1


@dataclass(frozen=True)
class DataFile:
    """A folder of frames of one schema version, as a commit added it."""

    path: str
    version: int
    min_uid: int
    max_uid: int
    n: int
    has_put: bool


@dataclass
class Snapshot:
    """What the log said when it was read."""

    commit: int = 0
    registry: SchemaRegistry = field(default_factory=SchemaRegistry)
    generation: dict[int, int] = field(default_factory=dict)
    files: dict[int, dict[str, DataFile]] = field(default_factory=dict)
    #: How many changes were published, and the last batch of each stream.
    changes: int = 0
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def tables(self) -> list[int]:
        return sorted(self.files)


@dataclass(frozen=True)
class Append:
    """One item of a batch append: frames of one table and version."""

    table: int
    version: int
    frames: DataFrame | None


@dataclass(frozen=True)
class Request:
    """One item of a batch get."""

    table: int
    uid: int
    version: int
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class BatchResult:
    """``status``: req_idx, uid, status, message, n_rows, in the order of the requests.

    ``groups``: rows by (table, version, columns), with req_idx and uid, as
    requests of different columns can't share a table.
    """

    status: DataFrame
    groups: dict[tuple[int, int, tuple[str, ...]], DataFrame]


class VersionedStore:
    """Frames by table and entity.  Every read is one lazy DataFrame over a snapshot of the log."""

    def __init__(self, spark: SparkSession, config: StoreConfig | str) -> None:
        self.spark = spark
        self.config = StoreConfig(db_path=config) if isinstance(config, str) else config
        self.metrics = Metrics()
        self.state = "NotReady"
        self.ttl_ms = 0

    # Life cycle

    def init(self) -> VersionedStore:
        """Open or create; data that the log doesn't know is removed."""
        if self.state == "Ready":
            raise InvalidError("engine is open")
        self.config.validate()
        self.root = self.config.db_path.rstrip("/")
        self.log = CommitLog(self.spark, self.root)
        self.ttl_ms = self.config.ttl_ms
        self.state = "Ready"
        self._remove_orphans()
        self.metrics.set("active_tables", len(self.snapshot().tables))
        return self

    def close(self) -> None:
        if self.state == "Ready":
            self.state = "Closed"

    def __enter__(self) -> VersionedStore:
        return self.init() if self.state == "NotReady" else self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _ready(self) -> None:
        if self.state != "Ready":
            raise InvalidError("engine not ready")

    def snapshot(self) -> Snapshot:
        """The state after all published commits."""
        self._ready()
        out = Snapshot()
        commits, out.changes = self.log.commits()
        for commit, action in ((commit, action) for commit, actions in commits for action in actions):
            out.commit = commit
            kind, table = action["kind"], action.get("table")
            if kind == "schema":
                out.registry.schemas.setdefault(table, {})[action["version"]] = T.StructType.fromJson(action["schema"])
                out.files.setdefault(table, {})
                out.generation.setdefault(table, 0)
            elif kind == "add":
                if table in out.files and action["generation"] == out.generation[table]:
                    out.files[table][action["path"]] = DataFile(action["path"], action["version"], action["min_uid"], action["max_uid"], action["n"], action["has_put"])
            elif kind == "remove":
                out.files.get(table, {}).pop(action["path"], None)
            elif kind == "batch":
                out.batches[action["stream"]] = max(action["id"], out.batches.get(action["stream"], -1))
            elif kind == "drop":
                out.registry.unregister(table)
                out.files.pop(table, None)
                out.generation[table] = out.generation.get(table, 0) + 1
        return out

    def _folder(self, table: int, generation: int) -> str:
        return f"tables/t_{table:04d}/g{generation}"

    def _remove_orphans(self) -> None:
        """Delete generations of tables that no commit refers to."""
        # Listed first: a table's commit is older than its folder, so the log knows all that are in use.
        there = [(name, generation) for name in self.log.folders(f"{self.root}/tables") for generation in self.log.folders(f"{self.root}/tables/{name}")]
        now = self.snapshot()
        for name, generation in there:
            if not name.startswith("t_") or int(name[2:]) not in now.files or generation != f"g{now.generation[int(name[2:])]}":
                _LOGGER.info("removing %s/%s, which no commit refers to", name, generation)
                self.log.delete(f"{self.root}/tables/{name}/{generation}")

    def _change(self, actions: Callable[[Snapshot], list[dict]]) -> Snapshot:
        """Publish ``actions(now)``, made anew from the newest state until no other change has come in between; that state."""
        while True:
            now = self.snapshot()
            if self.log.publish_change(now.changes, actions(now)) is not None:
                return now
            _LOGGER.info("another change was published first; checking again")

    # Schemas

    def register_schema(self, table: int, version: int, schema: T.StructType) -> None:
        """Add a version; the first one creates the table.  Nothing is written unless all checks hold."""

        def actions(now: Snapshot) -> list[dict]:
            now.registry.check(table, version, schema)
            if table not in now.files and len(now.files) >= self.config.max_column_families:
                raise CapacityError(f"there are {len(now.files)} tables already")
            return [{"kind": "schema", "table": table, "version": version, "schema": schema.jsonValue()}]

        now = self._change(actions)
        self.metrics.set("active_tables", len(now.files) + (table not in now.files))

    def schemas(self) -> DataFrame:
        """One row for each field of each registered version."""
        return self.snapshot().registry.as_frame(self.spark)

    def _known(self, now: Snapshot, table: int, version: int | None = None) -> T.StructType | None:
        if table not in now.files:
            raise NotFoundError("table not found")
        if version is None:
            return None
        found = now.registry.get(table, version)
        if found is None:
            raise NotFoundError("schema not found")
        return found

    # Writing

    def _frames(self, rows: DataFrame, fields: T.StructType, version: int, op: str, commit: int, timestamp: Column, place: Column) -> DataFrame:
        """Frames to be stored.  ``rows`` has uid and the fields (a frame for each row), or uid and ``payload``."""
        if "uid" not in rows.columns:
            raise InvalidError("rows need a column uid")
        nested = "payload" in rows.columns and "payload" not in fields.names
        if nested:
            kind = rows.schema["payload"].dataType
            if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
                raise InvalidError("payload must be an array of rows")
            given = {f.name: f.dataType for f in kind.elementType.fields}
        else:
            given = {f.name: f.dataType for f in rows.schema.fields}
        for f in fields.fields:
            if f.name not in given:
                raise InvalidError(f"field {f.name} is missing")
            if bare(given[f.name]) != bare(f.dataType):
                raise InvalidError(f"field {f.name} is {given[f.name].simpleString()}, not {f.dataType.simpleString()}")
        extra = set(given) - set(fields.names) - ({"uid", "payload"} if nested else {"uid", "__timestamp", "__place"})
        if extra:
            raise InvalidError(f"fields {sorted(extra)} aren't in version {version}")

        def checked(get):
            # A null where the version allows none fails the write, and with it the whole commit.
            return F.struct(*(get(f.name).alias(f.name) if f.nullable else F.coalesce(get(f.name), F.raise_error(F.lit(f"field {f.name} must not be null")).cast(f.dataType)).alias(f.name) for f in fields.fields))

        payload = F.transform("payload", lambda r: checked(lambda n: r[n])) if nested else F.array(checked(lambda n: F.col(f"`{n}`")))
        uid = F.col("uid").cast("long")
        uid = F.when((uid >= 0) & uid.isNotNull(), uid).otherwise(F.raise_error(F.lit("uid must be 0 to 2**63 - 1")).cast("long"))
        return rows.select(
            uid.alias("uid"), timestamp.cast("long").alias("__timestamp"), (F.lit(commit << _PLACE_BITS) + place).cast("long").alias("__seq"), F.lit(op).alias("__op"),
            F.lit(version).alias("__schema_version"), F.lit(True).alias("__ok"), payload.alias("payload"),
        )

    def _write(self, now: Snapshot, table: int, version: int, commit: int, frames: DataFrame, number: int = 0) -> list[dict]:
        """Write frames sorted by entity, so that files skip by their statistics; the actions that publish them."""
        path = f"{self._folder(table, now.generation[table])}/c{commit}-{number}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        measured = frames.observe(seen, F.count("*").alias("n"), F.min("uid").alias("low"), F.max("uid").alias("high"), F.max((F.col("__op") == "PUT").cast("int")).alias("put"), F.sum(F.size("payload")).alias("rows"))
        measured.sortWithinPartitions("uid", "__seq").write.parquet(f"{self.root}/{path}")
        found = seen.get
        if not found["n"]:
            self.log.delete(f"{self.root}/{path}")
            return []
        return [{"kind": "add", "table": table, "generation": now.generation[table], "path": path, "version": version, "min_uid": found["low"], "max_uid": found["high"], "n": found["n"], "has_put": bool(found["put"])}]

    @staticmethod
    def _place(rows: DataFrame, order: list[str]) -> tuple[DataFrame, Column]:
        """Rows with a place in the commit: by ``__place``, or numbered for each entity, or 0 if entities don't repeat."""
        if "__place" in rows.columns:
            return rows, F.col("__place")
        if order:
            return rows.withColumn("__place", F.row_number().over(Window.partitionBy("uid").orderBy(*order)) - 1), F.col("__place")
        return rows, F.lit(0)

    def _store(self, items: Iterable[tuple[Append, Column]], op: str, order: list[str] = (), batch: tuple[str, int] | None = None) -> int:
        began = time.time()
        now = self.snapshot()
        items = list(items)
        if not items or batch and now.batches.get(batch[0], -1) >= batch[1]:
            return now.commit
        for item, _ in items:
            if item.frames is None:
                raise InvalidError("a batch must not be null")
            self._known(now, item.table)
        for item, _ in items:
            self._known(now, item.table, item.version)
        commit = self.log.claim()
        plans = []
        for number, (item, timestamp) in enumerate(items):
            rows, place = self._place(item.frames, list(order))
            place = place if len(items) == 1 else F.lit(number)
            plans.append((item, self._frames(rows, now.registry.get(item.table, item.version), item.version, op, commit, timestamp, place)))
        actions, written = [], []
        try:
            # Items of one table and version share one write.
            grouped: dict[tuple[int, int], DataFrame] = {}
            for item, frames in plans:
                key = (item.table, item.version)
                grouped[key] = grouped[key].unionByName(frames) if key in grouped else frames
            for number, ((table, version), frames) in enumerate(grouped.items()):
                found = self._write(now, table, version, commit, frames, number)
                actions += found
                written += found
        except Exception:
            for action in written:
                self.log.delete(f"{self.root}/{action['path']}")
            raise
        if actions:
            self.log.publish(commit, actions + ([{"kind": "batch", "stream": batch[0], "id": batch[1]}] if batch else []))
        for action in actions:
            self.metrics.add("feature_append_total", action["table"], action["n"])
        self.metrics.observe("append_latency_us", (time.time() - began) * 1e6)
        return commit

    def append(self, table: int, version: int, rows: DataFrame, now_ms: int | None = None, order_by: Iterable[str] = (), batch: tuple[str, int] | None = None) -> int:
        """Append frames with the time ``now_ms``, or their own ``__timestamp``; the commit's number.

        ``rows`` has uid and the version's fields, a frame for each row; or uid
        and ``payload``, an array of rows.  If an entity has several frames,
        ``order_by`` (or a column ``__place``) says in what order they arrive.
        ``batch``, a stream's name and the batch's number there, is recorded with
        the commit; a batch up to the last one recorded is not appended again.
        """
        stamp = F.col("__timestamp") if "__timestamp" in rows.columns else F.lit(_now(now_ms))
        return self._store([(Append(table, version, rows), stamp)], "APPEND", list(order_by), batch)

    def put(self, table: int, version: int, rows: DataFrame, timestamp_ms: int | None = None, order_by: Iterable[str] = ()) -> int:
        """Replace all frames of the rows' entities; times as given by the caller."""
        if timestamp_ms is None and "__timestamp" not in rows.columns:
            raise InvalidError("put needs a timestamp")
        stamp = F.lit(timestamp_ms) if timestamp_ms is not None else F.col("__timestamp")
        return self._store([(Append(table, version, rows), stamp)], "PUT", list(order_by))

    def batch_append(self, items: Iterable[Append], now_ms: int | None = None) -> int:
        """Append to many tables, all or nothing: one commit publishes everything.

        Item i has the time ``now_ms + i``, so later items win.
        """
        base = _now(now_ms)
        return self._store([(item, F.lit(base + i)) for i, item in enumerate(items)], "APPEND")

    # Reading

    def frames(self, table: int, version: int | None = None, uid_low: int | None = None, uid_high: int | None = None) -> DataFrame:
        """All visible frames, in arrival order by ``__seq``; expired ones too, until compaction.

        Files that hold no entity in the given range aren't opened.
        """
        now = self.snapshot()
        self._known(now, table)
        fields = now.registry.get(table, version if version is not None else now.registry.max_version(table))
        if fields is None:
            raise NotFoundError("schema not found")
        return self._visible(now, table, fields, uid_low, uid_high)

    def _visible(self, now: Snapshot, table: int, fields: T.StructType, low: int | None = None, high: int | None = None) -> DataFrame:
        files = [f for f in now.files[table].values() if (high is None or f.min_uid <= high) and (low is None or f.max_uid >= low)]
        found = read_frames(self.spark, [f"{self.root}/{f.path}" for f in files], fields)
        if low is not None and low == high:
            found = found.where(F.col("uid") == low)
        elif low is not None or high is not None:
            found = found.where((F.col("uid") >= (low or 0)) & (F.col("uid") <= (_MAX_UID if high is None else high)))
        return ops.visible(found) if any(f.has_put for f in files) else found

    def latest(self, table: int, version: int, columns: Iterable[str] = ()) -> DataFrame:
        """uid and the columns: the rows of every entity's latest frame."""
        now = self.snapshot()
        fields = self._known(now, table, version)
        wanted = resolve(fields, list(columns))
        return rows_of(ops.latest(narrowed(self._visible(now, table, fields), fields, wanted)), wanted)

    def get(self, table: int, uid: int, version: int, columns: Iterable[str] = ()) -> DataFrame:
        """The rows of an entity's latest valid frame, in the version's columns or those asked for.

        Raises as the checks fall: store, table, version, entity, valid frame,
        the frame's own version, columns.
        """
        began = time.time()
        columns = list(columns)
        now = self.snapshot()
        fields = self._known(now, table, version)
        found = self._visible(now, table, fields, uid, uid)
        row = self._one(found)
        if row is None:
            self.metrics.add("feature_get_miss_total", table)
            self.metrics.observe("projection_ratio", 1.0)
            raise NotFoundError(f"uid {uid} not found")
        if not row["__ok"]:
            self.metrics.add("crc_error_total", table)
            raise SerializationError("no valid frame")
        source = now.registry.get(table, row["__schema_version"])
        if source is None:
            raise NotFoundError("source schema not found")
        wanted = resolve(fields, columns)
        check_types(source, fields)
        self.metrics.add("feature_get_total", table)
        self.metrics.observe("projection_ratio", 1.0 if is_identity(fields, columns) else len(wanted) / max(len(fields.fields), 1))
        self.metrics.observe("get_latency_us", (time.time() - began) * 1e6)
        rows = [[r[c] for c in wanted] for r in row["payload"]]
        named = T.StructType([T.StructField(f"c{i}", fields[c].dataType) for i, c in enumerate(wanted)])
        return self.spark.createDataFrame(rows, named).toDF(*wanted)

    @staticmethod
    def _one(frames: DataFrame) -> Row | None:
        """The latest valid frame, or any if none is valid."""
        best = frames.orderBy(F.desc("__ok"), F.desc("__timestamp"), F.desc("__seq")).limit(1).collect()
        return best[0] if best else None

    def batch_get(self, requests: Iterable[Request]) -> BatchResult:
        """Look up many entities of many tables; no request's failure touches another."""
        rows = [(i, r.table, r.uid, r.version, list(r.columns)) for i, r in enumerate(requests)]
        schema = "req_idx long, table_id int, uid long, version int, columns array<string>"
        return self.batch_get_frame(self.spark.createDataFrame(rows, schema))

    def batch_get_frame(self, requests: DataFrame) -> BatchResult:
        """As ``batch_get`` for a DataFrame of req_idx, table_id, uid, version, columns, of any size.

        Requests of one table, version and columns are looked up together, by a
        join with the latest frames of the entities that they name; the number
        of such kinds is small whatever the number of requests.
        """
        began = time.time()
        now = self.snapshot()
        kinds = [(r["table_id"], r["version"], tuple(r["columns"] or ()), r["n"]) for r in requests.groupBy("table_id", "version", "columns").agg(F.count("*").alias("n")).collect()]
        out: list[DataFrame] = []
        groups: dict[tuple[int, int, tuple[str, ...]], DataFrame] = {}
        for table, version, columns, n in sorted(kinds):
            self.metrics.add("batch_get_total", table)
            self.metrics.add("batch_get_keys_total", table, n)
            mine = requests.where((F.col("table_id") == table) & (F.col("version") == version) & (F.coalesce("columns", F.array().cast("array<string>")) == F.array(*map(F.lit, columns)).cast("array<string>"))).select("req_idx", "uid")
            fail = lambda e, of=mine: of.select("req_idx", "uid", F.lit(e.code).alias("status"), F.lit(str(e)).alias("message"), F.lit(0).cast("long").alias("n_rows"))
            if table not in now.files:
                out.append(fail(NotFoundError("table not found")))
                continue
            fields = now.registry.get(table, version)
            later: StoreError | None = NotFoundError("schema not found") if fields is None else None
            wanted: list[str] = []
            if fields is not None:
                try:
                    wanted = resolve(fields, columns)
                except StoreError as e:
                    later = e
            shape = fields if fields is not None else T.StructType([])
            stored = self._visible(now, table, shape if shape.fields else now.registry.get(table, now.registry.max_version(table)))
            asked = mine.select(F.col("uid").alias("__asked")).distinct()
            candidates = stored.join(asked, F.col("uid") == F.col("__asked"), "left_semi")
            if later is None:
                candidates = narrowed(candidates, fields, wanted)
            # One aggregate: the latest valid frame, or an invalid one where an entity has no other.
            order = F.struct(F.coalesce("__ok", F.lit(False)), "__timestamp", "__seq")
            best = candidates.groupBy(F.col("uid").alias("__seen")).agg(F.max_by(F.struct(F.coalesce("__ok", F.lit(False)).alias("__any_ok"), "__schema_version", *(["payload"] if later is None else [])), order).alias("__best"))
            joined = mine.join(best.select("__seen", "__best.*"), F.col("uid") == F.col("__seen"), "left")
            # A missing entity is reported before a bad version or column.
            status = F.when(F.col("__seen").isNull(), "KeyError").when(F.lit(later is not None and later.code == "KeyError" and fields is None), "KeyError").when(~F.col("__any_ok"), "SerializationError")
            message = F.when(F.col("__seen").isNull(), F.concat(F.lit("uid "), F.col("uid").cast("string"), F.lit(" not found"))).when(F.lit(fields is None), "schema not found").when(~F.col("__any_ok"), "no valid frame")
            known = sorted(now.registry.schemas.get(table, {}))
            foreign = ~F.col("__schema_version").isin(known) if known else F.lit(True)
            status, message = status.when(foreign, "KeyError"), message.when(foreign, "source schema not found")
            if later is not None:
                status, message = status.otherwise(later.code), message.otherwise(str(later))
            else:
                status, message = status.otherwise("OK"), message.otherwise("")
            found = joined.select("req_idx", "uid", status.alias("status"), message.alias("message"), (F.when(status == "OK", F.size("payload")).otherwise(0) if later is None else F.lit(0)).cast("long").alias("n_rows"), *(["payload"] if later is None else []))
            out.append(found.drop("payload"))
            if later is None:
                groups[table, version, columns] = rows_of(found.where("status = 'OK'"), wanted, ("req_idx", "uid"))
        empty = self.spark.createDataFrame([], "req_idx long, uid long, status string, message string, n_rows long")
        for part in out:
            empty = empty.unionByName(part)
        self.metrics.observe("batch_get_latency_us", (time.time() - began) * 1e6)
        return BatchResult(empty.orderBy("req_idx"), groups)

    # Retention

    def set_ttl(self, ttl_ms: int) -> None:
        """For compactions to come; one that runs keeps what it began with."""
        self.ttl_ms = ttl_ms

    def get_ttl(self) -> int:
        return self.ttl_ms

    def flush_all(self) -> None:
        """Writes are durable once they return."""
        self._ready()

    def compact_all(self, now_ms: int | None = None) -> None:
        """Compact every table."""
        for table in self.snapshot().tables:
            self.compact_range(table, now_ms=now_ms)

    def compact_range(self, table: int | None = None, uid_start: int | None = None, uid_end: int | None = None, force_bottommost: bool = False, now_ms: int | None = None, ttl_ms: int | None = None) -> None:
        """Rewrite a table's frames without what is replaced, expired or invalid.

        The range holds for one table only.  Files outside of it are kept as
        they are; the others are rewritten, each version's frames by themselves,
        and one commit swaps them.  ``force_bottommost`` rewrites them also if
        nothing would go.  If the table is compacted or dropped by others before
        that commit, nothing changes and ``ConflictError`` is raised; appends
        may go on meanwhile.
        """
        now = self.snapshot()
        if table is None:
            return self.compact_all(now_ms)
        self._known(now, table)
        now_ms, ttl_ms = _now(now_ms), self.ttl_ms if ttl_ms is None else ttl_ms
        files = [f for f in now.files[table].values() if (uid_end is None or f.min_uid <= uid_end) and (uid_start is None or f.max_uid >= uid_start)]
        if not files:
            return None
        versions = sorted({f.version for f in files})
        everything = read_frames(self.spark, [f"{self.root}/{f.path}" for f in files], now.registry.get(table, now.registry.max_version(table)))
        kept = ops.compacted(everything, now_ms, ttl_ms, uid_start, uid_end)
        # Counted by entity first, as one aggregate with a distinct count would be planned twice over all frames.
        counted = lambda of: of.groupBy("uid").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        before, after = counted(everything), counted(kept)
        if before == after and not force_bottommost and len(files) == len(versions):
            return None
        commit, actions = self.log.claim(), []
        for number, version in enumerate(versions):
            # Narrow keys decide; each version's payload is read with its own fields, so nothing of it is lost.
            own = read_frames(self.spark, [f"{self.root}/{f.path}" for f in files if f.version == version], now.registry.get(table, version))
            keys = kept.where(F.col("__schema_version") == version).select(F.col("uid").alias("__u"), F.col("__seq").alias("__s"))
            frames = own.join(keys, (F.col("uid") == F.col("__u")) & (F.col("__seq") == F.col("__s")), "left_semi")
            # Each file gets a range of entities of its own, so point reads skip the others; a busy entity may take several.
            actions += self._write(now, table, version, commit, frames.repartitionByRange("uid", "__seq"), number)

        def swap(newest: Snapshot) -> list[dict]:
            if newest.generation.get(table) != now.generation[table] or any(f.path not in newest.files.get(table, {}) for f in files):
                raise ConflictError(f"table {table} was compacted or dropped meanwhile")
            return [{"kind": "remove", "table": table, "path": f.path} for f in files] + actions

        try:
            self._change(swap)
        except ConflictError:
            _LOGGER.warning("compaction of table %d gives way to another change", table)
            for action in actions:
                self.log.delete(f"{self.root}/{action['path']}")
            raise
        _LOGGER.info("compacted table %d: %d frames of %d stay", table, after[0], before[0])
        self.metrics.add("ttl_expired_frames_total", table, before[0] - after[0])
        self.metrics.add("ttl_expired_keys_total", table, before[1] - after[1])
        return None

    def vacuum(self, older_than_ms: int = 86_400_000) -> None:
        """Delete files that commits have removed; readers of older snapshots must be done.

        Files changed within ``older_than_ms`` stay, as commits that aren't
        published yet may be writing them.
        """
        now = self.snapshot()
        for table in now.tables:
            folder = self._folder(table, now.generation[table])
            known = {f.path for f in now.files[table].values()}
            for name in self.log.folders(f"{self.root}/{folder}"):
                if f"{folder}/{name}" not in known and self.log.age_ms(f"{self.root}/{folder}/{name}") >= older_than_ms:
                    _LOGGER.info("vacuum removes %s/%s", folder, name)
                    self.log.delete(f"{self.root}/{folder}/{name}")

    # Leaving

    def drop_table(self, table: int) -> None:
        """Forget a table, its versions and its frames; its number may be used again."""

        def actions(now: Snapshot) -> list[dict]:
            self._known(now, table)
            return [{"kind": "drop", "table": table}]

        now = self._change(actions)
        self.log.delete(f"{self.root}/{self._folder(table, now.generation[table])}")
        self.metrics.set("active_tables", len(now.files) - 1)
        self.metrics.move("dropped_tables_total", 1)

    def archive_frame(self, table: int) -> DataFrame:
        """__uid, __timestamp, __schema_version and the latest version's columns: every row of every valid frame."""
        now = self.snapshot()
        self._known(now, table)
        fields = now.registry.get(table, now.registry.max_version(table))
        return archived(self._visible(now, table, fields), fields)

    def archive_table(self, table: int, path: str, single_file: bool = True) -> None:
        """Write the archive as Parquet in the order of entity and arrival, then drop the table.

        ``single_file``: one file at exactly ``path``, written by one task, as a
        sink for small tables; otherwise a folder of sorted files that many
        tasks write.
        """
        rows = self.archive_frame(table)
        if not single_file:
            rows.write.mode("overwrite").parquet(path)
        else:
            own = f"{path}.{uuid.uuid4().hex}"
            rows.coalesce(1).write.parquet(own)
            made = self.log._path
            files = [f.getPath() for f in self.log.fs.listStatus(made(own)) if f.getPath().getName().startswith("part-")]
            self.log.fs.delete(made(path), True)
            if not self.log.fs.rename(files[0], made(path)):
                raise OSError(f"can't write {path}")
            self.log.fs.delete(made(own), True)
        self.drop_table(table)

    def view(self, table: int, version: int) -> str:
        """A temporary SQL view of the latest rows; its name."""
        check_id("table", table)
        name = f"t_{table:04d}"
        self.latest(table, version).createOrReplaceTempView(name)
        return name


def archived(frames: DataFrame, fields: T.StructType) -> DataFrame:
    """Every row of every valid frame with its frame's entity, time and version, in scan order."""
    rows = frames.where("__ok").select("uid", "__timestamp", "__schema_version", "__seq", F.posexplode("payload").alias("__place", "__row"))
    return rows.orderBy("uid", "__seq", "__place").select(F.col("uid").alias("__uid"), "__timestamp", "__schema_version", *(F.col(f"__row.`{f.name}`").alias(f.name) for f in fields.fields))


def _now(now_ms: int | None) -> int:
    return int(time.time() * 1000) if now_ms is None else now_ms


__all__ = ["Append", "BatchResult", "Request", "VersionedStore", "archived", "frame_schema"]
