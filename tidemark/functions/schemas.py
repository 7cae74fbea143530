"""Schema versions of tables: what may be registered after what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import InvalidError

#: Types that Parquet files of frames hold faithfully, beside arrays, maps and structs of them.
PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
MAX_ID = (1 << 16) - 1


def check_id(name: str, value: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value <= MAX_ID:
        raise InvalidError(f"{name} must be 0 to {MAX_ID}")


def _check_type(kind: T.DataType, where: str) -> None:
    if isinstance(kind, T.ArrayType):
        _check_type(kind.elementType, where)
    elif isinstance(kind, T.MapType):
        _check_type(kind.keyType, where)
        _check_type(kind.valueType, where)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            _check_type(f.dataType, f"{where}.{f.name}")
    elif not isinstance(kind, PLAIN):
        raise InvalidError(f"{where}: type {kind.simpleString()} is not supported")


def bare(kind: T.DataType) -> T.DataType:
    """The type with all inner parts nullable and no metadata, as files give it back."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(bare(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(bare(kind.keyType), bare(kind.valueType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, bare(f.dataType)) for f in kind.fields])
    return kind


def check_superset(old: T.StructType, new: T.StructType) -> None:
    """Every old field stays by name, type and nullability; new ones are nullable.  Order is free."""
    by_name = {f.name: f for f in new.fields}
    for f in old.fields:
        if f.name not in by_name:
            raise InvalidError(f"field {f.name} is missing")
        if by_name[f.name].dataType != f.dataType or by_name[f.name].nullable != f.nullable:
            raise InvalidError(f"field {f.name} has changed")
    known = {f.name for f in old.fields}
    for f in new.fields:
        if f.name not in known and not f.nullable:
            raise InvalidError(f"new field {f.name} must be nullable")


class SchemaRegistry:
    """(table, version) to schema."""

    def __init__(self) -> None:
        self.schemas: dict[int, dict[int, T.StructType]] = {}

    def check(self, table: int, version: int, schema: T.StructType) -> None:
        """Raise unless the version may be registered now."""
        check_id("table", table)
        check_id("version", version)
        if schema is None:
            raise InvalidError("schema must not be null")
        names = [f.name.lower() for f in schema.fields]
        if len(set(names)) < len(names):
            raise InvalidError("field names must differ in more than case")
        for f in schema.fields:
            if f.name.startswith("__") or f.name == "uid":
                raise InvalidError(f"field name {f.name} is reserved")
            _check_type(f.dataType, f.name)
        known = self.schemas.get(table, {})
        if version in known:
            raise InvalidError(f"version {version} of table {table} is already registered")
        if known:
            last = max(known)
            if version < last:
                raise InvalidError(f"version {version} is lower than {last}")
            check_superset(known[last], schema)

    def register(self, table: int, version: int, schema: T.StructType) -> None:
        self.check(table, version, schema)
        self.schemas.setdefault(table, {})[version] = schema

    def unregister(self, table: int) -> None:
        self.schemas.pop(table, None)

    def get(self, table: int, version: int) -> T.StructType | None:
        return self.schemas.get(table, {}).get(version)

    def max_version(self, table: int) -> int | None:
        return max(self.schemas.get(table, {}), default=None)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        """One row for each field of each version."""
        rows = [(t, v, i, f.name, f.dataType.simpleString(), f.nullable) for t, x in sorted(self.schemas.items()) for v, s in sorted(x.items()) for i, f in enumerate(s.fields)]
        return spark.createDataFrame(rows, "table_id int, version int, position int, name string, type string, nullable boolean")
