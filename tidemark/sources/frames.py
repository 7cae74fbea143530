"""The frames layout: one row for each frame, its rows nested in ``payload``.

A frame may hold many rows or none, so a frame is never a row of its table.

Columns: uid, __timestamp (ms), __seq (order of arrival), __op (APPEND, PUT),
__schema_version, __ok (its checksum holds), payload (array of structs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schemas import bare

META = ("uid", "__timestamp", "__seq", "__op", "__schema_version", "__ok")


def frame_schema(fields: T.StructType) -> T.StructType:
    """Of the frames of a table whose rows have ``fields``.

    Reading files with a newer or older version's fields fills absent ones with
    nulls and leaves others unread: Parquet resolves nested fields by name.
    """
    return T.StructType([
        T.StructField("uid", T.LongType()), T.StructField("__timestamp", T.LongType()), T.StructField("__seq", T.LongType()), T.StructField("__op", T.StringType()),
        T.StructField("__schema_version", T.IntegerType()), T.StructField("__ok", T.BooleanType()), T.StructField("payload", T.ArrayType(bare(fields))),
    ])


def read_frames(spark: SparkSession, paths: list[str], fields: T.StructType) -> DataFrame:
    """Frames from files of any versions, their payload as ``fields``."""
    schema = frame_schema(fields)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def one_row_frames(rows: DataFrame, fields: list[str], *, uid: Column, timestamp: Column, seq: Column, version: Column, op: Column | None = None, ok: Column | None = None) -> DataFrame:
    """A frame for each row."""
    return rows.select(
        uid.cast("long").alias("uid"), timestamp.cast("long").alias("__timestamp"), seq.cast("long").alias("__seq"), (op if op is not None else F.lit("APPEND")).alias("__op"),
        version.cast("int").alias("__schema_version"), (ok if ok is not None else F.lit(True)).alias("__ok"), F.array(F.struct(*fields)).alias("payload"),
    )


def rows_of(frames: DataFrame, columns: list[str], keep: tuple[str, ...] = ("uid",)) -> DataFrame:
    """The rows of frames, with ``columns`` of the payload in that order.

    ``explode`` and then fields: only the wanted ones are read from files.
    Frames without rows give none.
    """
    rows = frames.select(*keep, F.explode("payload").alias("__row"))
    return rows.select(*keep, *(F.col(f"__row.`{c}`").alias(c) for c in columns))
