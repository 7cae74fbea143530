"""Projection of rows to a registered version's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidError, NotFoundError


def resolve(fields: T.StructType, columns: list[str] | tuple[str, ...] = ()) -> list[str]:
    """The columns to give, in the order asked for, repeated ones kept; none asked for: all.

    Names are looked up in the target version, with case.
    """
    known = set(fields.names)
    for c in columns:
        if c not in known:
            raise NotFoundError(f"Column not found: {c}")
    return list(columns) or list(fields.names)


def check_types(source: T.StructType, target: T.StructType) -> None:
    """Fields that both versions have must be of one type."""
    kinds = {f.name: f.dataType for f in source.fields}
    for f in target.fields:
        if f.name in kinds and kinds[f.name] != f.dataType:
            raise InvalidError(f"column {f.name} has changed its type")


def is_identity(fields: T.StructType, columns: list[str] | tuple[str, ...]) -> bool:
    """Whether nothing, or exactly all columns in order, is asked for."""
    return not columns or list(columns) == list(fields.names)


def narrowed(frames: DataFrame, fields: T.StructType, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Frames whose nested rows have only ``columns``; written so that the others aren't read at all."""
    kept = T.StructType([fields[name] for name in dict.fromkeys(columns)])
    if len(kept) == len(fields):
        return frames
    rows = F.arrays_zip(*(F.col("payload")[f.name] for f in kept.fields)).cast(T.ArrayType(kept))
    return frames.withColumn("payload", rows)


def align(rows: DataFrame, target: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows in a version's columns: by name, absent ones null, others dropped."""
    there = set(rows.columns)
    return rows.select(*keep, *(F.col(f"`{f.name}`") if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields))


def project(rows: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Plain projection; no columns: the rows unchanged."""
    for c in columns:
        if c not in rows.columns:
            raise NotFoundError(f"Column not found: {c}")
    return rows.select(*(F.col(f"`{c}`") for c in columns)) if columns else rows
