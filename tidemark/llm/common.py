"""Helpers that the operators share: tables, shared storage, folds, row ids."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (local tests) is a temporary folder of
    this machine used; driver and executors are one process there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = os.path.join(tempfile.gettempdir(), "checkpoints", f"tidemark-{os.getpid()}")
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there.

    The table survives the loss of executors; every later read sees the same
    rows, also where the plan that made them wasn't deterministic.  The shuffle
    files that made it are garbage then; Spark deletes them once the driver's
    JVM has collected theirs, so that is asked for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as the function of a task that gives its memory back to the system when it ends, as worker processes live on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def plus(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` and more columns, by name and type."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in kinds.items())])


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, mod ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch of strings, end to end, and n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches with at most ``most_bytes`` of ``column`` each; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer; every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and n + 1 offsets into them.

    A word is a longest run without the bytes 20 and 09 to 0D; A-Z count as
    a-z.  All of it runs over whole arrays; a word's hash depends on its bytes
    alone: its blocks of eight bytes are mixed, each with its number, and
    summed, and the sum is mixed with the length.  Words of up to eight bytes
    and the same length never share a hash; others do by chance, about once in
    2**64 pairs, unless they are made to.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a word ends with its text
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1] | first[1:n]]))
    ends = np.flatnonzero(word & np.concatenate([~word[1:] | first[1:n], [True]])) + 1
    cuts = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), cuts
    lower = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    lengths = ends - starts
    blocks = (lengths + 7) >> 3
    begin = np.cumsum(blocks) - blocks
    number = np.arange(len(begin) and int(begin[-1] + blocks[-1])) - np.repeat(begin, blocks)
    at = np.repeat(starts, blocks) + 8 * number
    left = np.minimum(np.repeat(ends, blocks) - at, 8).astype(np.uint64)
    value = np.zeros(len(at), np.uint64)
    for k in range(8):
        value |= lower[at + k].astype(np.uint64) << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        value &= ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left)
        number = number.astype(np.uint64)
        mixed = mix(value + (number + np.uint64(1)) * _STEP) ^ number
        total = mixed if len(at) == len(starts) else np.add.reduceat(mixed, begin)
        return mix(total + lengths.astype(np.uint64) * _STEP), cuts
