"""Chroma audio fingerprints: from samples to packed integers, and their alignment.

Sound is cut into overlapping frames; each frame's spectrum is folded into the
energies of the twelve pitch classes.  Sixteen filters compare sums over
rectangles of that image (frames by pitch classes), which an integral image
gives in four look-ups each.  Each filter's log ratio becomes two bits, in Gray
code so that neighbours differ in one, and the sixteen make one 32-bit integer
for each position.

Two fingerprints align at the offset at which most positions have integers in
common (by the leading bits); the share of bits that differ there tells how
alike they are.  Over a table a stated set of queries meets every other
fingerprint: distinct ones, and those that ask, are dealt into blocks by hash,
and for each block of either sort sorted leading bits give all positions in
common, which are counted by pair and offset.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import plus, table, written

RATE, FRAME, HOP = 11025, 4096, 1365
LOWEST, HIGHEST = 28.0, 3520.0
#: Frames that the filters span, and the weights that smooth the image over time.
SPAN, SMOOTH = 16, (0.25, 0.75, 1.0, 0.75, 0.25)
#: Log ratios at which a filter's two bits change.
EDGES = (-0.12, 0.0, 0.12)
#: Leading bits by which positions are paired.
LEADING = 20
#: Bytes of fingerprints in a block, about, and matching positions that are counted together.
BLOCK, MATCHES = 2_000_000, 4_000_000
#: A fingerprint of at least this share of the rows is looked up from a broadcast, which so has no more rows than its inverse.
HOT = 0.001


def _filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters by rule: kind, lowest pitch class, pitch classes, frames; widths and heights run through their range."""
    out = []
    for k in range(16):
        height = (2, 4, 6, 12)[k // 4]
        width = (4, 8, 12, 16)[k % 4]
        out.append((k % 3 if height < 12 else 1 + k % 2, (5 * k) % (12 - height + 1), height, width))
    return out


FILTERS = _filters()
_WINDOW = np.hamming(FRAME)


def _pitch_classes() -> np.ndarray:
    """Which of the twelve pitch classes each bin of a spectrum belongs to; -1: none."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.full(len(hertz), -1)
    fine = (hertz >= LOWEST) & (hertz <= HIGHEST)
    out[fine] = np.round(12 * np.log2(hertz[fine] / 440.0)).astype(int) % 12
    return out


_FOLD = np.zeros((FRAME // 2 + 1, 12))
_FOLD[np.flatnonzero(_pitch_classes() >= 0), _pitch_classes()[_pitch_classes() >= 0]] = 1


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by pitch classes; each frame has length 1, or is 0 if silent.  Less sound than a frame gives none."""
    samples = np.asarray(samples, float)
    if rate != RATE and len(samples):
        at = np.arange(int(len(samples) * RATE / rate)) * (rate / RATE)
        samples = np.interp(at, np.arange(len(samples)), samples)
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    image = np.concatenate([np.abs(np.fft.rfft(frames[i : i + 256] * _WINDOW)) ** 2 @ _FOLD for i in range(0, n, 256)])
    if n >= len(SMOOTH):
        image = sum(w * image[k : n - len(SMOOTH) + 1 + k] for k, w in enumerate(SMOOTH))
    size = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return np.where(size > 0.01, image / np.maximum(size, 1e-12), 0)


def integral(image: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the origin, with a row and a column of zeros before."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    out[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    return out


def pack(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each position at which the filters fit."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    sums, at = integral(image), np.arange(n)
    area = lambda a, b, low, high: sums[at + b, high] - sums[at + a, high] - sums[at + b, low] + sums[at + a, low]
    out = np.zeros(n, np.uint32)
    for kind, low, height, width in FILTERS:
        if kind == 0:  # lower against higher pitch classes
            x, y = area(0, width, low, low + height // 2), area(0, width, low + height // 2, low + height)
        elif kind == 1:  # earlier against later frames
            x, y = area(0, width // 2, low, low + height), area(width // 2, width, low, low + height)
        else:  # the middle against both sides
            third = width // 4
            y = area(third, width - third, low, low + height)
            x = area(0, width, low, low + height) - y
        level = np.searchsorted(EDGES, np.log((1 + x) / (1 + y)))
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return out


def align(a: np.ndarray, b: np.ndarray, least: int = 4) -> tuple[int, float] | None:
    """Offset of ``b`` against ``a`` and the share of differing bits; None if no offset has ``least`` positions in common.

    Offsets are counted in a histogram; ties go to the smallest shift.
    """
    if not len(a) or not len(b):
        return None
    key = np.uint32(32 - LEADING)
    left, right = a >> key, b >> key
    order = np.argsort(left, kind="stable")
    first, last = np.searchsorted(left[order], right, "left"), np.searchsorted(left[order], right, "right")
    histogram = np.zeros(len(a) + len(b), np.int64)
    for j in np.flatnonzero(last > first).tolist():
        histogram[order[first[j] : last[j]] - j + len(b)] += 1
    if histogram.max() < least:
        return None
    offsets = np.flatnonzero(histogram == histogram.max()) - len(b)
    offset = int(offsets[np.lexsort((offsets, np.abs(offsets)))[0]])
    x, y = a[max(offset, 0) :], b[max(-offset, 0) :]
    n = min(len(x), len(y))
    return offset, float(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n))


def fingerprints(recordings: DataFrame, samples: Callable[[object], tuple[np.ndarray, int]], key: str, column: str) -> DataFrame:
    """``key``, n_frames int, ints binary (little-endian 32-bit) for each row.

    ``samples`` turns a value of the media column into samples and their rate.
    A null value, or one that it turns into fewer samples than a frame, has an
    empty fingerprint.  Repeated rows each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, ints = [], []
            for value in batch.column(1).to_pylist():
                image = chroma(*samples(value)) if value is not None else np.zeros((0, 12))
                frames.append(len(image))
                ints.append(pack(image).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.int32()), pa.array(ints, pa.binary())], names=[key, "n_frames", "ints"])

    kind = recordings.schema[key].dataType.simpleString()
    return recordings.select(key, column).mapInArrow(run, f"`{key}` {kind}, n_frames int, ints binary")


def align_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """All columns of ``pairs`` and offset int, bit_error double of two fingerprint columns; nulls where nothing aligns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda name: [None if x is None else np.frombuffer(x, "<u4") for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]  # noqa: B023, E731
            found = [align(a, b) if a is not None and b is not None else None for a, b in zip(read(left), read(right), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f and f[0] for f in found], pa.int32()), pa.array([f and f[1] for f in found], pa.float64())], names=[*batch.schema.names, "offset", "bit_error"])

    pairs = pairs.drop("offset", "bit_error")
    return pairs.mapInArrow(run, plus(pairs, offset="int", bit_error="double"))


def align_blocks(left: list[np.ndarray], right: list[np.ndarray], least: int = 4) -> list[tuple[int, int]]:
    """Places in ``left`` and ``right`` of all pairs that ``align``: those with ``least`` positions in common at some offset."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    if not sizes[0].sum() or not sizes[1].sum():
        return []
    key, starts = np.uint32(32 - LEADING), [np.cumsum(n) - n for n in sizes]
    codes = [np.concatenate(side) >> key for side in (left, right)]
    who = [np.repeat(np.arange(len(n)), n) for n in sizes]
    place = [np.arange(len(c)) - s[w] for c, s, w in zip(codes, starts, who, strict=True)]
    order = np.argsort(codes[0], kind="stable")
    first, last = np.searchsorted(codes[0][order], codes[1], "left"), np.searchsorted(codes[0][order], codes[1], "right")
    width = int(sizes[0].max() + sizes[1].max())
    ends = np.concatenate([[0], np.cumsum(last - first)])[np.concatenate([starts[1], [len(codes[1])]])]  # matches before each of ``right``
    found, start = [], 0
    while start < len(right):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + MATCHES, "right")) - 1)
        a, b = int(starts[1][start]), int(starts[1][end - 1] + sizes[1][end - 1])
        n = (last - first)[a:b]
        mine = np.repeat(np.arange(a, b), n)
        other = order[np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(len(mine))]
        pair = who[1][mine] * len(left) + who[0][other]
        keys = np.sort(pair * width + place[0][other] - place[1][mine] + int(sizes[1].max()))
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        found.append(np.unique(keys[new[np.diff(np.append(new, len(keys))) >= least]] // width))
        start = end
    return [(int(x) % len(left), int(x) // len(left)) for x in np.concatenate(found)]


def copies(made: DataFrame, key: str, is_query: Column) -> DataFrame:
    """A row for each fingerprint that isn't empty: ints, copy_of (the smallest ``key``), asks (the smallest of a query; null: none), n; written."""
    some = made.where(F.length("ints") > 0)
    return written(some.groupBy("ints").agg(F.min(key).alias("copy_of"), F.min(F.when(is_query, F.col(key))).alias("asks"), F.count("*").alias("n")), "distinct")


def align_queries(distinct: DataFrame) -> DataFrame:
    """asks, _h (SHA-256 of ``ints``) and aligned for each of the ``copies`` that asks and aligns with another one.

    ``aligned`` lists copy_of, offset and bit_error of all other fingerprints
    that align with it, wherever they stand.  A block of queries meets a block
    of all by the numbers of both, each pair in a row of its own, so the work
    is spread; it is that of the queries times that of the fingerprints.
    """
    size = F.length("ints")
    whole, asking = (max(1, -(-(x or 0) // BLOCK)) for x in distinct.agg(F.sum(size), F.sum(F.when(F.col("asks").isNotNull(), size))).first())

    def blocks(rows: DataFrame, n: int, name: str, other: int, across: str) -> DataFrame:
        """Blocks by number, each once for every block of the other side."""
        dealt = rows.groupBy(F.pmod(F.xxhash64("ints"), F.lit(n)).alias(name)).agg(F.collect_list(F.struct("copy_of", "asks", "ints")).alias(f"in_{name}"))
        return dealt.withColumn(across, F.explode(F.sequence(F.lit(0), F.lit(other - 1)).cast("array<long>")))

    pairs = blocks(distinct.where(F.col("asks").isNotNull()), asking, "i", whole, "j").join(blocks(distinct, whole, "j", asking, "i"), ["i", "j"])
    kind = distinct.schema["copy_of"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                mine, theirs = (batch.column(k)[row].as_py() for k in range(2))
                ints = [[np.frombuffer(x["ints"], "<u4") for x in side] for side in (mine, theirs)]
                out = []
                for a, b in align_blocks(*ints):
                    if mine[a]["ints"] != theirs[b]["ints"]:
                        out.append((mine[a]["asks"], hashlib.sha256(mine[a]["ints"]).hexdigest(), theirs[b]["copy_of"], *align(ints[0][a], ints[1][b])))
                id_type = batch.schema.field(0).type.value_type.field("copy_of").type
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (id_type, pa.string(), id_type, pa.int32(), pa.float64()), strict=True)], names=["asks", "_h", "copy_of", "offset", "bit_error"])

    found = pairs.select("in_i", "in_j").mapInArrow(run, f"asks {kind.simpleString()}, _h string, copy_of {kind.simpleString()}, offset int, bit_error double")
    return found.groupBy("asks", "_h").agg(F.sort_array(F.collect_list(F.struct("copy_of", "offset", "bit_error"))).alias("aligned"))


def with_copies(made: DataFrame, key: str, distinct: DataFrame) -> DataFrame:
    """``made`` and _h, copy_of; an empty fingerprint is nobody's copy.

    Fingerprints of a share ``HOT`` of the rows or more, 1 / ``HOT`` of them at
    most, are looked up from a broadcast; their rows and those of empty ones
    are spread by their keys in the join with the others.
    """
    total = distinct.agg(F.sum("n")).first()[0] or 0
    known = distinct.select(F.sha2("ints", 256).alias("_known"), F.col("copy_of").alias("_first"), "n")
    hot = known.where(F.col("n") >= HOT * total).select(F.col("_known").alias("_hot"), F.col("_first").alias("_hot_first"))
    rows = made.withColumn("_h", F.sha2("ints", 256)).join(F.broadcast(hot), F.col("_h") == F.col("_hot"), "left")
    spread = F.when(F.col("_hot").isNotNull() | (F.length("ints") == 0), F.concat(F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit("")))).otherwise(F.col("_h"))
    rows = rows.join(known.drop("n"), spread == F.col("_known"), "left")
    return rows.withColumn("copy_of", F.coalesce("_hot_first", "_first", key)).drop("_hot", "_hot_first", "_known", "_first")


def pcm16(value: bytes, rate: int = RATE) -> tuple[np.ndarray, int]:
    """Samples of little-endian 16-bit mono sound; an odd last byte is left out."""
    return np.frombuffer(value[: len(value) // 2 * 2], "<i2") / 32768.0, rate


#: Samples of a note when a vector is played.
NOTE = 1400


def played(vector: list[float | None]) -> tuple[np.ndarray, int]:
    """A vector as sound: a note for each component, higher for larger ones; not finite: silence."""
    x = np.array([math.nan if v is None else v for v in vector], float)
    fine = np.isfinite(x)
    semitone = np.clip(np.round(48 * np.where(fine, x, 0)), -36, 36)
    hertz = 440.0 * 2 ** (semitone / 12)
    phase = 2 * np.pi * np.repeat(hertz / RATE, NOTE).cumsum()
    return np.sin(phase) * np.repeat(fine, NOTE), RATE


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``embeddings``, played as sound; those of ids divisible by 20 aligned with all others, and each with its successor's.

    vec_id, n_frames, n_ints, fp_crc32, copy_of (the smallest id with the same
    fingerprint; an empty one is nobody's copy), next_id (vec_id + 1, null if
    there is none), offset, bit_error (both against next_id), aligned.

    ``aligned`` lists copy_of, offset and bit_error of every other fingerprint
    of the table that aligns with this one; it stands at the smallest id
    divisible by 20 of each fingerprint, empty if none aligns, and is null at
    all other rows: copies share copy_of, so their list is found by it.
    """
    made = written(fingerprints(table(spark, sf_dir, "embeddings"), played, "vec_id", "embedding"), "fingerprints")
    distinct = copies(made, "vec_id", F.col("vec_id") % 20 == 0)
    lists = align_queries(distinct).withColumnsRenamed({"_h": "_asked", "asks": "_asks"})
    asking = distinct.where(F.col("asks").isNotNull()).select("asks", F.sha2("ints", 256).alias("_h"))
    lists = asking.join(lists, (F.col("asks") == F.col("_asks")) & (F.col("_h") == F.col("_asked")), "left").select(F.col("asks").alias("_asks"), F.col("_h").alias("_asked"), F.coalesce("aligned", F.array().cast(lists.schema["aligned"].dataType)).alias("aligned"))
    after = made.groupBy((F.col("vec_id") - 1).alias("_before")).agg(F.min("ints").alias("next"))
    rows = with_copies(made, "vec_id", distinct).join(after, F.col("vec_id") == F.col("_before"), "left")
    rows = rows.join(lists, (F.col("vec_id") == F.col("_asks")) & (F.col("_h") == F.col("_asked")), "left")
    done = align_pairs(rows.drop("_before", "_h", "_asks", "_asked"), "ints", "next")
    return done.select(
        "vec_id", "n_frames", F.floor(F.length("ints") / 4).cast("int").alias("n_ints"), F.crc32("ints").alias("fp_crc32"), "copy_of",
        F.when(F.col("next").isNotNull(), F.col("vec_id") + 1).alias("next_id"), "offset", "bit_error", "aligned",
    )
