"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets of about
``bucket_bytes`` by a seeded hash.  Pass two takes each bucket into memory,
brings it into a fixed order and permutes it by Fisher-Yates with a generator
seeded by the bucket.  Buckets stand one after the other, so the records have
one global order, each order as likely as any other, and shards are cut from
it: shard ``s`` of ``n`` over ``total`` records begins at ``ceil(s * total / n)``.
Counts of shards differ by one at most (the law ``rows``).

The hash covers the key, a hash of the text, and the record's number in its
input partition, so that copies, even whole repeated rows, spread like any
others and no bucket grows.  Input partitions are file splits: the same files
read with the same split sizes give the same shards, and a lost task is redone
alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import plus, table, written

#: Buckets whose counts are summed in one go when offsets are made.
_STRIDE = 4096


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A permutation of ``range(n)``: from the last place on, each place swaps with one drawn from those up to it."""
    draw = np.random.Generator(np.random.PCG64(seed))
    out = list(range(n))
    picks = draw.integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, j in zip(range(n - 1, 0, -1), picks, strict=False):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def shuffle(rows: DataFrame, seed: int, bucket_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``rows`` and ``_bucket``, ``_place``: where each record stands after both passes.

    Null keys and texts are records like any others.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(text), F.monotonically_increasing_id())
    scattered = rows.drop("_bucket", "_place").withColumn("_bucket", F.pmod(hashed, F.lit(buckets)))
    parts = max(1, min(buckets, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def permute(group: pa.Table) -> pa.Table:
        bucket = group["_bucket"][0].as_py()
        order = np.lexsort([_codes(group[text]), _codes(group[key])])  # however the records arrived
        order = order[fisher_yates(group.num_rows, (seed, bucket))]
        return group.take(pa.array(order)).append_column("_place", pa.array(np.arange(group.num_rows), pa.int64()))

    return scattered.repartition(parts, "_bucket").groupBy("_bucket").applyInArrow(permute, plus(scattered, _place="long"))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that sort as the values do, nulls last."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    order = pc.rank(values, sort_keys="ascending", null_placement="at_end", tiebreaker="dense")
    return order.to_numpy()


def offsets(places: DataFrame) -> DataFrame:
    """_bucket, _start: records in the buckets before; summed in two levels, so no task sorts all buckets."""
    counts = places.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_bucket") / _STRIDE))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_all"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return counts.join(blocks, "_block").select("_bucket", (F.col("_inside") + F.col("_base")).alias("_start"))


def shuffled(rows: DataFrame, seed: int, bucket_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shuffled records, written to shared storage once: all columns and ``_bucket``, ``_place``."""
    return written(shuffle(rows, seed, bucket_bytes, key, text), "shuffled")


def cut(done: DataFrame, shards: int, columns: list[Column | str]) -> DataFrame:
    """``columns`` of shuffled records and shard int, slot long; nothing but ``columns`` meets the offsets."""
    total = done.count()
    number = F.expr(f"cast((cast(_start + _place as decimal(20,0)) * {shards}) div {max(total, 1)} as int)")
    first = F.expr(f"cast((cast(shard as decimal(20,0)) * {total} + {shards - 1}) div {shards} as long)")
    placed = done.select(F.struct(*columns).alias("_row"), "_bucket", "_place").join(offsets(done), "_bucket").withColumn("shard", number)
    return placed.select("_row.*", "shard", (F.col("_start") + F.col("_place") - first).alias("slot"))


def shard(rows: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``rows`` and shard int, slot long (gapless from 0 in each shard).

    Columns with these names are replaced.  An empty table gives an empty one.
    """
    rows = rows.drop("shard", "slot")
    return cut(shuffled(rows, seed, bucket_bytes, key, text), shards, [x for x in rows.columns if x not in ("_bucket", "_place")])


def write_shards(rows: DataFrame, path: str, shards: int, **options) -> None:
    """Write each shard in slot order into a folder of its own: ``path/shard=0`` and so on."""
    done = shard(rows, shards, **options)
    done.repartitionByRange(4 * shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8 and its slot, by the law ``rows``.  Copies are records of their own, wherever they land."""
    done = shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=20)
    text = F.coalesce("text", F.lit(""))
    digests = ["doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    return cut(done, 8, digests).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
