"""Operators on frames: which are visible, which is the latest, which have expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(frames: DataFrame) -> DataFrame:
    """Frames that no later PUT of their entity has replaced.

    The last PUT of each entity comes from an aggregate over two narrow columns
    of the PUT frames alone; frames meet it in a join, so entities without one
    cost no window.
    """
    puts = frames.where("__op = 'PUT'").groupBy(F.col("uid").alias("__u")).agg(F.max("__seq").alias("__put"))
    joined = frames.join(puts, F.col("uid") == F.col("__u"), "left")
    return joined.where(F.col("__put").isNull() | (F.col("__seq") >= F.col("__put"))).select(frames.columns)


def latest(frames: DataFrame, by: tuple[str, ...] = ("uid",)) -> DataFrame:
    """The valid frame with the greatest timestamp of each entity; ties go to the one that came last.

    Invalid frames are passed over.  The frame is kept as it is, also if it has
    no rows.  One shuffle on the entity, after a partial aggregate that leaves
    one frame of an entity in each task.
    """
    rest = [c for c in frames.columns if c not in by]
    best = frames.where("__ok").groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("__timestamp", "__seq")).alias("__best"))
    return best.select(*by, *(F.col(f"__best.`{c}`").alias(c) for c in rest)).select(frames.columns)


def latest_by_window(frames: DataFrame, by: tuple[str, ...] = ("uid",)) -> DataFrame:
    """As ``latest``, by ranks; the plainest form, which tests hold the other against."""
    order = Window.partitionBy(*by).orderBy(F.desc("__timestamp"), F.desc("__seq"))
    return frames.where("__ok").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def latest_rows(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """All rows that share the greatest ``order`` of their key: frames that are flat, and ties that all win.

    The greatest value comes from a hash aggregate over two columns and meets
    the rows in a join on key and value.
    """
    keyed = rows.withColumn("__order", order)
    top = keyed.groupBy(F.col(by).alias("__k")).agg(F.max("__order").alias("__top"))
    return keyed.join(top, (F.col(by) == F.col("__k")) & (F.col("__order") == F.col("__top")), "left_semi").drop("__order")


def live(frames: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Frames not older than ``ttl_ms``: an age of exactly that stays, and so do times to come.

    Written as a bound on the stored column, so that files are skipped by their
    statistics and no difference can overflow.
    """
    return frames.where(F.col("__timestamp") >= F.lit(max(now_ms - ttl_ms, -(1 << 63))))


def compacted(frames: DataFrame, now_ms: int, ttl_ms: int, uid_start: int | None = None, uid_end: int | None = None) -> DataFrame:
    """What compaction leaves: valid, visible frames that haven't expired.

    Entities outside of ``uid_start`` to ``uid_end`` (both inclusive) and
    entities without any valid frame stay as they are.
    """
    inside = F.lit(True)
    if uid_start is not None:
        inside &= F.col("uid") >= uid_start
    if uid_end is not None:
        inside &= F.col("uid") <= uid_end
    work = frames.where(inside)
    sound = work.where("__ok").select(F.col("uid").alias("__u")).distinct()
    kept = live(visible(work).where("__ok"), now_ms, ttl_ms)
    broken = work.join(sound, F.col("uid") == F.col("__u"), "left_anti")
    out = kept.unionByName(broken)
    return out if uid_start is None and uid_end is None else out.unionByName(frames.where(~inside))


def dead_keys(frames: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Entities none of whose frames is left by compaction."""
    return frames.where("__ok").groupBy("uid").agg(F.max("__timestamp").alias("last_ts")).where(F.col("last_ts") < now_ms - ttl_ms)


def frame_counts(frames: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """uid, n_frames, n_live: how many frames an entity has, and how many outlive compaction."""
    alive = F.sum((F.col("__timestamp") >= now_ms - ttl_ms).cast("long"))
    return frames.groupBy("uid").agg(F.count("*").alias("n_frames"), alive.alias("n_live"))


def ordered_by_key(frames: DataFrame) -> DataFrame:
    """Frames in the order of a scan: by entity, then by arrival."""
    return frames.orderBy("uid", "__seq")


def as_of(requests: DataFrame, frames: DataFrame, at: str = "at_ms") -> DataFrame:
    """Extension: for each request (uid, ``at``) the latest valid frame not after ``at``.

    Both sides go by entity in one shuffle, as one stream ordered by time in
    which each request takes the last frame before it; no pair is built, so a
    busy entity costs its own rows only.  Requests without such a frame get nulls.
    """
    rest = [c for c in frames.columns if c != "uid"]
    left = requests.withColumn("__t", F.col(at).cast("long")).withColumn("__kind", F.lit(1))
    right = frames.where("__ok").select("uid", F.col("__timestamp").alias("__t"), F.lit(0).alias("__kind"), F.struct(*rest).alias("__frame"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("uid").orderBy("__t", "__kind", F.col("__frame.__seq")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__frame", ignorenulls=True).over(order)).where("__kind = 1")
    return found.select(*requests.columns, *(F.col(f"__found.`{c}`").alias(c) for c in rest))
