"""Exact top-k inner products by norm-bucketed retrieval.

Vectors stand in buckets by falling length (Euclidean norm), each a block of
bounded size with its vectors' directions.  A task takes a block of queries
through a run of buckets, longest vectors first, and keeps the k best of each
query and so a lower bound.  In a bucket whose longest vector has length l, only
candidates whose cosine with query q is at least bound / (|q| * l) can matter:

* above 1 the query skips the bucket and all after it;
* if it is high, coordinate pruning: a unit vector that near to q's direction
  has each coordinate within an interval about q's; the query's largest
  coordinates are tested;
* if it is low, length pruning: candidates with |q| * length below the bound
  are passed over; they are the end of the bucket, as it is sorted.

The candidates left are verified by integer inner products.  Bounds are taken
a little wide for rounding, so no candidate is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Vectors in a bucket and queries in a block, at most.
BUCKET, QUERIES = 2048, 512
#: Buckets that one task takes blocks of queries through, in order, and how many blocks about.
RUN, GROUP = 8, 8
#: Local cosine threshold from which coordinates are tested, and how many of them.
STEEP, FOCUS = 0.5, 3
_EXACT = float(1 << 53)


def integers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``key`` and floor(scale * x) of each component as ``v``; rows with a null vector or a null or non-finite component go."""
    x = F.col(vector)
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return vectors.where(whole).select(F.col(key).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Rows as one integer matrix; shorter vectors count as ending in zeros."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Partitions as rows of ``size`` vectors: longest, ids, dims, data, and run: the partition and every ``RUN`` rows of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                matrix = _matrix([x.values.to_numpy(zero_copy_only=False) for x in part.column(1)])
                run_ = TaskContext.get().partitionId() << 32 | number // RUN
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([run_]), pa.array([float(part.column(2)[0].as_py())]), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.astype("<i8").tobytes()], pa.binary())], names=["run", "longest", "ids", "dims", "data"])

    return rows.mapInArrow(run, "run long, longest double, ids binary, dims int, data binary")


def _read(block: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(block["ids"], "<i8")
    return ids, np.frombuffer(block["data"], "<i8").reshape(len(ids), block["dims"])


def _widened(a: np.ndarray, dims: int) -> np.ndarray:
    return a if a.shape[1] == dims else np.concatenate([a, np.zeros((len(a), dims - a.shape[1]), a.dtype)], axis=1)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point only where it is exact."""
    reach = np.sqrt((queries.astype(float) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((candidates.astype(float) ** 2).sum(axis=1).max(initial=0))
    if reach < _EXACT:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    if reach < float(1 << 62):
        return queries @ candidates.T
    exact = queries.astype(object) @ candidates.astype(object).T
    return exact.astype(np.int64)  # raises if a product doesn't fit a long


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """``products``, of which those that no long holds count as the greatest or the least long."""
    try:
        return products(queries, candidates)
    except OverflowError:
        exact, longs = queries.astype(object) @ candidates.astype(object).T, np.iinfo(np.int64)
        return np.minimum(np.maximum(exact, longs.min), longs.max).astype(np.int64)


class Best:
    """The k best candidates so far of each query: score falling, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros((n, k), bool)

    def bound(self) -> np.ndarray:
        """A score below this can't enter."""
        return np.where(self.full[:, -1], self.score[:, -1].astype(float), -np.inf)

    def add(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[keep], ids[keep]
        have = self.full[query]
        score, ids = np.concatenate([self.score[query][have], score]), np.concatenate([self.id[query][have], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[query, : len(order)], self.id[query, : len(order)], self.full[query, : len(order)] = score[order], ids[order], True


def search(query_block: dict, buckets: list[dict], k: int, bounds: np.ndarray | None = None) -> Best:
    """A block of queries through buckets by falling length.  ``bounds``: known lower bounds of the queries' k-th scores."""
    query_ids, queries = _read(query_block)
    lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    units = queries / np.maximum(lengths, 1e-300)[:, None]
    best = Best(len(query_ids), k)
    floor = np.full(len(query_ids), -np.inf) if bounds is None else bounds
    for bucket in buckets:
        ids, vectors = _read(bucket)
        dims = max(queries.shape[1], vectors.shape[1])
        q, c, u = _widened(queries, dims), _widened(vectors, dims), _widened(units, dims)
        sizes = np.sqrt((c.astype(float) ** 2).sum(axis=1))
        directions = c / np.maximum(sizes, 1e-300)[:, None]
        slack = 1e-9 * (1 + lengths * sizes[0])
        need = np.maximum(best.bound(), floor) - slack
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(lengths * sizes[0] > 0, need / (lengths * sizes[0]), np.where(need > 0, 2.0, -1.0))
        active = np.flatnonzero(local <= 1)
        flat = active[local[active] < STEEP]
        if len(flat):  # length pruning; the queries of a block share one product over the longest run that any needs
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where((need[flat] > 0) & (lengths[flat] > 0), need[flat] / np.maximum(lengths[flat], 1e-300), -1.0)
            last = np.searchsorted(-sizes, -least, "right")
            found = scores(q[flat], c[: last.max(initial=0)])
            for row, i in enumerate(flat.tolist()):
                score = found[row, : last[row]]
                fine = np.flatnonzero((score >= need[i]) & (ids[: last[row]] != query_ids[i]))
                best.add(i, score[fine], ids[fine])
        for i in active[local[active] >= STEEP].tolist():  # coordinate pruning
            t = min(local[i], 1.0)
            fine = lengths[i] * sizes >= need[i]
            for f in np.argsort(-np.abs(u[i]))[:FOCUS].tolist():
                around, away = u[i, f] * t, math.sqrt(max(0.0, (1 - u[i, f] ** 2) * (1 - t * t)))
                low = -1.0 if u[i, f] <= -t else around - away
                high = 1.0 if u[i, f] >= t else around + away
                fine &= (directions[:, f] >= low - 1e-9) & (directions[:, f] <= high + 1e-9)
            fine = np.flatnonzero(fine & (ids != query_ids[i]))
            if len(fine):
                score = scores(q[i : i + 1], c[fine])[0]
                keep = score >= need[i]
                best.add(i, score[keep], ids[fine][keep])
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank int (from 1), ``key``, score long: the k best candidates of each query, its own row left out.

    All vectors are candidates.  Vectors that are null or hold a null or
    non-finite component take no part.  Vectors of different dimensions meet
    as if the shorter ended in zeros.  Rows with a null id take no part.  Rows
    with the query's own id aren't its candidates; other repeated candidates
    each count.  A query id that occurs more than once asks with the first of
    its vectors in order.  A component or score that no long holds counts as the
    greatest or the least long, and ties among those go to the smaller id.

    Groups of about ``GROUP`` blocks of queries meet runs of buckets by a join
    on the run's number: a block goes to the runs that one of its queries can
    gain from, a run is copied once for each group that asks for it.  First all queries go through the first run, the longest
    vectors, which gives each a bound.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull()).withColumn("_query", is_query)
    ints = written(integers(rows, key, vector, scale).withColumn("length", _length(F.col("v"))), "integers")
    n = ints.count()
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score long")
    asked = integers(rows.where("_query"), key, vector, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("length", _length(F.col("v")))
    # Buckets: ranges of length, sorted; equal lengths are dealt out by a hash, so that they spread over partitions.
    deal = F.xxhash64("id")
    ranged = ints.repartitionByRange(-(-n // (BUCKET * RUN)), F.desc("length"), deal).sortWithinPartitions(F.desc("length"), deal)
    buckets = written(_blocks(ranged, BUCKET), "buckets")
    queries = _blocks(asked.repartition(max(1, n // (BUCKET * RUN)), deal), QUERIES).drop("run")
    queries = written(queries.withColumn("block", F.xxhash64("ids")), "queries")
    groups = -(-queries.count() // GROUP)

    def through(first: bool):
        def run(group: pa.Table, other: pa.Table) -> pa.Table:
            mine = sorted(other.to_pylist(), key=lambda b: -b["longest"])
            out: dict[str, list] = {"query_id": [], "score": [], "id": []}
            for block in group.to_pylist():
                bounds = None if first else np.frombuffer(block["bounds"], "<f8")
                best = search(block, mine, k, bounds)
                for i, query in enumerate(_read(block)[0].tolist()):
                    for j in np.flatnonzero(best.full[i]).tolist():
                        out["query_id"].append(query)
                        out["score"].append(int(best.score[i, j]))
                        out["id"].append(int(best.id[i, j]))
            return pa.table({name: pa.array(v, pa.int64()) for name, v in out.items()})

        return run

    return _joined(queries, buckets, k, key, through, max(1, groups))


def _joined(queries: DataFrame, buckets: DataFrame, k: int, key: str, through, groups: int) -> DataFrame:
    found = "query_id long, score long, id long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    longest = F.lit(buckets.orderBy(F.desc("longest"), "run").first()["run"])
    first = written(_cogrouped(queries.withColumn("run", longest), buckets.where(F.col("run") == longest), through(True), found, groups), "first")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", "score")
    bounded = written(_with_bounds(queries, kth), "bounded")
    # A block goes only to the runs that one of its queries can still gain from.
    reach = buckets.where(F.col("run") != longest).groupBy("run").agg(F.max("longest").alias("reach"))
    spread = bounded.join(reach, F.col("least") <= F.col("reach"))
    out = first.unionByName(_cogrouped(spread.drop("reach"), buckets, through(False), found, groups))
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _cogrouped(queries: DataFrame, buckets: DataFrame, run, schema: str, groups: int) -> DataFrame:
    """Each group of query blocks with each run of buckets, a task's memory holding one of both."""
    # The pair is the key: (run, group); buckets, the larger side, are copied once for each group that asks for them.
    asking = queries.withColumn("group", F.pmod("block", F.lit(groups)))
    wanted = asking.select(F.col("run").alias("_run"), F.col("group").alias("_group")).distinct()
    right = buckets.join(wanted, F.col("run") == F.col("_run")).select("_run", "_group", "longest", "ids", "dims", "data")
    return asking.groupBy("run", "group").cogroup(right.groupBy("_run", "_group")).applyInArrow(run, schema)


def _with_bounds(queries: DataFrame, kth: DataFrame) -> DataFrame:
    """Query blocks with each query's lower bound, and the least length of a candidate that could pass one of them."""
    ids = queries.select(F.col("block").alias("_block"), "ids")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(np.arange(len(own)), pa.int64()), pa.array(own)], names=["_block", "place", "query_id"])

    known = ids.mapInArrow(split, "_block long, place long, query_id long").join(kth, "query_id", "left")

    def join(group: pa.Table, other: pa.Table) -> pa.Table:
        out = []
        for block in group.to_pylist():
            _, vectors = _read(block)
            bounds = np.full(len(vectors), -np.inf)
            for place, score in zip(other["place"].to_pylist(), other["score"].to_pylist(), strict=True):
                bounds[place] = -np.inf if score is None else float(score)
            lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(bounds <= 0, -1.0, np.where(lengths > 0, bounds / lengths, np.inf))
            out.append(block | {"bounds": bounds.astype("<f8").tobytes(), "least": float(least.min()) * (1 - 1e-9)})
        return pa.Table.from_pylist(out, schema=pa.schema([("longest", pa.float64()), ("ids", pa.binary()), ("dims", pa.int32()), ("data", pa.binary()), ("block", pa.int64()), ("bounds", pa.binary()), ("least", pa.float64())]))

    return queries.groupBy("block").cogroup(known.groupBy("_block")).applyInArrow(join, "longest double, ids binary, dims int, data binary, block long, bounds binary, least double")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by 50, the 5 best of all other vectors by integer inner product."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
