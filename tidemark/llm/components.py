"""Connected components over a table of links, in rounds of two star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for each node that ``links`` (u, v) name.

    Large star hangs the larger neighbours of a node to the smallest node that
    it sees; small star does so with the smaller ones.  The two alternate until
    every node hangs to its root; the number of rounds grows with the logarithm
    of the number of nodes.  Each round is a few joins on keys and its edges
    are written to shared storage; nothing but a count comes to the driver.
    Nodes can be of any type that has an order.  The result reads a stored
    table, which ``drop_written`` deletes.
    """
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        drop_written(large)
        drop_written(edges)
        edges, before = new, state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._written_to = edges._written_to
    return out
