"""Streams into and out of a store.  These go beyond an embedded store's own abilities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.store import VersionedStore


def append_sink(stream: DataFrame, store: VersionedStore, table: int, version: int, checkpoint: str, order_by: tuple[str, ...] = ()) -> DataStreamWriter:
    """A writer that appends each micro-batch in one commit.

    Its number is recorded with the commit under the checkpoint's name, so a
    batch that is run again after a failure isn't appended again.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.append(table, version, batch, order_by=order_by, batch=(checkpoint, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_stream(frames: DataFrame, value: str = "value") -> DataFrame:
    """Extension: uid, ts_ms, ``value`` of each entity's latest frame so far, given anew whenever it changes.

    Built in: ``max_by`` over a streaming aggregate (output mode ``update``).
    """
    best = F.max_by(F.struct("ts_ms", value), F.struct("ts_ms", "seq"))
    return frames.groupBy("uid").agg(best.alias("b")).select("uid", "b.ts_ms", f"b.{value}")


class LatestProcessor(StatefulProcessor):
    """Keyed state: the latest (ts_ms, seq, value) of an entity, forgotten ``ttl_ms`` after its last change."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "ts_ms long, seq long, value double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.best.get()
        before = held
        for part in rows:
            top = part.sort_values(["ts_ms", "seq"]).iloc[-1]
            found = (int(top["ts_ms"]), int(top["seq"]), float(top["value"]))
            if held is None or found[:2] >= tuple(held)[:2]:
                held = found
        if held is not before:
            self.best.update(held)
            yield pd.DataFrame({"uid": [key[0]], "ts_ms": [held[0]], "value": [held[2]]})

    def close(self) -> None:
        pass
