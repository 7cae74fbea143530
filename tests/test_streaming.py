from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tidemark.streaming.sinks import LatestProcessor, append_sink, latest_stream

SCHEMA = "uid long, ts_ms long, seq long, value double"
ROWS = [(1, 10, 1, 1.0), (1, 30, 2, 3.0), (2, 5, 3, 9.0), (1, 20, 4, 2.0)]


@pytest.fixture
def stream(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_append_sink(store, stream, tmp_path):
    store.register_schema(1, 1, T.StructType.fromDDL("value double"))
    rows = stream.selectExpr("uid", "ts_ms as __timestamp", "seq as __place", "value")
    run(append_sink(rows, store, 1, 1, str(tmp_path / "cp")))
    assert sorted(map(tuple, store.latest(1, 1).collect())) == [(1, 3.0), (2, 9.0)]


def test_latest_stream(spark, stream, tmp_path):
    run(latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("latest_a").option("checkpointLocation", str(tmp_path / "cp")))
    assert sorted(map(tuple, spark.table("latest_a").collect())) == [(1, 30, 3.0), (2, 5, 9.0)]


def test_latest_processor(spark, stream, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = stream.groupBy("uid").transformWithStateInPandas(LatestProcessor(86_400_000), "uid long, ts_ms long, value double", "Update", "ProcessingTime")
    run(found.writeStream.outputMode("update").format("memory").queryName("latest_b").option("checkpointLocation", str(tmp_path / "cp")))
    assert sorted(map(tuple, spark.table("latest_b").collect())) == [(1, 30, 3.0), (2, 5, 9.0)]
