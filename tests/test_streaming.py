"""Streaming forms give what the batch forms give, over several micro-batches."""

import pytest

from tidewater.operators import dedup
from tidewater.sources import topics
from tidewater.streaming import stateful
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(batches, transform, name):
        """Each batch of rows as a file, one file for each micro-batch."""
        for k, b in enumerate(batches):
            b.coalesce(1).write.parquet(f"{tmp_path}/{name}/in{k}")
        schema = batches[0].schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in*")
        q = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}/cp").trigger(availableNow=True).outputMode("append").start()
        assert q.awaitTermination(180)
        return spark.table(name).collect()

    return go


def test_dedup(spark, run):
    a = topics.event_attempts(spark, SF).select("arrival_seq", "partition", F.concat_ws("/", "producer_id", "event_type").alias("message_id"), "append_ms")
    timed = dedup.logical_time(a).select("partition", "message_id", "arrival_seq", "time")
    batches = [timed.where(f"arrival_seq between {k * 400} and {k * 400 + 399}") for k in range(3)]
    rows = run(batches, lambda s: stateful.deduplicate(s, 86_400_000), "dedup_out")
    want = {(r.arrival_seq, r.disposition) for r in dedup.classify(a, 86_400_000).collect()}
    assert {(r.arrival_seq, r.disposition) for r in rows} == want and len(rows) == len(want)


def test_release(spark, run):
    schema = "partition int, arrival_seq long, message_id string, append_ms long, due_ms long"
    first = spark.createDataFrame([(0, 0, "1", 1000, 5000), (0, 1, "2", 1000, 3000), (0, 2, "3", 1000, 900)], schema)
    more = [spark.createDataFrame([(0, 3, "4", 3000, 9000)], schema), spark.createDataFrame([(0, 4, "5", 6000, 6000)], schema)]
    rows = run([first, *more], stateful.release, "release_out")
    assert [(r.message_id, r.offset) for r in sorted(rows, key=lambda r: r.offset)] == [("3", 0), ("2", 1), ("1", 2), ("5", 3)]


def test_membership(spark, run):
    schema = "group_id string, member_id string, join_id string, kind string, seen_ms long, seq long"
    a = spark.createDataFrame([("g", "m", "1", "join", 0, 0), ("g", "n", "1", "join", 5, 1), ("g", "m", "1", "beat", 90, 2)], schema)
    b = spark.createDataFrame([("g", "m", "2", "join", 120, 3), ("g", "m", "1", "beat", 130, 4), ("g", "m", "2", "leave", 140, 5)], schema)
    rows = run([a, b], lambda s: stateful.membership(s, 100), "member_out")
    assert [(r.member_id, r.join_id, r.state) for r in rows] == [("m", "1", "joined"), ("n", "1", "joined"), ("n", "1", "expired"), ("m", "2", "replaced"), ("m", "1", "fenced"), ("m", "2", "left")]
