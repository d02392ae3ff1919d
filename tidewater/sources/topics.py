"""Tables as topics, stored logs, ledgers and deployments as sources; logs as sinks."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.schemas import RECORDS, TOPIC_DEFAULTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_attempts(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """The events table as attempts on a topic: users are producers and choose the partition."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("arrival_seq"),
        F.pmod("user_id", F.lit(partitions)).cast("int").alias("partition"),
        F.col("user_id").alias("producer_id"),
        F.col("event_id").alias("message_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("append_ms"),
        "event_type",
        "value",
        "props",
    )


def line_attempts(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """Order lines as attempts: orders are producers, line numbers their sequences, the ship
    date is when a line is due."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("arrival_seq"),
        F.pmod("l_orderkey", F.lit(partitions)).cast("int").alias("partition"),
        F.col("l_orderkey").alias("producer_id"),
        F.col("l_linenumber").cast("long").alias("sequence"),
        F.col("l_partkey").alias("message_id"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("due_ms"),
        F.col("l_quantity").cast("long").alias("bytes"),
    )


def order_attempts(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """Orders as attempts: customers are producers, the order's date is when it is due."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("arrival_seq"),
        F.pmod("o_custkey", F.lit(partitions)).cast("int").alias("partition"),
        F.col("o_custkey").alias("producer_id"),
        F.col("o_orderkey").alias("sequence"),
        (F.col("o_orderkey") % 2000).alias("message_id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("due_ms"),
        F.floor("o_totalprice").cast("long").alias("bytes"),
    )


def read_log(spark: SparkSession, path: str, partitions: list[int] | None = None) -> DataFrame:
    """A stored log; a choice of partitions reads only their folders."""
    log = spark.read.schema(RECORDS).parquet(path)
    return log.where(F.col("partition").isin(partitions)) if partitions is not None else log


def write_log(records: DataFrame, path: str, next_offset: dict[int, int] | None = None) -> None:
    """Appends records by partition, in order of offset within files.  ``next_offset`` is what
    the writer takes for the end of each partition: a log that has moved on is refused."""
    spark = records.sparkSession
    if next_offset is not None:
        try:
            ends = {r.partition: r.end for r in spark.read.schema(RECORDS).parquet(path).groupBy("partition").agg((F.max("offset") + 1).alias("end")).collect()}
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            ends = {}
        moved = {p: (n, ends.get(p, 0)) for p, n in next_offset.items() if ends.get(p, 0) != n}
        if moved:
            raise ValueError(f"the log has moved on: {moved}")
    records.sortWithinPartitions("partition", "offset").write.mode("append").partitionBy("partition").option("parquet.bloom.filter.enabled#message_id", "true").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger of benchmark runs, one JSON object a line."""
    return spark.read.schema("kind string, run_id string, `case` string, metric string, value double, failed boolean").json(path)


def read_deployment(text: str) -> list[dict[str, object]]:
    """The topics of a deployment in TOML with what each option comes to; unknown options are
    refused, as are topics that want both deduplication and delay."""
    known = {"partitions", "partitioner_seed", "segment_bytes", "producer_idle_secs", "retention", "deduplication", "delay", "brokers"}
    out = []
    for name, t in tomllib.loads(text).get("topics", {}).items():
        if unknown := set(t) - known:
            raise ValueError(f"topic {name}: unknown {sorted(unknown)}")
        if "deduplication" in t and "delay" in t:
            raise ValueError(f"topic {name}: deduplication and delay exclude each other")
        dedup, delay, kept = t.get("deduplication"), t.get("delay"), t.get("retention", {})
        out.append(
            {
                "topic": name,
                "partitions": t.get("partitions", TOPIC_DEFAULTS["partitions"]),
                "partitioner_seed": t.get("partitioner_seed", TOPIC_DEFAULTS["partitioner_seed"]),
                "segment_bytes": t.get("segment_bytes", TOPIC_DEFAULTS["segment_bytes"]),
                "producer_idle_s": t.get("producer_idle_secs", TOPIC_DEFAULTS["producer_idle_s"]),
                "max_age_ms": kept["max_age_secs"] * 1000 if "max_age_secs" in kept else None,
                "max_bytes": kept.get("max_bytes"),
                "dedup_window_ms": dedup.get("window_millis", TOPIC_DEFAULTS["dedup_window_ms"]) if dedup is not None else None,
                "delay_max_ms": delay["max_secs"] * 1000 if delay is not None else None,
            }
        )
    return out
