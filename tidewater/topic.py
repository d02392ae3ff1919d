"""A topic as one object: send, read, checkpoint.

Records and receipts are Parquet tables under one folder, by partition.  A send is one batch:
records are routed, checked against each other and earlier receipts (a repeated attempt gets
its first receipt again, one with other content is refused), checked for their sequence,
deduplicated if the topic wants it, given offsets and stored, then their receipts.  A writer
that stops in between leaves records without receipts: the next send answers for them from
the records.  One writer at a time appends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import append, dedup, reading, routing
from tidewater.schemas import RECORDS, Error

RECEIPT_COLUMNS = "partition int, producer_id string, producer_epoch bigint, sequence bigint, message_id string, disposition string, offset bigint, fingerprint string"
RETRY = ["partition", "producer_id", "producer_epoch", "sequence"]
#: Stands before every arrival of a batch: what was stored earlier came first.
_EARLIER = dedup.EARLIER


@dataclass
class Topic:
    spark: SparkSession
    path: str
    partitions: int
    seed: int = 0
    dedup_window_ms: int | None = None

    def _table(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return empty

    def records(self) -> DataFrame:
        return self._table("records", RECORDS)

    def receipts(self) -> DataFrame:
        return self._table("receipts", RECEIPT_COLUMNS)

    def ends(self) -> DataFrame:
        every = self.spark.range(self.partitions).select(F.col("id").cast("int").alias("partition"))
        known = self.records().groupBy("partition").agg((F.max("offset") + 1).alias("_end"))
        return every.join(known, "partition", "left").select("partition", F.lit(0).cast("long").alias("retained_from"), F.coalesce("_end", F.lit(0)).cast("long").alias("next_offset"))

    def _known(self) -> DataFrame:
        """What has been answered, and what has been stored without an answer: records past all
        offsets that receipts name."""
        receipts = self.receipts().select(*RETRY, "offset", "fingerprint")
        answered = receipts.groupBy("partition").agg(F.max("offset").alias("_answered"))
        beyond = self.records().join(answered, "partition", "left").where(F.col("offset") > F.coalesce("_answered", F.lit(-1)))
        return receipts.unionByName(beyond.select(*RETRY, "offset", append.fingerprint(F.col("message_id"), F.col("parts")).alias("fingerprint")))

    def send(self, attempts: DataFrame) -> DataFrame:
        """Receipts of ``attempts`` (arrival_seq, partition or null, key, message_id, producer_id,
        producer_epoch, sequence, parts, append_ms); ``error_code`` where one was refused."""
        batch = f"{self.path}/batches/{uuid.uuid4().hex}"

        def stored_as(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{batch}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{batch}/{name}")

        routed = attempts.withColumn("partition", F.coalesce("partition", routing.keyed_partition(F.col("key"), self.seed, self.partitions)))
        marked = stored_as(routed.withColumn("fingerprint", append.fingerprint(F.col("message_id"), F.col("parts"))), "attempts")
        # an attempt that comes twice in the batch: the first speaks for all
        first = marked.groupBy(*RETRY).agg(F.min("arrival_seq").alias("_first"))
        once = marked.join(first, RETRY).where("arrival_seq = _first").drop("_first")
        again = marked.join(first, RETRY).where("arrival_seq <> _first").drop("_first")
        none = self.spark.createDataFrame([], "partition int, producer_id string, result_floor long")
        known = stored_as(self._known(), "known")
        resolved = stored_as(append.resolve_retries(once, known, none), "resolved")
        sessions = known.groupBy("partition", "producer_id").agg(F.max(F.struct("producer_epoch", F.col("sequence") + 1)).alias("s")).select("partition", "producer_id", F.col("s.producer_epoch").alias("epoch"), F.col("s.col2").alias("next_sequence"))
        fresh = resolved.where("disposition = 'fresh'").drop("disposition", "offset", "error_code")
        checked = stored_as(append.validate(fresh, sessions, opens=True), "checked")
        placed = stored_as(self._placed(checked.where("error_code is null").drop("error_code")), "placed")
        stored = placed.where("disposition = 'stored'").withColumn("topic", F.lit(self.path))
        columns = [c.strip().split(" ")[0] for c in RECORDS.split(",")]
        stored.select(*columns).sortWithinPartitions("partition", "offset").write.mode("append").partitionBy("partition").parquet(f"{self.path}/records")
        own = [c.strip().split(" ")[0] for c in RECEIPT_COLUMNS.split(",")]
        placed.select(*own).write.mode("append").partitionBy("partition").parquet(f"{self.path}/receipts")
        refused = checked.where("error_code is not null").withColumns({"disposition": F.lit(None).cast("string"), "offset": F.lit(None).cast("long")})
        answers = placed.withColumn("error_code", F.lit(None).cast("int")).select(*own, "error_code").unionByName(refused.select(*own, "error_code")).unionByName(resolved.where("disposition is null or disposition = 'retry'").select(*own, "error_code"))
        told = answers.select(*RETRY, F.col("disposition").alias("_told"), F.col("offset").alias("_at"), F.col("fingerprint").alias("_of"), F.col("error_code").alias("_code"))
        same = F.col("fingerprint") == F.col("_of")
        repeats = again.join(told, RETRY).select(
            *(c for c in own if c not in ("disposition", "offset")),
            F.when(same & F.col("_code").isNull(), "retry").alias("disposition"),
            F.when(same, F.col("_at")).alias("offset"),
            F.when(same, F.col("_code")).otherwise(int(Error.RETRY_CONFLICT)).alias("error_code"),
        )
        return answers.unionByName(repeats)

    def _placed(self, fresh: DataFrame) -> DataFrame:
        ends = self.ends().select("partition", "next_offset")
        if self.dedup_window_ms is None:
            return append.assign_offsets(fresh, ends).withColumn("disposition", F.lit("stored"))
        new = fresh.select("partition", "message_id", "arrival_seq", "append_ms")
        # what may still be live: from the first record on whose time is inside the window of the newest
        log = self.records().select("partition", "message_id", "offset", "append_ms")
        newest = log.groupBy("partition").agg(F.max("append_ms").alias("_newest"))
        first = log.join(newest, "partition").where(F.col("append_ms") > F.col("_newest") - self.dedup_window_ms).groupBy("partition").agg(F.min("offset").alias("_first"))
        earlier = log.join(first, "partition").where("offset >= _first").select("partition", "message_id", (F.col("offset") - _EARLIER).alias("arrival_seq"), "append_ms")
        timed = dedup.logical_time(earlier.unionByName(new))
        held = dedup.anchors(timed, self.dedup_window_ms).where(F.col("arrival_seq") >= 0).select("partition", "arrival_seq", "anchor")
        stored = append.assign_offsets(held.where("anchor = arrival_seq").select("partition", "arrival_seq"), ends).select("partition", F.col("arrival_seq").alias("anchor"), F.col("offset").alias("_own"))
        marked = held.join(stored, ["partition", "anchor"], "left").select(
            "partition",
            "arrival_seq",
            F.when(F.col("anchor") == F.col("arrival_seq"), "stored").otherwise("duplicate").alias("disposition"),
            F.when(F.col("anchor") < 0, F.col("anchor") + _EARLIER).otherwise(F.col("_own")).alias("offset"),
        )
        return fresh.join(marked, ["partition", "arrival_seq"])

    def read(self, at_ms: int | None = None, checkpoint: DataFrame | None = None, partitions: list[int] | None = None) -> DataFrame:
        """Records from a time, a checkpoint or the beginning on; ordered only within partitions."""
        log, ends = self.records(), self.ends()
        if partitions is not None:
            log, ends = (reading.select_partitions(x, partitions, self.partitions) for x in (log, ends))
        if checkpoint is not None:
            starts = reading.start_checkpoint(ends, checkpoint)
        else:
            starts = reading.start_earliest(ends) if at_ms is None else reading.start_timestamp(log, ends, at_ms)
        return reading.replay(log, starts)

    def in_order(self, **start) -> Iterator[Row]:
        """Records as ``read`` gives them, partition by partition in order of offset, one at a time."""
        return self.read(**start).orderBy("partition", "offset").toLocalIterator()

    def statistics(self) -> DataFrame:
        """Per partition what receipts say: records by disposition, and the last offset."""
        return append.writer_stats(self.receipts().withColumn("error_code", F.lit(None).cast("int")))

    def checkpoint(self, delivered: DataFrame) -> DataFrame:
        """Where to go on after ``delivered``; partitions without deliveries stay at the floor."""
        after = reading.checkpoint(delivered).withColumnRenamed("next_offset", "_next")
        return self.ends().join(after, "partition", "left").select("partition", F.coalesce("_next", "retained_from").alias("next_offset"))
