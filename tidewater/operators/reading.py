"""Reading a log: where to start, replay, bounds, checkpoints, live merge.

A log is ``partition, offset, message_id, append_ms, ...``; ``ends`` has for each
partition ``retained_from`` and ``next_offset``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import ordering
from tidewater.schemas import Error


def ends_of(log: DataFrame, retained_from: int = 0) -> DataFrame:
    return log.groupBy("partition").agg(F.lit(retained_from).cast("long").alias("retained_from"), (F.max("offset") + 1).alias("next_offset"))


def start_earliest(ends: DataFrame) -> DataFrame:
    return ends.select("partition", F.col("retained_from").alias("start"))


def start_latest(ends: DataFrame) -> DataFrame:
    return ends.select("partition", F.col("next_offset").alias("start"))


def start_offset(ends: DataFrame, offset: int) -> DataFrame:
    """The same offset everywhere; below the floor is a gap, past the end an error."""
    code = F.when(F.col("retained_from") > offset, int(Error.RETENTION_GAP)).when(F.col("next_offset") < offset, int(Error.BEYOND_END))
    return ends.select("partition", F.when(code.isNull(), F.lit(offset).cast("long")).alias("start"), code.alias("error_code"))


def start_timestamp(log: DataFrame, ends: DataFrame, at_ms: int) -> DataFrame:
    """The lowest retained offset appended at ``at_ms`` or later (times may go back), else the end."""
    first = log.where(F.col("append_ms") >= at_ms).join(ends.select("partition", "retained_from"), "partition").where("offset >= retained_from").groupBy("partition").agg(F.min("offset").alias("first"))
    return ends.join(first, "partition", "left").select("partition", F.coalesce("first", "next_offset").alias("start"))


def start_record(log: DataFrame, ends: DataFrame, message_id, policy: str) -> DataFrame:
    """Where a record is: ``unique``, ``first`` or ``last`` of the retained ones with that
    identity.  None is error 19; several under ``unique`` are error 20, with both ends."""
    inside = log.where(F.col("message_id") == message_id).join(ends, "partition").where("offset >= retained_from and offset < next_offset")
    seen = inside.groupBy("partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    chosen = F.col("last_offset" if policy == "last" else "first_offset")
    code = F.when(F.col("first_offset").isNull(), int(Error.ID_MISSING))
    if policy == "unique":
        code = code.when(F.col("first_offset") != F.col("last_offset"), int(Error.ID_AMBIGUOUS))
    return ends.select("partition").join(seen, "partition", "left").select("partition", F.when(code.isNull(), chosen).alias("start"), "first_offset", "last_offset", code.alias("error_code"))


def start_checkpoint(ends: DataFrame, checkpoint: DataFrame, topic: str | None = None) -> DataFrame:
    """A checkpoint must name every partition read, of the ``topic`` if that is given, and nothing
    below the floor."""
    checkpoint = checkpoint if topic is None else checkpoint.where(F.col("topic") == topic)
    code = F.when(F.col("position").isNull(), int(Error.UNKNOWN_SUBSCRIPTION)).when(F.col("position") < F.col("retained_from"), int(Error.RETENTION_GAP)).when(F.col("position") > F.col("next_offset"), int(Error.BEYOND_END))
    joined = ends.join(checkpoint.select("partition", F.col("next_offset").alias("position")), "partition", "left")
    return joined.select("partition", F.when(code.isNull(), F.col("position")).alias("start"), code.alias("error_code"))


def select_partitions(df: DataFrame, partitions: list[int], count: int) -> DataFrame:
    """Rows of some partitions, which must be distinct and exist; prunes partitioned files."""
    if len(set(partitions)) != len(partitions) or any(not 0 <= p < count for p in partitions):
        raise ValueError(f"partitions {partitions} of {count}: error {int(Error.MALFORMED)}")
    return df.where(F.col("partition").isin(partitions))


def replay(log: DataFrame, starts: DataFrame) -> DataFrame:
    """The log from each partition's start on."""
    return log.join(starts.select("partition", "start"), "partition").where("offset >= start").drop("start")


def checkpoint(delivered: DataFrame) -> DataFrame:
    """The first undelivered offset of each partition."""
    return delivered.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))


def bounded(log: DataFrame, records: int, size: int) -> DataFrame:
    """From each partition whole records, in order, while neither bound is passed
    (``bytes`` holds a record's size); ``error_code`` 17 where the first alone is too large."""
    first = log.groupBy("partition").agg(F.min("offset").alias("_first"))
    # offsets are dense: what is past the first bound needs no sum
    near = log.join(first, "partition").where(F.col("offset") < F.col("_first") + records)
    summed = ordering.running(near, ["partition"], "offset", F.col("bytes").cast("long"), "_sum")
    alone = (F.col("offset") == F.col("_first")) & (F.col("bytes") > size)
    return summed.where((F.col("_sum") <= size) | alone).withColumn("error_code", F.when(alone, int(Error.RECORD_TOO_LARGE))).drop("_first", "_sum")


def merge_live(live: DataFrame, replayed: DataFrame, starts: DataFrame) -> DataFrame:
    """Live and replayed records as one delivery without gap or repeat: each offset once, from
    the start on, up to the first offset that neither has.  ``source`` says which gave it."""
    both = replayed.withColumn("source", F.lit("replay")).unionByName(live.withColumn("source", F.lit("live")))
    once = both.groupBy("partition", "offset").agg(F.max("source").alias("source"), F.first("message_id").alias("message_id"))
    ahead = once.join(starts.select("partition", "start"), "partition").where("offset >= start")
    placed = ordering.position(ahead, ["partition"], "offset", "_at")
    return placed.where("offset = start + _at").drop("_at", "start")


def delivery_stats(delivered: DataFrame) -> DataFrame:
    """Per partition how many records came live and by replay, and how many gaps they left."""
    gap = F.coalesce(F.col("offset") - F.col("_before") > 1, F.lit(False)).cast("int")
    marked = ordering.lagged(delivered, ["partition"], "offset", {"offset": "_before"}).withColumn("_gap", gap)
    return marked.groupBy("partition").agg(F.count_if(F.col("source") == "live").alias("live"), F.count_if(F.col("source") == "replay").alias("replayed"), F.sum("_gap").alias("gaps"))
