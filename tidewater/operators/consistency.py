"""Checks of a history of operations.  Each returns the violations; a sound history has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import telemetry
from tidewater.operators import ordering

KEY = ["partition", "message_id"]
RETRY = ["partition", "producer_id", "producer_epoch", "sequence"]


def dedup_disposition(receipts: DataFrame) -> DataFrame:
    """An identity that more than one attempt stored."""
    stored = receipts.where("disposition = 'stored'").groupBy(*KEY).agg(F.count_distinct("producer_id", "producer_epoch", "sequence").alias("attempts"))
    return stored.where("attempts > 1")


def producer_order(receipts: DataFrame) -> DataFrame:
    """Stored receipts whose sequence rises while their offset doesn't."""
    w = Window.partitionBy("partition", "producer_id", "producer_epoch").orderBy("sequence")
    stored = receipts.where("disposition = 'stored'").withColumn("previous_offset", F.lag("offset").over(w))
    return stored.where("offset <= previous_offset").select(*RETRY, "offset", "previous_offset")


def wrong_receipts(receipts: DataFrame, requests: DataFrame, policy: str) -> DataFrame:
    """Receipts of another policy, identity or partition than was asked for."""
    asked = requests.select("request_id", F.col("message_id").alias("asked_id"), F.col("partition").alias("asked_partition"))
    wrong = (F.col("policy") != policy) | (F.col("message_id") != F.col("asked_id")) | (F.col("partition") != F.col("asked_partition"))
    return receipts.join(asked, "request_id").where(wrong)


def changed_retries(receipts: DataFrame) -> DataFrame:
    """One attempt with receipts that differ."""
    return receipts.groupBy(*RETRY).agg(F.count_distinct("offset", "message_id", "disposition").alias("answers")).where("answers > 1")


def conflicting_offsets(seen: DataFrame) -> DataFrame:
    """One place in the log with two values, as reads and receipts tell; only a duplicate's receipt
    doesn't say what is there (``attempt_only`` rows have a ``disposition``)."""
    told = seen.where(~(F.col("attempt_only") & F.col("disposition").eqNullSafe("duplicate")))
    return told.groupBy("partition", "offset").agg(F.count_distinct("message_id", "fingerprint").alias("values")).where(F.col("values") > 1)


def duplicate_storage(seen: DataFrame) -> DataFrame:
    """One identity at two places, by whatever row."""
    return seen.groupBy(*KEY).agg(F.count_distinct("offset").alias("places")).where("places > 1")


def wrong_dedup_targets(receipts: DataFrame, seen: DataFrame) -> DataFrame:
    """Duplicates that name a place where another identity is."""
    at = seen.where("not attempt_only").select("partition", "offset", F.col("message_id").alias("stored_id")).distinct()
    return receipts.where("disposition = 'duplicate'").join(at, ["partition", "offset"], "left").where(~F.col("message_id").eqNullSafe(F.col("stored_id")))


def reader_order(deliveries: DataFrame) -> DataFrame:
    """Deliveries of a session and partition whose offsets aren't 0, 1, 2, ..."""
    return ordering.position(deliveries, ["session", "partition"], "delivery_seq", "expected").where("offset <> expected")


def uninvoked(observed: DataFrame, invoked: DataFrame) -> DataFrame:
    """Records that nobody sent to their partition with that content."""
    return observed.join(invoked.select(*KEY, "fingerprint"), [*KEY, "fingerprint"], "left_anti")


def fenced_visible(observed: DataFrame, fenced: DataFrame) -> DataFrame:
    """Records of attempts on their partition that were refused as fenced."""
    return observed.join(fenced.select(*KEY), KEY, "left_semi")


def lost(acknowledged: DataFrame, observed: DataFrame, rounds: DataFrame) -> DataFrame:
    """For each final round the acknowledged records that it didn't read."""
    wanted = acknowledged.join(rounds, "partition")
    return wanted.join(observed.select("round", "partition", "message_id"), ["round", "partition", "message_id"], "left_anti").select("round", "partition", "message_id")


def missing_markers(markers: DataFrame, keys: DataFrame, rounds: list[str]) -> DataFrame:
    """For each final round the keys (``key``) that no completed marker was written to."""
    return keys.join(markers.select("key").distinct(), "key", "left_anti").withColumn("round", F.explode(F.array(*map(F.lit, rounds)))).select("round", "key")


def minority_confirmations(receipts: DataFrame, quorum: int = 2) -> DataFrame:
    return receipts.where(F.col("votes") < quorum)


def uncovered(writes: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys that no write touched."""
    return expected.join(writes.select("key").distinct(), "key", "left_anti")


def lane_errors(delivered: DataFrame, size: int) -> DataFrame:
    """Deliveries whose offset, lane sequence or size isn't what it must be."""
    placed = ordering.position(ordering.position(delivered, ["partition"], "delivery_seq", "_place"), ["lane"], "delivery_seq", "_turn")
    bad = (F.col("offset") != F.col("_place")) | (F.col("lane_sequence") != F.col("_turn")) | (F.col("bytes") != size)
    return placed.withColumn("_bad", bad).where("_bad").drop("_bad", "_place", "_turn")


def lane_mismatches(written: DataFrame, read: DataFrame) -> DataFrame:
    """Lanes of which readers haven't got exactly what writers confirmed: by count and digest of
    places and contents, in which every repeat tells."""
    side = lambda df, p: telemetry.lane_digests(df).select("lane", F.col("records").alias(f"{p}_records"), F.col("digest").alias(f"{p}_digest"))
    joined = side(written, "written").join(side(read, "read"), "lane", "full_outer")
    same = F.col("written_records").eqNullSafe(F.col("read_records")) & F.col("written_digest").eqNullSafe(F.col("read_digest"))
    return joined.where(~same).select("lane", "written_records", "read_records")


def unmatched_faults(faults: DataFrame) -> DataFrame:
    """Faults (``fault, seq, phase`` begin or end) whose n-th begin has no n-th end, or the reverse."""
    w = Window.partitionBy("fault", "phase").orderBy("seq")
    n = faults.withColumn("n", F.row_number().over(w))
    begun, ended = (n.where(F.col("phase") == p).select("fault", "n", F.col("seq").alias(f"{p}_seq")) for p in ("begin", "end"))
    return begun.join(ended, ["fault", "n"], "full_outer").where("begin_seq is null or end_seq is null or end_seq < begin_seq")
