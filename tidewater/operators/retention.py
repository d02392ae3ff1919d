"""Retention, trimming, packing, reserves and snapshots of segments.

Segments (``partition, id, capacity, sealed, last_operation, record_end,
newest_append_ms``) are few for each partition: a window over a partition's segments is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import telemetry
from tidewater.operators import ordering
from tidewater.schemas import Error


def invalid_segments(segments: DataFrame) -> DataFrame:
    """Segments that break a rule: only the last is unsealed, ids rise, operations and record
    ends don't fall, capacities are positive."""
    w = Window.partitionBy("partition").orderBy("id")
    last = F.lead("id").over(w).isNull()
    bad = (F.col("capacity") <= 0) | (F.col("sealed") == last) | (F.col("last_operation") < F.lag("last_operation").over(w)) | (F.col("record_end") < F.lag("record_end").over(w)) | F.coalesce(F.col("id") == F.lag("id").over(w), F.lit(False))
    return segments.withColumn("_bad", F.coalesce(bad, F.lit(False))).where("_bad").drop("_bad")


def plan(segments: DataFrame, policies: DataFrame, now_ms: int | None) -> DataFrame:
    """What to retire in each partition.

    ``policies``: partition, max_age_ms, max_bytes, committed_operation, held_operation,
    trimmed (null: none).  The sealed, committed prefix is walked while a segment is too
    much, too old or trimmed; a segment that still holds a scheduled record ends the walk and
    is to be carried."""
    w = Window.partitionBy("partition").orderBy("id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = segments.join(policies, "partition")
    total = F.sum("capacity").over(Window.partitionBy("partition"))
    s = s.withColumn("total", total).withColumn("selected", F.col("total") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    now = F.lit(now_ms).cast("long")
    aged = F.coalesce(F.when(F.col("max_age_ms").isNotNull() & now.isNotNull(), F.col("newest_append_ms").isNull() | (now - F.col("newest_append_ms") >= F.col("max_age_ms"))), F.lit(False))
    due = F.coalesce(F.col("selected") > F.col("max_bytes"), F.lit(False)) | aged | F.coalesce(F.col("record_end") <= F.col("trimmed"), F.lit(False))
    s = s.withColumn("aged", aged).withColumn("due", F.col("sealed") & (F.col("last_operation") <= F.col("committed_operation")) & due)
    s = s.withColumn("holds", F.coalesce(F.col("last_operation") >= F.col("held_operation"), F.lit(False)))
    # the first segment that ends the walk, kept or held
    stop = F.min(F.when(~F.col("due") | F.col("holds"), F.col("id"))).over(Window.partitionBy("partition"))
    s = s.withColumn("retired", F.coalesce(F.col("id") < stop, F.lit(True))).withColumn("carried", F.coalesce((F.col("id") == stop) & F.col("due") & F.col("holds"), F.lit(False)))
    active = ~F.col("sealed")
    return s.groupBy("partition").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("retired"), F.col("id")))).cast("array<string>"), ",").alias("retire"),
        F.coalesce(F.max(F.when(F.col("retired"), F.col("record_end"))), F.lit(0)).alias("record_floor"),
        F.coalesce(F.max(F.when(F.col("retired"), F.col("last_operation"))) + 1, F.lit(0)).alias("operation_floor"),
        (F.max("total") - F.coalesce(F.sum(F.when(F.col("retired"), F.col("capacity"))), F.lit(0))).alias("selected_bytes"),
        F.coalesce(F.max(active & F.col("newest_append_ms").isNotNull() & F.col("aged") & (F.col("last_operation") <= F.col("committed_operation"))), F.lit(False)).alias("roll_active"),
        F.max(F.when(F.col("carried"), F.col("last_operation") + 1)).alias("carry_end"),
        F.max(F.when(F.col("carried"), F.col("aged"))).alias("carry_expired"),
    )


def rolled(log: DataFrame, capacity: int) -> DataFrame:
    """Adds ``segment``: records (of ``bytes``) go into a segment while they fit; a larger one has a
    segment of its own."""

    def step(state, size):
        number, used = state
        if used and used + size > capacity:
            number, used = number + 1, 0
        return (number, used + size), (number,)

    return ordering.folded(log, ["partition"], ["offset"], ["bytes"], lambda size: (0, 0), step, "segment long")


def turn(log: DataFrame, segments: DataFrame, policies: DataFrame, now_ms: int | None) -> DataFrame:
    """The log after one turn of retention: without the records of the segments that are retired."""
    floors = plan(segments, policies, now_ms).select("partition", "record_floor")
    return log.join(floors, "partition", "left").where(F.col("offset") >= F.coalesce("record_floor", F.lit(0))).drop("record_floor")


def snapshot_digest(state: DataFrame, columns: list[str]) -> DataFrame:
    """One row that a snapshot is stored with: how many rows it has, and their digest."""
    return state.agg(F.count("*").alias("rows"), telemetry.digest(*columns).alias("digest"))


def verified(snapshot: DataFrame, columns: list[str], stored: DataFrame) -> DataFrame:
    """A snapshot that was read back, if count and digest are as stored, else an error."""
    if snapshot_digest(snapshot, columns).first() != stored.first():
        raise ValueError("the snapshot isn't what was stored")
    return snapshot


def trim(partitions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (``partition, expected_record_floor, expected_operation_floor, record_floor,
    operation_floor``): both floors must be as expected, one advances, none goes back or past
    what producers may still ask for (``result_floor``)."""
    joined = partitions.join(requests, "partition")
    fits = (F.col("retained_from") == F.col("expected_record_floor")) & (F.col("retained_operation") == F.col("expected_operation_floor"))
    forward = (F.col("record_floor") >= F.col("retained_from")) & (F.col("operation_floor") >= F.col("retained_operation")) & ((F.col("record_floor") > F.col("retained_from")) | (F.col("operation_floor") > F.col("retained_operation")))
    code = F.when(~fits, int(Error.STALE_AUTHORITY)).when(~forward | (F.col("record_floor") > F.col("result_floor")), int(Error.INVALID_SEQUENCE))
    return joined.select("partition", F.when(code.isNull(), F.col("record_floor")).otherwise(F.col("retained_from")).alias("retained_from"), F.when(code.isNull(), F.col("operation_floor")).otherwise(F.col("retained_operation")).alias("retained_operation"), code.alias("error_code"))


def best_run(segments: DataFrame, capacity: int, header: int = 0) -> DataFrame:
    """For each partition the adjacent sealed segments to pack into one: those that free most
    segments for each byte rewritten, if they fit one segment and free at least what they
    rewrite; of equals the first.  Ratios are compared exactly, as products of decimals.
    Runs start at each segment and grow only while they fit, as the equi-join on numbered
    neighbours below bounds them by how many live bytes fit."""
    w = Window.partitionBy("partition").orderBy("id")
    s = segments.where("sealed").withColumn("n", F.row_number().over(w)).withColumn("end_bytes", F.sum("live_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    room = capacity - header
    # for each start the runs that fit: a window over the following segments, by bytes
    reach = Window.partitionBy("partition").orderBy("end_bytes").rangeBetween(0, room)
    # of ends with equal bytes only the last can be best, so a list holds no more than fit by their bytes
    last = F.coalesce(F.lead("end_bytes").over(w) != F.col("end_bytes"), F.lit(True))
    s = s.withColumn("end", F.when(last, F.struct("n", "id", "end_bytes")))
    runs = s.withColumn("start_bytes", F.col("end_bytes") - F.col("live_bytes")).withColumn("ends", F.collect_list("end").over(reach))
    each = runs.select("partition", F.col("n").alias("first_n"), F.col("id").alias("first_id"), "start_bytes", F.explode("ends").alias("e"))
    sized = each.select("partition", "first_n", "first_id", F.col("e.id").alias("last_id"), (F.col("e.n") - F.col("first_n")).alias("freed"), (F.col("e.end_bytes") - F.col("start_bytes")).alias("bytes"))
    fits = sized.where((F.col("freed") > 0) & (F.col("bytes") <= room) & (F.col("freed") * capacity >= F.col("bytes")))
    ratio = F.col("freed").cast("decimal(38,18)") / F.greatest("bytes", F.lit(1)).cast("decimal(20,0)")
    order = Window.partitionBy("partition").orderBy(F.desc(ratio), "first_n", "freed")
    return fits.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("partition", "first_id", "last_id", "freed", "bytes")


def room(usage: DataFrame) -> DataFrame:
    """What a partition (``partition, used_segments, limit_segments, held_segments``) may still
    take: records leave a sixteenth of the limit (at least 4 segments) and room to release
    all that is held, control operations a sixty-fourth (at least 2), releases only that,
    trims nothing."""
    control = F.greatest(F.floor(F.col("limit_segments") / 64), F.lit(2))
    records = F.greatest(F.floor(F.col("limit_segments") / 16), F.lit(4)) + F.col("held_segments")
    free = F.col("limit_segments") - F.col("used_segments")
    return usage.select("partition", (free > records).alias("records"), (free > control + F.col("held_segments")).alias("control"), (free > control).alias("release"), F.lit(True).alias("trim"))


def summaries(log: DataFrame, segment_of) -> DataFrame:
    """Segments as their records make them: end, newest time, last operation."""
    return log.withColumn("id", segment_of).groupBy("partition", "id").agg((F.max("offset") + 1).alias("record_end"), F.max("append_ms").alias("newest_append_ms"), F.max("operation").alias("last_operation"), F.sum("bytes").alias("bytes"))


def unselected(objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored objects that the manifest doesn't name."""
    return objects.join(manifest, ["partition", "id"], "left_anti")


def recovered(snapshot: DataFrame, suffix: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A snapshot with later operations applied: the newest row of each key."""
    both = snapshot.unionByName(suffix)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*keys, "_s.*")
