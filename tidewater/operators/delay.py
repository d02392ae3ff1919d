"""Delayed delivery: schedule, release in due order, carry."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import ordering
from tidewater.schemas import Error

#: Milliseconds of release keys in a block.
HOUR = 3_600_000


def schedule(attempts: DataFrame, max_delay_ms: int) -> DataFrame:
    """Adds ``release_ms`` (due, but not before acceptance), ``error_code`` for a due time past
    the maximum, and ``schedule``, the number of an accepted record in order of arrival."""
    late = F.col("due_ms") > F.col("append_ms") + max_delay_ms
    checked = attempts.withColumns({"release_ms": F.greatest("due_ms", "append_ms"), "error_code": F.when(late, int(Error.DUE_TOO_LATE))})
    accepted = ordering.position(checked.where("error_code is null"), ["partition"], "arrival_seq", "schedule")
    return accepted.unionByName(checked.where("error_code is not null"), allowMissingColumns=True)


def schedule_within(attempts: DataFrame, max_delay_ms: int, max_held: int) -> DataFrame:
    """Adds ``error_code`` to attempts in order of arrival: a due time past the maximum, or no room:
    those accepted and not yet released by the partition's time, which append times carry on,
    are ``max_held`` at most.  A refusal changes nothing; the state is bounded by ``max_held``."""

    def step(state, append, due):
        held, now = state
        now = max(now, append)
        if due > append + max_delay_ms:
            return state, (int(Error.DUE_TOO_LATE),)
        while held and held[0] <= now:
            heappop(held)
        if len(held) >= max_held:
            return (held, now), (int(Error.CAPACITY),)
        heappush(held, max(due, append))
        return (held, now), (None,)

    return ordering.folded(attempts, ["partition"], ["arrival_seq"], ["append_ms", "due_ms"], lambda append, due: ([], append), step, "error_code int")


def due_prefix(held: DataFrame, now_ms: int, most: int) -> DataFrame:
    """What one step releases: of each partition the first ``most`` due records in order of release key."""
    due = ordering.position(held.where(F.col("release_ms") <= now_ms), ["partition"], ["release_ms", "schedule"], "place", HOUR)
    return due.where(F.col("place") < most)


def release(held: DataFrame, now_ms: int, next_offsets: DataFrame | None = None) -> DataFrame:
    """The records due at ``now_ms`` in order of release key, with offsets."""
    due = held.where(F.col("release_ms") <= now_ms)
    out = ordering.position(due, ["partition"], ["release_ms", "schedule"], "offset", HOUR)
    if next_offsets is None:
        return out
    return out.join(next_offsets, "partition", "left").withColumn("offset", F.col("offset") + F.coalesce("next_offset", F.lit(0))).drop("next_offset")


def merged_log(immediate: DataFrame, released: DataFrame) -> DataFrame:
    """One log of immediate (``partition, arrival_seq, append_ms, message_id``) and released
    records (``partition, schedule, release_ms, message_id``): by effective time; at the same
    millisecond released records come first, each kind in its own order."""
    both = immediate.select("partition", F.col("append_ms").alias("effective_ms"), F.lit(1).alias("class"), F.col("arrival_seq").alias("seq"), "message_id").unionByName(
        released.select("partition", F.col("release_ms").alias("effective_ms"), F.lit(0).alias("class"), F.col("schedule").alias("seq"), "message_id")
    )
    return ordering.position(both, ["partition"], ["effective_ms", "class", "seq"], "offset", HOUR)


def still_held(held: DataFrame, now_ms: int) -> DataFrame:
    return held.where(F.col("release_ms") > now_ms)


def held_totals(held: DataFrame) -> DataFrame:
    return held.groupBy("partition").agg(F.count("*").alias("held_records"), F.sum("bytes").alias("held_bytes"), F.min("release_ms").alias("next_release_ms"))


def carry(held: DataFrame, end_operation: int) -> DataFrame:
    """Held records of operations below ``end_operation``, which are to be written anew with
    their keys unchanged."""
    return held.where(F.col("operation") < end_operation)


def lateness(delivered: DataFrame) -> DataFrame:
    """How long after it was due each record was delivered, and whether it came early."""
    return delivered.withColumn("late_ms", F.col("delivered_ms") - F.col("due_ms"))


def early(delivered: DataFrame, tolerance_ms: int) -> DataFrame:
    """Violations: delivered more than the tolerance before they were due."""
    return delivered.where(F.col("delivered_ms") + tolerance_ms < F.col("due_ms"))
