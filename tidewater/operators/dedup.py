"""First-wins deduplication inside a window that is anchored at the stored record.

The first attempt of an identity is stored.  Repeats less than the window after it are
duplicates of it and do not extend the window; the first repeat at or past the window is
stored and anchors the next.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.operators import ordering
from tidewater.schemas import Error
from tidewater.storage import written


def logical_time(attempts: DataFrame, block: int = ordering.BLOCK) -> DataFrame:
    """Adds ``time``: append time that never goes back within a partition."""
    return ordering.running(attempts, ["partition"], "arrival_seq", F.col("append_ms"), "time", "max", block)


#: Stands before every arrival: what was stored earlier came first.
EARLIER = 1 << 60
#: Windows of time in a block of an identity's attempts.
WINDOWS = 64


def anchors(attempts: DataFrame, window_ms: int) -> DataFrame:
    """Adds ``anchor``: the arrival of the stored attempt that each attempt is or repeats.

    ``attempts`` has ``partition, message_id, arrival_seq, time``.  An identity's attempts are
    cut into blocks of time, which are worked on apart, so one that never pauses is no single
    task.  What a block makes of an anchor that enters it depends on its first window alone:
    a table of entries and exits, smaller by the windows in a block, carries the anchor over."""
    span = WINDOWS * window_ms
    key = ["partition", "message_id"]
    blocked = attempts.withColumn("_block", F.floor(F.col("time") / span).cast("long"))
    types = {f.name: f.dataType.simpleString() for f in attempts.schema.fields}
    named = f"partition {types['partition']}, message_id {types['message_id']}, _block long"
    between, over = f"{named}, enters long, exits long, first long", f"{named}, _time long, _anchor long"
    arrow = lambda ddl: to_arrow_schema(T.StructType.fromDDL(ddl))
    moments = blocked.select(*key, "_block", "time", "arrival_seq")
    entries = ordering.dealt(moments, [*key, "_block"], ["time", "arrival_seq"]).mapInArrow(_entries(window_ms, span, arrow(between)), between)
    carried = ordering.dealt(entries, key, ["_block", "enters"]).mapInArrow(_carried(window_ms, arrow(over)), over)
    joined = blocked.join(carried, [*key, "_block"], "left")

    def step(state, time, arrival, entered, anchor):
        kept = (time, arrival) if state is None or time - state[0] >= window_ms else state
        return kept, (kept[1],)

    start = lambda time, arrival, entered, anchor: None if entered is None else (entered, anchor)
    out = ordering.folded(joined, [*key, "_block"], ["time", "arrival_seq"], ["time", "arrival_seq", "_time", "_anchor"], start, step, "anchor long")
    return out.drop("_block", "_time", "_anchor")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of a sorted stream by their first columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, own in groupby(rows, lambda r: r[:keys]):
        yield key, (r[keys:] for r in own)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def _entries(window_ms: int, span: int, schema: pa.Schema):
    """For each moment that an anchor from before may let through first: where the block ends up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (partition, identity, block), attempts in _groups(batches, 3):
            own: list[tuple[int, int]] = []  # attempts of one moment share an anchor: its first stands for all
            for t, arrival in attempts:
                if not own or t != own[-1][0]:
                    own.append((t, arrival))
            times = np.array([t for t, _ in own], np.int64)
            after = np.searchsorted(times, times + window_ms).tolist()
            last = list(range(len(own)))
            for i in range(len(own) - 1, -1, -1):
                last[i] = last[after[i]] if after[i] < len(own) else i
            first = int(np.searchsorted(times, block * span + window_ms))
            for i in range(min(first + 1, len(own))):
                yield partition, identity, block, own[i][0], *own[last[i]]

    return lambda batches: _batches(rows(batches), schema)


def _carried(window_ms: int, schema: pa.Schema):
    """The anchor that enters each block, block after block of an identity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        identity, anchor = None, None
        for (*key, block), entries in _groups(batches, 3):
            own = list(entries)
            if key != identity:
                identity, anchor = key, None
            if anchor is not None:
                yield *key, block, *anchor
            at = 0 if anchor is None else bisect_left(own, anchor[0] + window_ms, key=lambda r: r[0])
            if at < len(own):
                anchor = own[at][1:]

    return lambda batches: _batches(rows(batches), schema)


def classify(attempts: DataFrame, window_ms: int, block: int = ordering.BLOCK) -> DataFrame:
    """Adds ``disposition`` (stored or duplicate) and ``offset``: its own for a stored attempt,
    the original's for a duplicate.  Only stored attempts take offsets."""
    timed = written(logical_time(attempts, block), "dedup-timed")
    marked = anchors(timed, window_ms).withColumn("disposition", F.when(F.col("anchor") == F.col("arrival_seq"), "stored").otherwise("duplicate"))
    marked = written(marked, "dedup-marked")
    stored = ordering.position(marked.where("disposition = 'stored'").select("partition", "arrival_seq"), ["partition"], "arrival_seq", "offset", block)
    original = stored.select(F.col("partition").alias("_p"), F.col("arrival_seq").alias("_a"), "offset")
    return marked.join(original, (F.col("partition") == F.col("_p")) & (F.col("anchor") == F.col("_a"))).drop("_p", "_a", "anchor")


def outcome_runs(outcomes: DataFrame) -> DataFrame:
    """Outcomes in order of arrival as runs: disposition, first arrival, first offset, count;
    a run ends where the disposition changes or offsets don't run on."""
    runs_on = (F.col("disposition") == F.col("_disposition")) & (F.col("offset") == F.col("_offset") + 1)
    before = ordering.lagged(outcomes, ["partition"], "arrival_seq", {"disposition": "_disposition", "offset": "_offset"})
    marked = ordering.islands(before, ["partition"], "arrival_seq", ~F.coalesce(runs_on, F.lit(False)), "_run")
    return marked.groupBy("partition", "_run").agg(F.first("disposition").alias("disposition"), F.min("arrival_seq").alias("first_arrival"), F.min("offset").alias("first_offset"), F.count("*").alias("records")).drop("_run")


def waiting(outcomes: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Attempts that aren't answered yet (``outcomes`` with ``producer_id``; ``confirmed``:
    partition, next_offset): a duplicate of a record that isn't confirmed, and whatever its
    producer sent to the partition after it."""
    joined = outcomes.join(confirmed.select("partition", F.col("next_offset").alias("_confirmed")), "partition", "left")
    pending = joined.where((F.col("disposition") == "duplicate") & (F.col("offset") >= F.coalesce("_confirmed", F.lit(0))))
    since = pending.groupBy("partition", "producer_id").agg(F.min("arrival_seq").alias("_since"))
    return outcomes.join(since, ["partition", "producer_id"]).where(F.col("arrival_seq") >= F.col("_since")).withColumn("pending", F.col("arrival_seq") == F.col("_since")).drop("_since")


def admitted(requests: DataFrame, window_ms: int, max_entries: int) -> DataFrame:
    """Adds ``error_code``: a request (``partition, request`` in order, ``time``, ``message_ids``) is
    refused as a whole if the identities it would store make more live ones than
    ``max_entries``; none is evicted before its window is over, and a refusal changes nothing.
    What a partition holds is bounded by ``max_entries``."""

    def step(state, time, ids):
        live, now = state
        now = max(now, time)
        for i in [i for i, at in live.items() if now - at >= window_ms]:
            del live[i]
        fresh = {i for i in ids if i not in live}
        if len(live) + len(fresh) > max_entries:
            return state, (int(Error.CAPACITY),)
        live.update((i, now) for i in fresh)
        return (live, now), (None,)

    return ordering.folded(requests, ["partition"], ["request"], ["time", "message_ids"], lambda time, ids: ({}, time), step, "error_code int")


def live_identities(outcomes: DataFrame, window_ms: int) -> DataFrame:
    """What a snapshot holds: stored identities still inside the window at their partition's time."""
    now = outcomes.groupBy("partition").agg(F.max("time").alias("_now"))
    stored = outcomes.where("disposition = 'stored'").groupBy("partition", "message_id").agg(F.max("time").alias("time"), F.max("offset").alias("offset"))
    return stored.join(now, "partition").where(F.col("_now") - F.col("time") < window_ms).drop("_now")


def next_expiration(live: DataFrame, window_ms: int) -> DataFrame:
    return live.groupBy("partition").agg((F.min("time") + window_ms).alias("expires_ms"))


def clocks(outcomes: DataFrame) -> DataFrame:
    """``partition, time``: how far each partition's time has come, be it by a duplicate."""
    return outcomes.groupBy("partition").agg(F.max("time").alias("time"))


def restored(snapshot: DataFrame, clocks: DataFrame, attempts: DataFrame, window_ms: int) -> DataFrame:
    """Outcomes of attempts after a snapshot (``live_identities`` and ``clocks``): its rows stand
    before all, as stored, and keep their offsets; time goes on from the partition's clock; new
    ones follow on from ``next_offset`` of nothing but them."""
    before = snapshot.select("partition", "message_id", (F.col("offset") - EARLIER).alias("arrival_seq"), "time")
    now = clocks.select(F.col("partition").alias("_p"), F.col("time").alias("_now"))
    timed = logical_time(attempts.select("partition", "message_id", "arrival_seq", "append_ms"))
    after = timed.join(now, F.col("partition").eqNullSafe(F.col("_p")), "left").withColumn("time", F.greatest("time", "_now"))
    both = written(before.unionByName(after.select("partition", "message_id", "arrival_seq", "time")), "dedup-restored")
    marked = anchors(both, window_ms).where("arrival_seq >= 0")
    known = F.when(F.col("anchor") < 0, F.col("anchor") + EARLIER)
    return marked.select("partition", "message_id", "arrival_seq", "time", F.when(F.col("anchor") == F.col("arrival_seq"), "stored").otherwise("duplicate").alias("disposition"), "anchor", known.alias("known_offset"))


def misclassified(recorded: DataFrame, attempts: DataFrame, window_ms: int) -> DataFrame:
    """Recorded outcomes that a recomputation doesn't give: must be empty."""
    columns = ["partition", "arrival_seq", "disposition", "offset"]
    return recorded.select(*columns).exceptAll(classify(attempts, window_ms).select(*columns))


def over_capacity(live: DataFrame, max_entries: int) -> DataFrame:
    """Partitions whose live identities exceed what may be held: new ones are refused there
    until some expire, and none is evicted."""
    return live.groupBy("partition").agg(F.count("*").alias("entries")).where(F.col("entries") > max_entries).withColumn("error_code", F.lit(int(Error.CAPACITY)))
