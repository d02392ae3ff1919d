"""Streaming forms of the stateful operators.

Time is data: processors go by the times in the rows, never by a clock, so that a replay
gives what the live run gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DEDUP_OUTPUT = "partition int, message_id string, arrival_seq bigint, time bigint, disposition string, original_seq bigint"


class DedupProcessor(StatefulProcessor):
    """First-wins deduplication for one identity: the state is the stored attempt that
    anchors the window."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "arrival_seq bigint, time bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get() if self.kept.exists() else None
        batch = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")
        out = []
        for seq, time in zip(batch["arrival_seq"], batch["time"], strict=True):
            seq, time = int(seq), int(time)
            stored = kept is None or time - kept[1] >= self.window_ms
            if stored:
                kept = (seq, time)
            out.append((key[0], key[1], seq, time, "stored" if stored else "duplicate", kept[0]))
        self.kept.update(kept)
        yield pd.DataFrame(out, columns=["partition", "message_id", "arrival_seq", "time", "disposition", "original_seq"])

    def close(self) -> None:
        pass


def deduplicate(stream: DataFrame, window_ms: int) -> DataFrame:
    """``stream`` has ``partition int, message_id string, arrival_seq bigint, time bigint``."""
    return stream.groupBy("partition", "message_id").transformWithStateInPandas(DedupProcessor(window_ms), DEDUP_OUTPUT, "append", "none")


RELEASE_OUTPUT = "partition int, message_id string, release_ms bigint, schedule bigint, offset bigint"


class ReleaseProcessor(StatefulProcessor):
    """Delayed release for one partition: held records are kept by their release key and leave
    in its order once the partition's time, the largest append time seen, has come to it.  What
    is held is only walked when the earliest release key is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "release_ms bigint, schedule bigint", "message_id string")
        self.at = handle.getValueState("at", "time bigint, schedule bigint, offset bigint, earliest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        time, schedule, offset, earliest = self.at.get() if self.at.exists() else (0, 0, 0, None)
        batch = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")
        for message, append, due in zip(batch["message_id"], batch["append_ms"], batch["due_ms"], strict=True):
            time = max(time, int(append))
            key_ms = max(int(due), int(append))
            self.held.updateValue((key_ms, schedule), (message,))
            earliest = key_ms if earliest is None else min(earliest, key_ms)
            schedule += 1
        due_now = []
        if earliest is not None and earliest <= time:
            held = [tuple(k) for k in self.held.keys()]
            due_now = sorted(k for k in held if k[0] <= time)
            earliest = min((k[0] for k in held if k[0] > time), default=None)
        out = []
        for k in due_now:
            out.append((key[0], self.held.getValue(k)[0], k[0], k[1], offset))
            self.held.removeKey(k)
            offset += 1
        self.at.update((time, schedule, offset, earliest))
        yield pd.DataFrame(out, columns=["partition", "message_id", "release_ms", "schedule", "offset"])

    def close(self) -> None:
        pass


def release(stream: DataFrame) -> DataFrame:
    """``stream`` has ``partition int, arrival_seq, message_id string, append_ms, due_ms``."""
    return stream.groupBy("partition").transformWithStateInPandas(ReleaseProcessor(), RELEASE_OUTPUT, "append", "none")


MEMBER_OUTPUT = "group_id string, member_id string, join_id string, seen_ms bigint, state string"


class MembershipProcessor(StatefulProcessor):
    """Membership of one group: a new join replaces the instance, beats of another instance
    are fenced, a member not seen for the timeout has expired."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", "member_id string", "join_id string, seen_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seen_ms", "seq"], kind="stable")
        out = []
        for member, join, kind, seen in zip(batch["member_id"], batch["join_id"], batch["kind"], batch["seen_ms"], strict=True):
            seen = int(seen)
            for other, (other_join, last) in list(self.members.iterator()):
                other = other[0] if isinstance(other, tuple) else other
                if seen - last >= self.timeout_ms:
                    self.members.removeKey((other,))
                    out.append((key[0], other, other_join, last, "expired"))
            known = self.members.getValue((member,)) if self.members.containsKey((member,)) else None
            if kind == "join":
                self.members.updateValue((member,), (join, seen))
                out.append((key[0], member, join, seen, "joined" if known is None else "replaced"))
            elif known is None or known[0] != join:
                out.append((key[0], member, join, seen, "fenced"))
            elif kind == "leave":
                self.members.removeKey((member,))
                out.append((key[0], member, join, seen, "left"))
            else:
                self.members.updateValue((member,), (join, seen))
        yield pd.DataFrame(out, columns=["group_id", "member_id", "join_id", "seen_ms", "state"])

    def close(self) -> None:
        pass


def membership(stream: DataFrame, timeout_ms: int) -> DataFrame:
    """``stream`` has ``group_id, member_id, join_id, kind, seen_ms, seq``."""
    return stream.groupBy("group_id").transformWithStateInPandas(MembershipProcessor(timeout_ms), MEMBER_OUTPUT, "append", "none")


def replay(spark, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stored log as a stream; the query's checkpoint remembers what has been delivered."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
