"""Schemas of the log tables, limits and error codes."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS = (
    "arrival_seq bigint, topic string, partition int, producer_id string, producer_epoch bigint, sequence bigint, "
    "message_id string, key binary, parts array<binary>, append_ms bigint, due_ms bigint"
)
RECORDS = (
    "topic string, partition int, offset bigint, message_id string, append_ms bigint, producer_id string, "
    "producer_epoch bigint, sequence bigint, parts array<binary>"
)
RECEIPTS = "topic string, partition int, producer_id string, producer_epoch bigint, sequence bigint, message_id string, disposition string, offset bigint, policy string"
SEGMENTS = "topic string, partition int, id bigint, capacity bigint, sealed boolean, last_operation bigint, record_end bigint, newest_append_ms bigint"
COUNTERS = "uptime_ms bigint, thread string, event string, kind string, value bigint"

#: Limits of one request: payload bytes, record bytes, records, parts.
LIMITS = {"payload_bytes": 16 << 20, "record_bytes": 1 << 20, "records": 1000, "parts": 4000}
#: What a topic has where nothing is said.
TOPIC_DEFAULTS = {"partitions": 16, "partitioner_seed": 0, "dedup_window_ms": 300_000, "delay_max_entries": 100_000, "producer_idle_s": 604_800, "segment_bytes": 256 << 20}


class Error(IntEnum):
    """Why a row was refused; operators put the number into ``error_code``."""

    MALFORMED = 1
    UNSUPPORTED = 2
    NOT_AUTHORIZED = 3
    STALE_AUTHORITY = 5
    FENCED = 6
    INVALID_SEQUENCE = 7
    RETRY_CONFLICT = 8
    HISTORY_EXPIRED = 9
    CAPACITY = 10
    UNCERTAIN = 11
    WRONG_LEADER = 12
    AUTHORITY_CHANGED = 13
    RETENTION_GAP = 14
    UNKNOWN_SUBSCRIPTION = 15
    BEYOND_END = 16
    RECORD_TOO_LARGE = 17
    UNKNOWN_TOPIC = 18
    ID_MISSING = 19
    ID_AMBIGUOUS = 20
    DUE_TOO_LATE = 21


def assert_valid(df: DataFrame, column: str = "error_code") -> DataFrame:
    """``df``, failing when a row with an error is read."""
    failed = F.raise_error(F.concat(F.lit("error "), F.col(column).cast("string")))
    return df.where(F.when(F.col(column).isNotNull(), failed.cast("boolean")).otherwise(F.lit(True)))
