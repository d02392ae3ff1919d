"""Appending: offsets, validation, retries, result spans, producer sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import ordering
from tidewater.schemas import LIMITS, Error


def assign_offsets(attempts: DataFrame, next_offsets: DataFrame | None = None, block: int = ordering.BLOCK) -> DataFrame:
    """Adds dense offsets per partition in order of arrival, from ``next_offset`` on where given."""
    placed = ordering.position(attempts, ["partition"], "arrival_seq", "offset", block)
    if next_offsets is None:
        return placed
    start = next_offsets.select(F.col("partition").alias("_p"), "next_offset")
    return placed.join(start, F.col("partition") == F.col("_p"), "left").withColumn("offset", F.col("offset") + F.coalesce("next_offset", F.lit(0))).drop("_p", "next_offset")


def validate(attempts: DataFrame, sessions: DataFrame | None = None, opens: bool = False) -> DataFrame:
    """Adds ``error_code``: a missing identity or no part is malformed; sequences of a producer's
    epoch are those accepted so far, counted from 0; epochs never go back.  What is refused
    changes nothing for what comes after.

    ``sessions`` (``partition, producer_id, epoch, next_sequence``) says where producers stand;
    another epoch than theirs is fenced, unless a later one ``opens`` the next.  A producer
    without session opens one by its first attempt, and so does a later epoch of it."""
    malformed = F.col("message_id").isNull() | F.col("producer_id").isNull() | (F.coalesce(F.size("parts"), F.lit(0)) < 1)
    marked = attempts.withColumn("_malformed", malformed)
    if sessions is None:
        marked = marked.withColumns({"_epoch": F.lit(None).cast("long"), "_next": F.lit(None).cast("long")})
    else:
        known = sessions.select("partition", "producer_id", F.col("epoch").cast("long").alias("_epoch"), F.col("next_sequence").cast("long").alias("_next"))
        marked = marked.join(known, ["partition", "producer_id"], "left")

    def start(epoch, sequence, malformed, known, following):
        return (known, following, known is not None and not opens)

    def step(state, epoch, sequence, malformed, known, following):
        current, following, fixed = state
        if malformed:
            return state, (int(Error.MALFORMED),)
        if current is not None and (epoch < current or (fixed and epoch != current)):
            return state, (int(Error.FENCED),)
        if current is None or epoch > current:
            current, following = epoch, 0
        if sequence != following:
            return (current, following, fixed), (int(Error.INVALID_SEQUENCE),)
        return (current, following + 1, fixed), (None,)

    out = ordering.folded(marked, ["partition", "producer_id"], ["arrival_seq"], ["producer_epoch", "sequence", "_malformed", "_epoch", "_next"], start, step, "error_code int")
    return out.select(*attempts.columns, "error_code")


def within_limits(records: DataFrame, limits: dict[str, int] = LIMITS, request: str | None = None) -> DataFrame:
    """Adds ``error_code`` where a record has too many bytes or parts, or its ``request``, if that
    column is named, too many records or bytes."""
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    large = (size > limits["record_bytes"]) | (F.size("parts") > limits["parts"])
    if request is None:
        return records.withColumn("error_code", F.when(large, int(Error.RECORD_TOO_LARGE)))
    whole = records.groupBy(request).agg(F.count("*").alias("_records"), F.sum(size).alias("_bytes"))
    over = (F.col("_records") > limits["records"]) | (F.col("_bytes") > limits["payload_bytes"])
    return records.join(whole, request).withColumn("error_code", F.when(large, int(Error.RECORD_TOO_LARGE)).when(over, int(Error.MALFORMED))).drop("_records", "_bytes")


def resolve_retries(attempts: DataFrame, receipts: DataFrame, floors: DataFrame) -> DataFrame:
    """``attempts`` with ``disposition`` (fresh or retry), ``offset`` of the first receipt and
    ``error_code``: below the producer's retry floor history has expired; a receipt of other
    content is a conflict."""
    key = ["partition", "producer_id", "producer_epoch", "sequence"]
    known = receipts.select(*key, F.col("offset"), F.col("fingerprint").alias("_stored"))
    joined = attempts.join(known, key, "left").join(floors.select("partition", "producer_id", "result_floor"), ["partition", "producer_id"], "left")
    expired = F.col("sequence") < F.coalesce("result_floor", F.lit(0))
    conflict = F.col("_stored").isNotNull() & (F.col("_stored") != F.col("fingerprint"))
    return joined.select(
        *attempts.columns,
        F.when(expired | conflict, None).when(F.col("_stored").isNotNull(), "retry").otherwise("fresh").alias("disposition"),
        F.when(~expired & ~conflict, F.col("offset")).alias("offset"),
        F.when(expired, int(Error.HISTORY_EXPIRED)).when(conflict, int(Error.RETRY_CONFLICT)).alias("error_code"),
    )


def result_spans(results: DataFrame) -> DataFrame:
    """Results (``partition, producer_id, sequence, offset, source``) joined into spans whose
    sequences and offsets both run on and whose source is one."""
    w = Window.partitionBy("partition", "producer_id").orderBy("sequence")
    runs_on = (F.col("sequence") == F.lag("sequence").over(w) + 1) & (F.col("offset") == F.lag("offset").over(w) + 1) & (F.col("source") == F.lag("source").over(w))
    marked = results.withColumn("_new", F.when(F.coalesce(runs_on, F.lit(False)), 0).otherwise(1))
    grouped = marked.withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        grouped.groupBy("partition", "producer_id", "_span")
        .agg(F.min("sequence").alias("first_sequence"), F.min("offset").alias("first_offset"), F.count("*").alias("records"), F.first("source").alias("source"))
        .drop("_span")
    )


def lookup(spans: DataFrame, wanted: DataFrame, width: int = 1024) -> DataFrame:
    """Outcome of each wanted ``partition, producer_id, sequence``: its span's source and offset.
    The range join meets on blocks of sequences that a span is spread over."""
    last = F.col("first_sequence") + F.col("records") - 1
    spread = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_sequence") / width), F.floor(last / width))))
    asked = wanted.withColumn("_block", F.floor(F.col("sequence") / width))
    inside = (F.col("sequence") >= F.col("first_sequence")) & (F.col("sequence") <= last)
    found = asked.join(spread, ["partition", "producer_id", "_block"]).where(inside)
    return found.select("partition", "producer_id", "sequence", "source", (F.col("first_offset") + F.col("sequence") - F.col("first_sequence")).alias("offset"))


def retry_floors(spans: DataFrame, record_floor: int, operation_floor: int) -> DataFrame:
    """Per producer the sequence up to which results may be forgotten: the first span that
    isn't wholly below the floors holds it, partly if its records are partly below."""
    proof = F.col("source") != "stored"
    holds = F.when(proof, F.col("source_operation") >= operation_floor).otherwise(F.greatest(F.lit(record_floor) - F.col("first_offset"), F.lit(0)) < F.col("records"))
    at = F.when(proof, F.col("first_sequence")).otherwise(F.col("first_sequence") + F.greatest(F.lit(record_floor) - F.col("first_offset"), F.lit(0)))
    return spans.groupBy("partition", "producer_id").agg(
        F.coalesce(F.min_by(F.when(holds, at), F.when(holds, F.col("first_sequence"))), F.max(F.col("first_sequence") + F.col("records"))).alias("result_floor")
    )


def kept_spans(spans: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` spans of each producer; older ones go first."""
    w = Window.partitionBy("partition", "producer_id").orderBy(F.desc("first_sequence"))
    return spans.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def open_producers(requests: DataFrame, producers: DataFrame) -> DataFrame:
    """Requests (``partition, producer_id, expected_epoch`` or null, ``new_epoch``) against the
    sessions: an expected epoch must be the current one, a new one must be greater than it
    and than any retired one."""
    joined = requests.join(producers.select("partition", "producer_id", F.col("epoch"), F.col("retired_epoch")), ["partition", "producer_id"], "left")
    current = F.coalesce("epoch", F.lit(-1))
    fenced = F.coalesce(F.col("expected_epoch") != F.col("epoch"), F.col("expected_epoch").isNotNull() & F.col("epoch").isNull())
    stale = F.col("new_epoch") <= F.greatest(current, F.coalesce("retired_epoch", F.lit(-1)))
    code = F.when(fenced | stale, int(Error.FENCED))
    return joined.select(*requests.columns, code.alias("error_code"), F.when(code.isNull(), F.col("new_epoch")).otherwise(F.col("epoch")).alias("epoch"))


def open_by_mode(requests: DataFrame, producers: DataFrame, retired: DataFrame) -> DataFrame:
    """Requests (``partition, producer_id, mode, expected_epoch``) for sessions: mode 0 resumes a
    live one or creates one, 1 fences the one whose epoch is expected, 2 creates one only where
    none is.  A new epoch is one above all that the partition has retired and the session had.
    ``producers``: partition, producer_id, epoch, next_sequence; ``retired``: partition, epoch."""
    floor = retired.groupBy("partition").agg(F.max("epoch").alias("_retired"))
    live = producers.select("partition", "producer_id", F.col("epoch").alias("_epoch"), F.col("next_sequence").alias("_next"))
    joined = requests.join(live, ["partition", "producer_id"], "left").join(floor, "partition", "left")
    there, expects = F.col("_epoch").isNotNull(), F.col("expected_epoch").isNotNull()
    wrong = expects & ~F.col("expected_epoch").eqNullSafe(F.col("_epoch"))
    code = (
        F.when(~F.col("mode").isin(0, 1, 2) | ((F.col("mode") == 1) & ~expects) | ((F.col("mode") == 2) & expects), int(Error.MALFORMED))
        .when(wrong | ((F.col("mode") == 2) & there), int(Error.FENCED))
    )
    resumes = (F.col("mode") == 0) & there
    new = F.greatest(F.coalesce("_epoch", F.lit(0)), F.coalesce("_retired", F.lit(0))) + 1
    return joined.select(
        *requests.columns,
        code.alias("error_code"),
        F.when(code.isNull(), F.when(resumes, F.col("_epoch")).otherwise(new)).alias("epoch"),
        F.when(code.isNull(), F.when(resumes, F.col("_next")).otherwise(F.lit(0))).alias("next_sequence"),
    )


def advance_floors(requests: DataFrame, producers: DataFrame) -> DataFrame:
    """Requests (``partition, producer_id, epoch, expected_floor, new_floor``): the epoch and the
    floor must be the producer's, and the floor moves forward, at most to its next sequence."""
    now = producers.select("partition", "producer_id", F.col("epoch").alias("_epoch"), F.col("result_floor").alias("_floor"), F.col("next_sequence").alias("_next"))
    joined = requests.join(now, ["partition", "producer_id"], "left")
    code = F.when(~F.col("epoch").eqNullSafe(F.col("_epoch")), int(Error.FENCED)).when(
        (F.col("expected_floor") != F.col("_floor")) | (F.col("new_floor") <= F.col("expected_floor")) | (F.col("new_floor") > F.col("_next")), int(Error.INVALID_SEQUENCE)
    )
    return joined.select("partition", "producer_id", code.alias("error_code"), F.when(code.isNull(), F.col("new_floor")).otherwise(F.col("_floor")).alias("result_floor"))


def batches(attempts: DataFrame, most: int, target_bytes: int, keys: list[str] = ("partition",), order: str = "arrival_seq") -> DataFrame:
    """Adds ``batch``, the number of the request that a record (of ``bytes``) goes with: one takes
    records while they are ``most`` at most and keep to the target; a larger one goes alone."""

    def step(state, size):
        number, records, total = state
        if records and (records == most or total + size > target_bytes):
            number, records, total = number + 1, 0, 0
        return (number, records + 1, total + size), (number,)

    return ordering.folded(attempts, list(keys), [order], ["bytes"], lambda size: (0, 0, 0), step, "batch long")


def writer_stats(receipts: DataFrame) -> DataFrame:
    """Per partition what a writer was told: confirmed records by disposition, refusals, the end."""
    told = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    return receipts.groupBy("partition").agg(told("stored"), told("duplicate"), told("retry"), F.count_if(F.col("error_code").isNotNull()).alias("refused"), F.max("offset").alias("last_offset"))


def idle_producers(activity: DataFrame, now_ms: int, idle_ms: int) -> DataFrame:
    """Producers whose last activity is ``idle_ms`` ago or more."""
    last = activity.groupBy("partition", "producer_id").agg(F.max("append_ms").alias("last_ms"), F.max("sequence").alias("last_sequence"))
    return last.where(F.lit(now_ms) - F.col("last_ms") >= idle_ms)


def retire(producers: DataFrame, retired: DataFrame) -> DataFrame:
    """Sessions without those retired at the same epoch and next sequence."""
    return producers.join(retired, ["partition", "producer_id", "epoch", "next_sequence"], "left_anti")


def retired_epochs(producers: DataFrame, retired: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The highest epoch that each partition has retired, ``before`` included: no new session goes
    below it."""
    gone = producers.join(retired, ["partition", "producer_id", "epoch", "next_sequence"], "left_semi").select("partition", "epoch")
    both = gone if before is None else gone.unionByName(before.select("partition", "epoch"))
    return both.groupBy("partition").agg(F.max("epoch").alias("epoch"))


def fingerprint(message_id: Column, parts: Column) -> Column:
    """SHA-256 over identity, number of parts and each part with its length, so that parts
    divided otherwise differ."""
    framed = F.concat_ws("", F.transform(parts, lambda p: F.concat(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0"), F.hex(p))))
    return F.sha2(F.concat_ws("|", message_id, F.size(parts).cast("string"), framed), 256)


def broken_chain(operations: DataFrame) -> DataFrame:
    """Operations (``log, op, digest, predecessor``) whose number or predecessor doesn't follow."""
    before = ordering.lagged(operations, ["log"], "op", {"op": "_op", "digest": "_digest"})
    bad = F.col("_op").isNotNull() & ((F.col("op") != F.col("_op") + 1) | ~F.col("predecessor").eqNullSafe(F.col("_digest")))
    return before.where(bad).drop("_op", "_digest")


def live_claims(claims: DataFrame, floor: int, bound: int) -> DataFrame:
    """By identity the newest operation that claims it, at most ``bound``; claims below the floor are gone."""
    return claims.where(F.col("op").between(floor, bound)).groupBy("identity").agg(F.max("op").alias("op"))


def committed(operations: DataFrame, commit: int) -> DataFrame:
    """The committed prefix."""
    return operations.where(F.col("op") <= commit)


def replace_suffix(operations: DataFrame, suffix: DataFrame, first: int) -> DataFrame:
    """Operations with those from ``first`` on replaced."""
    return operations.where(F.col("op") < first).unionByName(suffix.where(F.col("op") >= first))


def change_policies(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (``topic, expected_revision, ...``) take effect only at the revision they expect."""
    values = [c for c in policies.columns if c not in ("topic", "policy_revision")]
    due = changes.select("topic", F.col("expected_revision").alias("policy_revision"), *(F.col(c).alias(f"_{c}") for c in values)).withColumn("_due", F.lit(True))
    joined = policies.join(due, ["topic", "policy_revision"], "left")
    new = [F.when(F.col("_due"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select("topic", (F.col("policy_revision") + F.coalesce(F.col("_due").cast("int"), F.lit(0))).alias("policy_revision"), *new)


def create_partitions(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (``topic, partition, dedup_window_ms, delay_max_ms``) for partitions: an address
    is given once, and deduplication and delay exclude each other."""
    there = known.select("topic", "partition").distinct().withColumn("_there", F.lit(True))
    joined = requests.join(there, ["topic", "partition"], "left")
    code = F.when(F.col("_there"), int(Error.RETRY_CONFLICT)).when(F.col("dedup_window_ms").isNotNull() & F.col("delay_max_ms").isNotNull(), int(Error.UNSUPPORTED))
    return joined.select(*requests.columns, code.alias("error_code"))
