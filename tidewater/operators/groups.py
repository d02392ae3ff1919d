"""Consumer groups: membership, sticky plan, assignment, progress, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import ordering
from tidewater.schemas import Error


def live_members(beats: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """Members (``group_id, member_id, join_id, kind, seen_ms``) whose newest join is not
    followed by a leave and that were seen less than the timeout ago; beats of an older
    instance are fenced."""
    w = Window.partitionBy("group_id", "member_id")
    joins = beats.withColumn("_joined", F.max(F.when(F.col("kind") == "join", F.col("seen_ms"))).over(w)).withColumn("_join", F.max_by(F.when(F.col("kind") == "join", F.col("join_id")), F.when(F.col("kind") == "join", F.col("seen_ms"))).over(w))
    own = joins.where((F.col("join_id") == F.col("_join")) & (F.col("seen_ms") >= F.col("_joined")))
    state = own.groupBy("group_id", "member_id", "join_id").agg(F.max("seen_ms").alias("seen_ms"), F.max((F.col("kind") == "leave").cast("int")).alias("_left"))
    return state.where((F.col("_left") == 0) & (F.lit(now_ms) - F.col("seen_ms") < timeout_ms)).drop("_left")


def plan(members: DataFrame, partitions: DataFrame, prior: DataFrame, revision: int) -> DataFrame:
    """The next target of every partition of every group.

    ``members``: group_id, member_id, join_id.  ``partitions``: group_id, partition.
    ``prior``: group_id, partition, member_id, join_id, plan_revision, prior_member_id.
    Members get equal shares; the slots left over go to those who own most (then by id);
    owners keep their first partitions up to their share; free partitions fill the remaining
    shares in order of member.  A target that changes takes the revision and remembers whom
    it left; another keeps all it had.  Without members partitions have no target."""
    group = Window.partitionBy("group_id")
    old = prior.select("group_id", "partition", *(F.col(c).alias(f"old_{c}") for c in ("member_id", "join_id", "plan_revision", "prior_member_id")))
    slots = partitions.join(old, ["group_id", "partition"], "left")
    owner = members.select("group_id", F.col("member_id").alias("old_member_id"), F.col("join_id").alias("old_join_id"), F.col("member_id").alias("owner_id"))
    slots = slots.join(owner, ["group_id", "old_member_id", "old_join_id"], "left")
    owned = slots.where("owner_id is not null").groupBy("group_id", F.col("owner_id").alias("member_id")).agg(F.count("*").alias("owned"))
    size = partitions.groupBy("group_id").agg(F.count("*").alias("slots"))
    ranked = members.join(size, "group_id").join(owned, ["group_id", "member_id"], "left").withColumn("owned", F.coalesce("owned", F.lit(0)))
    ranked = ranked.withColumn("_n", F.count("*").over(group)).withColumn("_rank", F.row_number().over(group.orderBy(F.desc("owned"), "member_id")))
    quota = ranked.withColumn("quota", F.floor(F.col("slots") / F.col("_n")) + F.when(F.col("_rank") <= F.col("slots") % F.col("_n"), 1).otherwise(0))
    held = slots.join(quota.select("group_id", F.col("member_id").alias("owner_id"), "quota"), ["group_id", "owner_id"], "left")
    place = F.row_number().over(Window.partitionBy("group_id", "owner_id").orderBy("partition"))
    held = held.withColumn("kept", F.col("owner_id").isNotNull() & (place <= F.coalesce("quota", F.lit(0))))
    # free partitions in order meet the open shares in order of member
    free = held.where(~F.col("kept")).withColumn("_at", F.row_number().over(group.orderBy("partition")))
    counted = quota.withColumn("open", F.col("quota") - F.least("owned", "quota")).where("open > 0")
    shares = counted.withColumn("_end", F.sum("open").over(group.orderBy("member_id").rowsBetween(Window.unboundedPreceding, 0)))
    spread = shares.select("group_id", F.col("member_id").alias("new_id"), F.explode(F.sequence(F.col("_end") - F.col("open") + 1, F.col("_end"))).alias("_at"))
    filled = free.join(spread, ["group_id", "_at"], "left").select("group_id", "partition", "new_id")
    target = held.join(filled, ["group_id", "partition"], "left").withColumn("member_id", F.when(F.col("kept"), F.col("owner_id")).otherwise(F.col("new_id")))
    target = target.join(members.select("group_id", "member_id", "join_id"), ["group_id", "member_id"], "left")
    same = F.col("old_plan_revision").isNotNull() & F.col("member_id").eqNullSafe(F.col("old_member_id")) & F.col("join_id").eqNullSafe(F.col("old_join_id"))
    return target.select(
        "group_id",
        "partition",
        "member_id",
        "join_id",
        F.when(same, F.col("old_plan_revision")).otherwise(F.lit(revision).cast("long")).alias("plan_revision"),
        F.when(same, F.col("old_prior_member_id")).otherwise(F.col("old_member_id")).alias("prior_member_id"),
    )


def assign(requests: DataFrame, assignments: DataFrame, ends: DataFrame, progress: DataFrame) -> DataFrame:
    """Requests (``group_id, partition, expected_epoch, plan_revision, member_id, start``): the
    epoch moves on by one, the plan revision must be newer, and reading resumes from
    progress, or from a start inside the retained log where there is none."""
    key = ["group_id", "partition"]
    now = assignments.select(*key, F.col("epoch").alias("_epoch"), F.col("plan_revision").alias("_revision"))
    joined = requests.join(now, key, "left").join(progress.select(*key, F.col("next_offset").alias("_progress")), key, "left").join(ends, "partition", "left")
    resume = F.coalesce("_progress", "start")
    code = (
        F.when(~F.col("expected_epoch").eqNullSafe(F.col("_epoch")), int(Error.FENCED))
        .when(F.col("plan_revision") <= F.col("_revision"), int(Error.STALE_AUTHORITY))
        .when(resume < F.col("retained_from"), int(Error.HISTORY_EXPIRED))
        .when(resume > F.col("next_offset"), int(Error.BEYOND_END))
    )
    ok = code.isNull()
    return joined.select(*key, "member_id", F.when(ok, F.coalesce("_epoch", F.lit(0)) + 1).alias("epoch"), F.when(ok, resume).alias("resume_cursor"), code.alias("error_code"))


def ack_cursor(deliveries: DataFrame) -> DataFrame:
    """The longest acknowledged prefix of each partition, whatever the order of the
    acknowledgements: the first offset not acknowledged, else the end."""
    return deliveries.groupBy("partition").agg(F.coalesce(F.min(F.when(~F.col("acked"), F.col("offset"))), F.max("offset") + 1).alias("cursor"))


def progress_errors(updates: DataFrame, assignments: DataFrame, ends: DataFrame) -> DataFrame:
    """Updates (``group_id, partition, seq, epoch, member_id, expected, next``) in order: each
    must come from the present assignment, expect what the last accepted one left, move forward
    and stay within the log; what is refused leaves the cursor where it was."""
    key = ["group_id", "partition"]
    held = assignments.select(*key, F.col("epoch").alias("_epoch"), F.col("member_id").alias("_member"), F.coalesce("resume_cursor", F.lit(0)).cast("long").alias("_resume"))
    joined = updates.join(held, key, "left").join(ends.select("partition", F.col("next_offset").alias("_end")), "partition", "left")
    fenced = F.coalesce(F.col("epoch") != F.col("_epoch"), F.lit(True)) | ~F.col("member_id").eqNullSafe(F.col("_member"))

    def step(cursor, fenced, expected, following, resume, end):
        if fenced:
            return cursor, (int(Error.FENCED),)
        if expected != cursor or following <= cursor:
            return cursor, (int(Error.INVALID_SEQUENCE),)
        if end is not None and following > end:
            return cursor, (int(Error.BEYOND_END),)
        return following, (None,)

    out = ordering.folded(joined.withColumn("_fenced", fenced), key, ["seq"], ["_fenced", "expected", "next", "_resume", "_end"], lambda fenced, expected, following, resume, end: resume or 0, step, "error_code int")
    return out.select(*updates.columns, "error_code")


def coalesced(updates: DataFrame) -> DataFrame:
    """Of the cursors in flight for a group and partition only the furthest is written."""
    return updates.groupBy("group_id", "partition").agg(F.max("next").alias("next_offset"), F.count("*").alias("riders"))


def proposals(cursors: DataFrame, most: int = 16) -> DataFrame:
    """Adds ``proposal``: cursors of a partition's groups that are written together, at most so many."""
    n = F.row_number().over(Window.partitionBy("partition").orderBy("group_id"))
    return cursors.withColumn("proposal", F.floor((n - 1) / most).cast("long"))


def deliverable(log: DataFrame, cursors: DataFrame, window: int) -> DataFrame:
    """Records that may be in processing at once: of each group (``group_id, partition, cursor``)
    the next ``window`` ones from its cursor on."""
    return log.join(cursors, "partition").where((F.col("offset") >= F.col("cursor")) & (F.col("offset") < F.col("cursor") + window)).drop("cursor")


def install_plans(groups: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans (``group_id, name, expected_revision, revision``) against the groups that are there
    (``group_id, name, revision``): the revision expected must be the group's, 0 for a new one,
    and a name belongs to one group."""
    names = groups.select("name", F.col("group_id").alias("_owner"))
    joined = plans.join(groups.select("group_id", F.col("name").alias("_name"), F.col("revision").alias("_revision")), "group_id", "left").join(names, "name", "left")
    code = F.when(F.coalesce("_revision", F.lit(0)) != F.col("expected_revision"), int(Error.STALE_AUTHORITY)).when(
        F.coalesce(F.col("_name") != F.col("name"), F.lit(False)) | F.coalesce(F.col("_owner") != F.col("group_id"), F.lit(False)), int(Error.MALFORMED)
    )
    return joined.select("group_id", "name", F.when(code.isNull(), F.col("revision")).otherwise(F.col("_revision")).alias("revision"), code.alias("error_code"))


def delete_groups(groups: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (``group_id, revision``): a group goes at exactly the revision that was seen, and
    its name is free; one that isn't there is refused."""
    joined = requests.join(groups.select("group_id", "name", F.col("revision").alias("_revision")), "group_id", "left")
    code = F.when(F.col("_revision").isNull(), int(Error.MALFORMED)).when(F.col("revision") != F.col("_revision"), int(Error.STALE_AUTHORITY))
    return joined.select("group_id", F.when(code.isNull(), F.col("name")).alias("freed"), code.alias("error_code"))


def start_of(groups: DataFrame, progress: DataFrame, starts: DataFrame) -> DataFrame:
    """Where each group reads a partition from: its progress, else the start chosen at creation."""
    return groups.join(progress, ["group_id", "partition"], "left").join(starts, "partition", "left").select("group_id", "partition", F.coalesce("next_offset", "start").alias("start"))


def expired_cursors(progress: DataFrame, ends: DataFrame) -> DataFrame:
    """Cursors below the retained floor: an error, never reset by itself."""
    return progress.join(ends.select("partition", "retained_from"), "partition").where("next_offset < retained_from").withColumn("error_code", F.lit(int(Error.HISTORY_EXPIRED)))


def lag_of(cursor: Column, end: Column) -> Column:
    """How far a cursor is behind; null without one."""
    return F.when(cursor.isNotNull(), F.greatest(end - cursor, F.lit(0)))


def group_lag(targets: DataFrame, progress: DataFrame, ends: DataFrame) -> DataFrame:
    """Per group partitions, cursors and total lag over those that have a cursor."""
    joined = targets.join(progress, ["group_id", "partition"], "full_outer").join(ends.select("partition", F.col("next_offset").alias("end")), "partition", "left")
    return joined.groupBy("group_id").agg(F.count("*").alias("partitions"), F.count("next_offset").alias("cursors"), F.sum(lag_of(F.col("next_offset"), F.col("end"))).alias("lag"))


def activatable(targets: DataFrame, members: DataFrame, owned: DataFrame, now_ms: int, drain_ms: int) -> DataFrame:
    """Whether each target may start: nobody had it before, its drain is over, or every live
    member is leaving, is the new owner, or has reported and holds no older revision of it.
    ``members``: group_id, member_id, join_id, leaving, reported; ``owned``: group_id,
    member_id, partition, plan_revision."""
    facing = targets.join(members.select("group_id", F.col("member_id").alias("m"), F.col("join_id").alias("j"), "leaving", "reported"), "group_id", "left")
    holds = owned.select("group_id", F.col("member_id").alias("m"), "partition", F.col("plan_revision").alias("held"))
    joined = facing.join(holds, ["group_id", "m", "partition"], "left")
    clear = F.col("leaving") | ((F.col("member_id") == F.col("m")) & (F.col("join_id") == F.col("j"))) | (F.col("reported") & (F.col("held").isNull() | (F.col("held") >= F.col("plan_revision"))))
    ready = F.col("prior_member_id").isNull() | (F.lit(now_ms) - F.col("first_seen_ms") >= drain_ms) | F.col("m").isNull() | F.coalesce(clear, F.lit(False))
    return joined.groupBy("group_id", "partition").agg(F.bool_and(ready).alias("activatable"))


def without_groups(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Any table of groups without the deleted ones; deleting again changes nothing."""
    return table.join(deleted.select("group_id"), "group_id", "left_anti")


def inspect(groups: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """Per group its members and the partitions of each."""
    of = targets.groupBy("group_id", "member_id").agg(F.count("*").alias("partitions"))
    return groups.join(members, "group_id", "left").join(of, ["group_id", "member_id"], "left").select("group_id", "member_id", F.coalesce("partitions", F.lit(0)).alias("partitions"))


def invalid_plans(groups: DataFrame, members: DataFrame, partitions: DataFrame, most_members: int = 256, most_partitions: int = 1024) -> DataFrame:
    """Groups (``group_id, revision, prior_revision`` or null) whose next plan may not be made:
    members that repeat or are too many, too many partitions, or a revision that doesn't follow."""
    m = members.groupBy("group_id").agg(F.count("*").alias("_m"), F.count_distinct("member_id").alias("_d"))
    p = partitions.groupBy("group_id").agg(F.count("*").alias("_p"))
    joined = groups.join(m, "group_id", "left").join(p, "group_id", "left")
    code = (
        F.when(F.col("_m") != F.col("_d"), int(Error.MALFORMED))
        .when((F.col("_m") > most_members) | (F.col("_p") > most_partitions), int(Error.CAPACITY))
        .when(F.col("revision") != F.coalesce("prior_revision", F.lit(0)) + 1, int(Error.INVALID_SEQUENCE))
    )
    return joined.select(*groups.columns, code.alias("error_code")).where("error_code is not null")
