"""Results of the control plane as tables: clocks, commit, history selection, replica state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.schemas import Error


def clock_verdicts(samples: DataFrame, now_ms: int, tolerance_ms: int, fresh_ms: int = 5000) -> DataFrame:
    """Samples (``node, peer, offset_ms, arrived_ms``): with this clock's zero among the fresh
    ones, both middle values must be within the tolerance."""
    fresh = samples.groupBy("node").agg(F.collect_list(F.when(F.lit(now_ms) - F.col("arrived_ms") <= fresh_ms, F.col("offset_ms"))).alias("o"))
    clocks = F.array_sort(F.concat(F.col("o"), F.array(F.lit(0).cast("long"))))
    at = lambda i: F.element_at("c", i.cast("int"))
    n = F.size("c")
    agreed = (F.abs(at(F.floor((n - 1) / 2) + 1)) <= tolerance_ms) & (F.abs(at(F.floor(n / 2) + 1)) <= tolerance_ms)
    return fresh.select("node", clocks.alias("c")).select("node", F.when(n < 2, "unknown").when(agreed, "agreed").otherwise("disagreed").alias("verdict"))


def quorum_commit(replicas: DataFrame, followers: DataFrame) -> DataFrame:
    """A leader commits what it and its best follower have made durable; a follower what it
    has of the commit that it knows."""
    best = followers.groupBy("partition").agg(F.max("acked").alias("best"))
    joined = replicas.join(best, "partition", "left")
    return joined.select("partition", "node", F.when(F.col("role") == "leader", F.least("durable", F.coalesce("best", F.lit(0)))).otherwise(F.least("durable", "known_commit")).alias("commit"))


def selected_history(reports: DataFrame) -> DataFrame:
    """From reports (``partition, voter, last_normal_view, op, digest, committed``) the history
    with the highest view, then operation; two digests at that rank are a conflict, fewer
    than two voters are no quorum."""
    ranked = reports.withColumn("rank", F.struct("last_normal_view", "op"))
    top = ranked.groupBy("partition").agg(F.max("rank").alias("top"), F.max("committed").alias("committed"), F.count_distinct("voter").alias("voters"))
    at = ranked.join(top, "partition").where("rank = top").groupBy("partition").agg(F.min("voter").alias("voter"), F.count_distinct("digest").alias("digests"))
    joined = top.join(at, "partition")
    code = F.when(F.col("voters") < 2, int(Error.UNCERTAIN)).when(F.col("digests") > 1, int(Error.STALE_AUTHORITY))
    return joined.select("partition", F.col("top.last_normal_view").alias("view"), F.col("top.op").alias("op"), F.when(code.isNull(), F.col("voter")).alias("source"), "committed", code.alias("error_code"))


def behind(replicas: DataFrame) -> DataFrame:
    """How far each replica is behind: text as a console shows it, and the number."""
    value = F.when(F.col("state") == "electing", None).when(F.col("role") == "leader", F.col("accepted") - F.col("acked")).otherwise(F.greatest(F.col("leader_commit") - F.col("accepted"), F.lit(0)))
    kind = F.when(F.col("state") == "electing", "unknown").when(F.col("role") == "leader", "leader").otherwise("ops")
    return replicas.select("partition", "node", kind.alias("kind"), value.alias("ops"))


def leads(status: DataFrame) -> DataFrame:
    return status.groupBy("node").agg(F.count_if(F.col("role") == "leader").alias("leads"), F.count("*").alias("replicas"))


def missing_shards(expected: DataFrame, reported: DataFrame) -> DataFrame:
    return expected.join(reported, ["node", "shard"], "left_anti")


def with_names(names: DataFrame, status: DataFrame) -> DataFrame:
    """Partition names with their statuses; statuses without a name come too, and names without a status."""
    return names.join(status, "partition", "full_outer")


def while_trusted(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of nodes whose clocks agree: releases, retention by age and retirement of idle
    producers wait for the others."""
    return rows.join(verdicts.where("verdict = 'agreed'").select("node"), "node", "left_semi")
