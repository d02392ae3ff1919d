"""Which partition, leader or coordinator a record, view or group goes to."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.schemas import Error


def keyed_partition(key: Column, seed: int, count: int) -> Column:
    """XXH3-64 of the key's bytes, modulo the number of partitions; null for a null key.
    Also where a group's coordinator is, by its name.  Spark has no XXH3, hence Arrow."""

    @F.arrow_udf("int")
    def route(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else xxhash.xxh3_64_intdigest(k, seed) % count for k in keys.to_pylist()], pa.int32())

    return route(key.cast("binary"))


def sticky_partition(batch_index: Column, count: int) -> Column:
    """Records without key stay on a partition until a batch is formed, then move on by one."""
    return F.pmod(batch_index, F.lit(count)).cast("int")


def explicit_partition(df: DataFrame, column: str, count: int) -> DataFrame:
    """Adds ``error_code``: a partition that the topic lacks is refused, never replaced."""
    ok = F.col(column).isNotNull() & (F.col(column) >= 0) & (F.col(column) < count)
    return df.withColumn("error_code", F.when(~ok, F.lit(int(Error.MALFORMED))))


def leader_of(brokers: Column, view: Column) -> Column:
    """Brokers take turns by view."""
    return F.element_at(brokers, (F.pmod(view, F.size(brokers).cast("long")) + 1).cast("int"))


def routes(reports: DataFrame, voters: int = 3) -> DataFrame:
    """From ``partition, broker, view, leader`` (null while electing): the leader that the
    highest view names, unless a majority reports newer views without one.  Two leaders in
    one view are an error."""
    named = reports.where(F.col("leader").isNotNull()).groupBy("partition", "view").agg(F.min("leader").alias("leader"), F.count_distinct("leader").alias("leaders"))
    top = named.groupBy("partition").agg(F.max_by("leader", "view").alias("leader"), F.max("view").alias("view"), F.max(F.col("leaders")).alias("leaders"))
    newer = reports.where(F.col("leader").isNull()).select("partition", "broker", F.col("view").alias("newer"))
    hidden = top.join(newer, "partition", "left").groupBy("partition").agg(F.count_distinct(F.when(F.col("newer") > F.col("view"), F.col("broker"))).alias("n"))
    joined = top.join(hidden, "partition")
    return joined.select(
        "partition",
        F.when(F.col("n") * 2 <= voters, F.col("leader")).alias("leader"),
        "view",
        F.when(F.col("leaders") > 1, F.lit(int(Error.STALE_AUTHORITY))).alias("error_code"),
    )


def logical_lane(writer: Column, copies: int, redundant: int) -> Column:
    """The feed that a writer sends: the first ``redundant`` feeds (all if 0) have ``copies`` writers."""
    shared = F.floor(writer / copies).cast("long")
    return shared if redundant == 0 else F.when(writer < redundant * copies, shared).otherwise(writer - redundant * (copies - 1))


def feed_partition(lane: Column, hot: int, partitions: int) -> Column:
    """Copies of a feed share a partition; the first ``hot`` feeds share partition 0."""
    if hot == 0:
        return F.pmod(lane, F.lit(partitions)).cast("int")
    return F.when((lane < hot) | F.lit(partitions == 1), F.lit(0)).otherwise(1 + F.pmod(lane - hot, F.lit(max(1, partitions - 1)))).cast("int")
