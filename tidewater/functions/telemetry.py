"""Counters, histograms, percentiles, rates, latency cohorts and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import ordering


def bit_length(x: Column) -> Column:
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def stage_bin(ns: Column) -> Column:
    """Bin of a stage histogram: eight bins for each power of two."""
    shift = F.greatest(bit_length(ns) - 4, F.lit(0))
    return (8 * shift + _shifted(ns, shift)).cast("int")


def _shifted(x: Column, by: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), by)).cast("long")


def stage_upper(bin_: Column) -> Column:
    """Largest value of a bin."""
    scale = F.floor(bin_ / 8) - 1
    return F.when(bin_ < 16, bin_.cast("long")).otherwise(((9 + bin_ % 8) * F.pow(F.lit(2.0), F.greatest(scale, F.lit(0)))).cast("long") - 1)


def stage_histogram(samples: DataFrame, keys: list[str], ns: str = "ns") -> DataFrame:
    return samples.groupBy(*keys, stage_bin(F.col(ns)).alias("bin")).agg(F.count("*").alias("n"), F.sum(ns).alias("total_ns"), F.max(ns).alias("max_ns"))


def merge_histograms(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of lanes or workers as one."""
    return histograms.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("total_ns").alias("total_ns"), F.max("max_ns").alias("max_ns"))


def histogram_quantiles(histogram: DataFrame, keys: list[str], per_cent: list[int], upper=stage_upper) -> DataFrame:
    """Quantiles as the upper bound of the bin that holds the rank, never above the largest sample."""
    w = Window.partitionBy(*keys)
    before = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = histogram.withColumns({"_cum": F.sum("n").over(before), "_all": F.sum("n").over(w)})
    at = lambda p: F.min(F.when(F.col("_cum") >= F.ceil(F.col("_all") * p / 100), F.col("bin")))
    top = cum.groupBy(*keys).agg(F.sum("n").alias("samples"), F.max("max_ns").alias("max_ns"), *(at(p).alias(f"_p{p}") for p in per_cent))
    return top.select(*keys, "samples", "max_ns", *(F.least(upper(F.col(f"_p{p}")), F.col("max_ns")).alias(f"p{p}") for p in per_cent))


def latency_bin(us: Column) -> Column:
    """Bin of a latency histogram: 64 bins for each power of two."""
    shift = F.greatest(bit_length(us) - 7, F.lit(0))
    return (64 * shift + _shifted(us, shift)).cast("int")


def latency_upper(bin_: Column) -> Column:
    scale = F.floor(bin_ / 64) - 1
    return F.when(bin_ < 128, bin_.cast("long")).otherwise(((65 + bin_ % 64) * F.pow(F.lit(2.0), F.greatest(scale, F.lit(0)))).cast("long") - 1)


def nearest_rank(df: DataFrame, keys: list[str], value: str, per_mille: list[int], block: float = 1.0) -> DataFrame:
    """Exact percentiles by nearest rank; null where there are no values.  Equal values are one
    row, and ranks are counted in blocks of values, ``block`` wide."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = ordering.running(counted, keys, "_v", F.col("_n"), "_rank", "sum", block)
    total = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    at = lambda p: F.min(F.when(F.col("_rank") >= F.greatest(F.ceil(F.col("_all") * p / 1000), F.lit(1)), F.col("_v"))).alias(f"p{p}")
    found = ranked.join(total, keys).groupBy(*keys).agg(*map(at, per_mille))
    return df.select(*keys).distinct().join(found, keys, "left")


def counter_totals(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Counters over threads: counts and gauges add up, of peaks the largest counts."""
    return counters.groupBy(*keys, "event", "kind").agg(F.when(F.col("kind") == "peak", F.max("value")).otherwise(F.sum("value")).alias("value"))


def rate(value: Column, before: Column, elapsed_ms: Column) -> Column:
    """Per second; null where it went back or no time passed."""
    return F.when((value >= before) & (elapsed_ms > 0), (value - before) * 1000.0 / elapsed_ms)


def rates(snapshots: DataFrame, keys: list[str], at: str = "uptime_ms", value: str = "value") -> DataFrame:
    """The rate of each snapshot against the one before; rows without value are left out first."""
    known = ordering.lagged(snapshots.where(F.col(value).isNotNull()), keys, at, {value: "_value", at: "_at"})
    return known.withColumn("rate", rate(F.col(value), F.col("_value"), F.col(at) - F.col("_at"))).drop("_value", "_at")


def counter_deltas(snapshots: DataFrame, keys: list[str], start_ms: int) -> DataFrame:
    """What each counter came to since the measurement's start: its last value less that of the
    last snapshot at or before the start (0 without one), which wraps with the counter."""
    before = F.max_by(F.when(F.col("uptime_ms") <= start_ms, F.col("value")), F.when(F.col("uptime_ms") <= start_ms, F.col("uptime_ms")))
    both = snapshots.groupBy(*keys).agg(before.alias("_start"), F.max_by("value", "uptime_ms").alias("_end"), F.max("uptime_ms").alias("_at"))
    delta = F.col("_end") - F.coalesce("_start", F.lit(0))
    return both.select(*keys, delta.alias("delta"), F.when(F.col("_at") > start_ms, delta * 1000.0 / (F.col("_at") - start_ms)).alias("per_second"))


def per_second(events: DataFrame, at_ms: str, start_ms: int, end_ms: int, keys: list[str]) -> DataFrame:
    """Events by second of the half-open window from start to end."""
    inside = events.where((F.col(at_ms) >= start_ms) & (F.col(at_ms) < end_ms))
    return inside.groupBy(*keys, F.floor((F.col(at_ms) - start_ms) / 1000).cast("long").alias("second")).agg(F.count("*").alias("n"))


def cohort(requests: DataFrame, start_ms: int, end_ms: int, keys: list[str]) -> DataFrame:
    """Latency of what was submitted inside the window, however late it ended; rate of what
    was completed inside it, whenever it was submitted."""
    within = lambda c: (F.col(c) >= start_ms) & (F.col(c) < end_ms)
    late = F.when(within("submitted_ms"), F.col("completed_ms") - F.col("submitted_ms"))
    return requests.groupBy(*keys).agg(F.count_if(within("submitted_ms")).alias("submitted"), F.count_if(within("completed_ms")).alias("completed"), F.max(late).alias("max_latency_ms"), (F.count_if(within("completed_ms")) * 1000.0 / (end_ms - start_ms)).alias("per_second"))


def staged(requests: DataFrame, stages: DataFrame) -> DataFrame:
    """Latency and lag from the due time, by the stage of a load ramp that the due time is in.
    A ramp has a handful of stages, each from ``start_ms`` to the next one's."""
    bounds = stages.select("stage", "start_ms", "end_ms")
    joined = requests.join(bounds, (F.col("due_ms") >= F.col("start_ms")) & (F.col("due_ms") < F.col("end_ms")))
    return joined.groupBy("stage").agg(F.count("*").alias("n"), F.max(F.col("submitted_ms") - F.col("due_ms")).alias("max_lag_ms"), F.max(F.col("completed_ms") - F.col("due_ms")).alias("max_latency_ms"))


def dispositions(receipts: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    return receipts.groupBy(*keys).agg(count("stored"), count("duplicate"), count("scheduled"), F.count("*").alias("attempts"))


def duplicate_share(attempts: DataFrame, keys: list[str]) -> DataFrame:
    unique = F.count_distinct("message_id")
    return attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), unique.alias("unique_ids"), ((F.count("*") - unique) / F.count("*")).alias("duplicate_fraction"))


def case_summary(measurements: DataFrame, case: list[str]) -> DataFrame:
    """Median (of two middle values the midpoint), least and largest of each metric; a failed
    run fails the case."""
    return measurements.groupBy(*case, "metric").agg(F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("runs"), F.bool_or("failed").alias("failed"))


def complete_runs(ledger: DataFrame) -> DataFrame:
    """Measurements of the runs that completed and didn't fail."""
    runs = lambda kind: ledger.where(F.col("kind") == kind).select("run_id").distinct()
    measured = ledger.where("kind = 'measurement'")
    return measured.join(runs("run-complete"), "run_id", "left_semi").join(runs("run-failed"), "run_id", "left_anti")


def regressions(baseline: DataFrame, candidate: DataFrame, case: list[str], throughput: list[str]) -> DataFrame:
    """Summaries compared case by case.  A throughput at 0.95 of its median or less, another
    metric at 1.05 or more, is a regression; so is a case that either side lacks, or that
    has fewer than two runs."""
    key = [*case, "metric"]
    side = lambda df, p: df.select(*key, *(F.col(c).alias(f"{p}_{c}") for c in ("median", "min", "max", "runs")))
    joined = side(baseline, "base").join(side(candidate, "new"), key, "full_outer")
    ratio = F.col("new_median") / F.col("base_median")
    worse = F.when(F.col("metric").isin(throughput), ratio <= 0.95).otherwise(ratio >= 1.05)
    lacking = F.coalesce(F.least("base_runs", "new_runs") < 2, F.lit(True)) | ratio.isNull()
    return joined.select(
        *key,
        ((ratio - 1) * 100).alias("delta_percent"),
        F.coalesce(worse | lacking, F.lit(True)).alias("regression"),
        ((F.col("base_min") <= F.col("new_max")) & (F.col("new_min") <= F.col("base_max"))).alias("overlapping"),
    )


def due_ns(index: Column, per_second_: int, period_ms: int = 1, active_ms: int = 1) -> Column:
    """When an arrival of an offered load is due, in nanoseconds from its start: evenly spaced at
    the rate; in bursts each period's arrivals are moved together into its active part."""
    period = period_ms * 1_000_000
    whole = lambda x: F.floor(x).cast("long")
    steady = whole(index.cast("decimal(20,0)") * 1_000_000_000 / per_second_)
    if period_ms == active_ms:
        return steady
    return whole(steady / period) * period + whole(F.pmod(steady, F.lit(period)) * active_ms / period_ms)


def due_in_ramp(index: Column, stages: list[tuple[int, int]]) -> Column:
    """The same for a ramp of (rate, seconds): each stage starts where the one before has ended."""
    due, first, start = F.lit(None).cast("long"), 0, 0
    for rate_, seconds in stages:
        due = F.when((index >= first) & (index < first + rate_ * seconds), start + due_ns(index - first, rate_)).otherwise(due)
        first, start = first + rate_ * seconds, start + seconds * 1_000_000_000
    return due


def lateness_of_load(arrivals: DataFrame, keys: list[str], per_second_: int, period_ms: int = 1, active_ms: int = 1) -> DataFrame:
    """How far arrivals (``index, at_ms``, from 0) are from a load that was offered: per key their
    number, the latest, and how many came before they were due."""
    due = F.floor(due_ns(F.col("index"), per_second_, period_ms, active_ms) / 1_000_000).cast("long")
    late = arrivals.withColumn("_late", F.col("at_ms") - due)
    return late.groupBy(*keys).agg(F.count("*").alias("arrivals"), F.max("_late").alias("max_late_ms"), F.count_if(F.col("_late") < 0).alias("early"))


def run_summary(requests: DataFrame, keys: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """A run (``submitted_ms, confirmed_ms, delivered_ms`` or null, ``message_id``): rates inside
    the window from start to end, totals, distinct records, and how long it took to drain."""
    inside = lambda c: F.count_if((F.col(c) >= start_ms) & (F.col(c) < end_ms))
    seconds = (end_ms - start_ms) / 1000
    drain = lambda c: F.greatest(F.max(c) - end_ms, F.lit(0)) / 1000.0
    return requests.groupBy(*keys).agg(
        *((inside(f"{c}_ms") / seconds).alias(f"{c}_per_second") for c in ("submitted", "confirmed", "delivered")),
        F.count("confirmed_ms").alias("total_confirmed"),
        F.count_distinct(F.when(F.col("delivered_ms").isNotNull(), F.col("message_id"))).alias("total_verified"),
        drain("confirmed_ms").alias("writer_drain_s"),
        drain("delivered_ms").alias("reader_drain_s"),
    )


def group_processing(acks: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Processing by groups (``acks``: outcome confirmed, redelivered or fenced; ``updates``: one row
    for each request): counts, and acknowledgements for each request, null without any."""
    told = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    counted = acks.groupBy(*keys).agg(told("confirmed"), told("redelivered"), told("fenced"))
    asked = updates.groupBy(*keys).agg(F.count("*").alias("update_requests"))
    joined = counted.join(asked, keys, "full_outer").fillna(0, ["confirmed", "redelivered", "fenced", "update_requests"])
    return joined.withColumn("acknowledgments_per_update", F.col("confirmed") / F.nullif("update_requests", F.lit(0)))


def newest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The bounded report of the newest rows."""
    return rows.orderBy(*order).limit(most)


def labelled(totals: DataFrame, labels: DataFrame, show_zero: bool = False) -> DataFrame:
    """Counters under the labels of a screen; zero ones only on demand."""
    shown = labels.join(totals, "event", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return shown if show_zero else shown.where("value <> 0")


def digest(*columns: str) -> Column:
    """Digest of a table's rows in whatever order: the sum of 48 bits of each row's hash, in which,
    unlike in an exclusive or, no repeat cancels out."""
    row = F.sha2(F.concat_ws("/", *columns), 256)
    return F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")


def lane_digests(records: DataFrame) -> DataFrame:
    """For each lane count and digest of what is where, to hold writers against readers."""
    return records.groupBy("lane").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), digest("lane_sequence", "message_id").alias("digest"))


def selected_runs(runs: DataFrame, case: list[str], compatible: list[str]) -> DataFrame:
    """Of each case the runs that agree with its newest run in what must be compatible."""
    w = Window.partitionBy(*case).orderBy(F.desc("started_ms"), F.desc("run_id"))
    newest_ = runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*case, *compatible)
    return runs.join(newest_, [*case, *compatible], "left_semi")
