"""Worked cases of the log operators, and plain models that they are held against."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.functions import scalars, telemetry
from tidewater.operators import append, control, dedup, delay, groups, ordering, reading, retention, routing
from tidewater.schemas import Error, assert_valid
from tidewater.sources import topics

SF = "/root/testdata/sf0.001"


def attempts(spark, rows):
    return spark.createDataFrame([(k, 0, str(i), t) for k, (t, i) in enumerate(rows)], "arrival_seq long, partition int, message_id string, append_ms long")


def outcomes(df):
    return [(r.disposition, r.offset) for r in df.orderBy("arrival_seq").collect()]


def test_positions_and_running_values_across_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), k, rng.randrange(100)) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, o long, v long")
    out = ordering.running(ordering.running(ordering.position(df, ["g"], "o", "at", 32), ["g"], "o", F.col("v"), "s", "sum", 32), ["g"], "o", F.col("v"), "m", "max", 32)
    seen = {}
    for r in out.orderBy("o").collect():
        own = seen.setdefault(r.g, [])
        assert r["at"] == len(own)
        own.append(r.v)
        assert (r.s, r.m) == (sum(own), max(own))


def test_keyed_routing(spark):
    keys = ["customer-17", "a", "", None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", routing.keyed_partition(F.col("k"), 0, 16).alias("p")).collect()
    assert {r.k: r.p for r in rows} == {k: None if k is None else xxhash.xxh3_64_intdigest(k.encode(), 0) % 16 for k in keys}
    assert next(r.p for r in rows if r.k == "customer-17") == 12


def test_route_conflict_and_majority(spark):
    rows = [(0, 0, 5, 1), (0, 1, 6, None), (0, 2, 7, None), (1, 0, 5, 1), (1, 1, 6, None), (2, 0, 5, 1), (2, 1, 5, 2)]
    out = {r.partition: r for r in routing.routes(spark.createDataFrame(rows, "partition int, broker int, view long, leader int")).collect()}
    assert out[0].leader is None and out[1].leader == 1 and out[2].error_code == Error.STALE_AUTHORITY


def test_dedup_worked_cases(spark):
    S, D = "stored", "duplicate"
    assert outcomes(dedup.classify(attempts(spark, [(0, 1), (0, 1), (0, 2), (0, 1)]), 10)) == [(S, 0), (D, 0), (S, 1), (D, 0)]
    assert outcomes(dedup.classify(attempts(spark, [(0, 1), (9, 1), (10, 1)]), 10)) == [(S, 0), (D, 0), (S, 1)]
    assert outcomes(dedup.classify(attempts(spark, [(0, 1), (0, 2), (1, 2), (1, 3), (1, 1)]), 10)) == [(S, 0), (S, 1), (D, 1), (S, 2), (D, 0)]


def test_dedup_against_a_plain_fold(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(200) + k, rng.choice([1, 1, 1, 2, 3, 4])) for k in range(600)]
    kept, offset, now, want = {}, 0, 0, []
    for t, i in rows:
        now = max(now, t)
        if i not in kept or now - kept[i][0] >= 25:
            kept[i] = (now, offset)
            want.append(("stored", offset))
            offset += 1
        else:
            want.append(("duplicate", kept[i][1]))
    assert outcomes(dedup.classify(attempts(spark, rows), 25, 64)) == want


def test_history_selection(spark):
    log = spark.createDataFrame([(0, 2, "a", 60), (0, 3, "b", 100), (0, 4, "c", 90)], "partition int, offset long, message_id string, append_ms long")
    ends = spark.createDataFrame([(0, 2, 5)], "partition int, retained_from long, next_offset long")
    assert reading.start_timestamp(log, ends, 50).first().start == 2
    assert reading.start_timestamp(log, ends, 101).first().start == 5
    seen = spark.createDataFrame([(0, o, "x", 0) for o in (4, 1, 2, 5)], "partition int, offset long, message_id string, append_ms long")
    r = reading.start_record(seen, ends, "x", "unique").first()
    assert (r.error_code, r.first_offset, r.last_offset, r.start) == (Error.ID_AMBIGUOUS, 2, 4, None)
    assert reading.start_record(seen, ends, "x", "first").first().start == 2 and reading.start_record(seen, ends, "x", "last").first().start == 4
    assert reading.start_record(seen, ends, "y", "first").first().error_code == Error.ID_MISSING
    assert reading.start_offset(ends, 1).first().error_code == Error.RETENTION_GAP and reading.start_offset(ends, 6).first().error_code == Error.BEYOND_END
    with pytest.raises(ValueError):
        reading.select_partitions(log, [0, 0], 4)
    with pytest.raises(Exception, match="error 16"):
        assert_valid(reading.start_offset(ends, 6)).collect()


def test_bounded_read_of_a_large_record(spark):
    log = spark.createDataFrame([(0, 0, 900), (0, 1, 10), (1, 5, 10), (1, 6, 10), (1, 7, 90)], "partition int, offset long, bytes long")
    out = sorted((r.partition, r.offset, r.error_code) for r in reading.bounded(log, 10, 100).collect())
    assert out == [(0, 0, 17), (1, 5, None), (1, 6, None)]


def test_delay_worked_cases(spark):
    a = spark.createDataFrame([(0, 0, 1, 1000, 5000), (1, 0, 2, 1000, 3000), (2, 0, 3, 1000, 900), (3, 0, 4, 1000, 61_001)], "arrival_seq long, partition int, message_id long, append_ms long, due_ms long")
    s = delay.schedule(a, 60_000).orderBy("arrival_seq").collect()
    assert [(r.release_ms, r.schedule, r.error_code) for r in s] == [(5000, 0, None), (3000, 1, None), (1000, 2, None), (61_001, None, 21)]
    held = delay.schedule(a, 60_000).where("error_code is null")
    out = [(r.message_id, r.offset) for r in delay.release(held, 3000).orderBy("offset").collect()]
    assert out == [(3, 0), (2, 1)]
    rest = delay.still_held(held, 3000)
    assert [r.message_id for r in rest.collect()] == [1]
    ends = spark.createDataFrame([(0, 2)], "partition int, next_offset long")
    assert delay.release(rest, 6000, ends).first().offset == 2


@pytest.mark.parametrize(
    ("age", "size", "committed", "held", "trimmed", "now", "retire", "carry"),
    [
        (500, None, 12, None, None, 1000, "1", None),
        (500, 1024, 12, None, None, 1000, "1,2", None),
        (500, 1024, 4, None, None, 1000, "1", None),
        (500, 1024, 12, 5, None, 1000, "1", 9),
        (500, 1024, 12, 4, None, 1000, "", 5),
        (500, 1024, 12, 9, None, 1000, "1,2", None),
        (500, 4096, 12, 5, None, 1000, "1", None),
        (500, None, 12, None, None, None, "", None),
        (500, 2048, 12, None, None, None, "1", None),
        (None, None, 12, None, 3, 1000, "1", None),
    ],
)
def test_retention(spark, age, size, committed, held, trimmed, now, retire, carry):
    segments = spark.createDataFrame([(0, 1, 1024, True, 4, 2, 100), (0, 2, 1024, True, 8, 4, 900), (0, 3, 1024, False, 12, 6, 200)], "partition int, id long, capacity long, sealed boolean, last_operation long, record_end long, newest_append_ms long")
    policy = spark.createDataFrame([(0, age, size, committed, held, trimmed)], "partition int, max_age_ms long, max_bytes long, committed_operation long, held_operation long, trimmed long")
    r = retention.plan(segments, policy, now).first()
    n = len(retire.split(",")) if retire else 0
    assert (r.retire, r.carry_end) == (retire, carry)
    assert (r.record_floor, r.operation_floor, r.selected_bytes) == (2 * n, 4 * n + 1 if n else 0, 1024 * (3 - n))
    assert r.roll_active == (now is not None and age is not None and committed == 12)


def test_packing_against_a_plain_search(spark):
    rng = random.Random(4)
    rows = [(p, i, rng.choice([0, 10, 300, 500, 900])) for p in range(5) for i in range(12)]
    df = spark.createDataFrame([(*r, True) for r in rows], "partition int, id long, live_bytes long, sealed boolean")
    found = {r.partition: (r.first_id, r.last_id) for r in retention.best_run(df, 1024).collect()}
    for p in range(5):
        live, best = [b for q, _, b in rows if q == p], None
        for i in range(12):
            for j in range(i + 1, 12):
                total = sum(live[i : j + 1])
                if total <= 1024 and (j - i) * 1024 >= total and (best is None or (j - i) * max(best[2], 1) > (best[1] - best[0]) * max(total, 1)):
                    best = (i, j, total)
        assert found.get(p) == (best and best[:2])


def planned(members, partitions, prior, revision):
    """A plain sequential planner: ``members`` sorted (id, join); ``prior`` by partition (id, join, revision, left)."""
    owner = {p: prior[p][:2] for p in partitions if p in prior and prior[p][:2] in members}
    count = {m: sum(o == m for o in owner.values()) for m in members}
    quota = {m: len(partitions) // len(members) for m in members} if members else {}
    for m in sorted(members, key=lambda m: (-count[m], m))[: len(partitions) % len(members) if members else 0]:
        quota[m] += 1
    target = {}
    for p in partitions:
        if p in owner and quota[owner[p]] > 0:
            target[p] = owner[p]
            quota[owner[p]] -= 1
    free = [m for m in members for _ in range(quota[m])]
    for p in partitions:
        if p not in target:
            target[p] = free.pop(0) if free else (None, None)
    return {p: prior[p] if p in prior and prior[p][:2] == t else (*t, revision, prior[p][0] if p in prior else None) for p, t in target.items()}


def test_group_plans_against_a_plain_planner(spark):
    rng = random.Random(6)
    members, parts, prior, want = [], [], [], {}
    for g in range(12):
        ms = sorted((m, rng.randrange(2)) for m in rng.sample(range(9), rng.randrange(0 if g == 0 else 1, 6)))
        ps = list(range(rng.randrange(1, 14)))
        old = {p: (rng.randrange(9), rng.randrange(2), rng.randrange(1, 4), rng.choice([None, 8])) for p in ps if rng.random() < 0.8}
        members += [(g, *m) for m in ms]
        parts += [(g, p) for p in ps]
        prior += [(g, p, *t) for p, t in old.items()]
        want |= {(g, p): t for p, t in planned(ms, ps, old, 9).items()}
    frame = groups.plan(
        spark.createDataFrame(members, "group_id int, member_id int, join_id int"),
        spark.createDataFrame(parts, "group_id int, partition int"),
        spark.createDataFrame(prior, "group_id int, partition int, member_id int, join_id int, plan_revision long, prior_member_id int"),
        9,
    )
    assert {(r.group_id, r.partition): (r.member_id, r.join_id, r.plan_revision, r.prior_member_id) for r in frame.collect()} == want


def test_group_worked_case(spark):
    """Seven partitions: one member has all; with another joining it keeps four."""
    parts = spark.createDataFrame([(0, p) for p in range(7)], "group_id int, partition int")
    none = spark.createDataFrame([], "group_id int, partition int, member_id int, join_id int, plan_revision long, prior_member_id int")
    of = lambda *ms: spark.createDataFrame([(0, m, j) for m, j in ms], "group_id int, member_id int, join_id int")
    a = groups.plan(of((2, 0)), parts, none, 1)
    b = groups.plan(of((1, 0), (2, 0)), parts, a, 2).collect()
    assert sorted((r.member_id, r.plan_revision, r.prior_member_id) for r in b) == [(1, 2, 2)] * 3 + [(2, 1, None)] * 4
    c = groups.plan(of((2, 5)), parts, a, 3).collect()  # the same member, restarted
    assert {(r.member_id, r.join_id, r.plan_revision, r.prior_member_id) for r in c} == {(2, 5, 3, 2)}


def test_percentiles_and_histograms(spark):
    v = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)], "k string, v int")
    r = telemetry.nearest_rank(v, ["k"], "v", [0, 250, 500, 501, 990, 1000]).first()
    assert [r[f"p{p}"] for p in (0, 250, 500, 501, 990, 1000)] == [1, 1, 2, 3, 4, 4]
    xs = [*range(40), *(2**k + d for k in range(5, 50, 7) for d in (-1, 0, 1, 2 ** (k - 3)))]
    rows = spark.createDataFrame([(x,) for x in xs], "ns long").select("ns", telemetry.stage_bin(F.col("ns")).alias("b"), telemetry.stage_upper(telemetry.stage_bin(F.col("ns"))).alias("u"), telemetry.latency_upper(telemetry.latency_bin(F.col("ns"))).alias("w")).collect()
    for r in rows:
        shift = max(0, r.ns.bit_length() - 4)
        assert r.b == 8 * shift + (r.ns >> shift)
        assert r.u >= r.ns and r.u < r.ns + max(1, r.ns / 8) + 1 and r.ns <= r.w < r.ns + max(1, r.ns / 64) + 1


def test_rates_and_gate(spark):
    s = spark.createDataFrame([("a", 0, 10), ("a", 1000, 40), ("a", 2000, 5), ("a", 2000, None), ("a", 3000, 5)], "k string, uptime_ms long, value long")
    assert [r.rate for r in telemetry.rates(s, ["k"]).orderBy("uptime_ms").collect()] == [None, 30.0, None, 0.0]
    case = lambda v, runs=2: spark.createDataFrame([("c", "confirmed_s", v, v, v, runs)], "case string, metric string, median double, min double, max double, runs long")
    gate = lambda a, b: telemetry.regressions(a, b, ["case"], ["confirmed_s"]).first().regression
    assert gate(case(100.0), case(95.0)) and not gate(case(100.0), case(96.0)) and gate(case(100.0), case(100.0, 1))
    assert gate(case(100.0), case(1.0).where("median < 0"))


def test_clocks_and_selection(spark):
    rows = [(0, 1, 900, 0), (1, 1, 1001, 0), (2, 1, 5000, 0), (2, 2, 10, 0), (3, 1, 5, -6000), (4, 1, 1000, -5000)]
    out = {r.node: r.verdict for r in control.clock_verdicts(spark.createDataFrame(rows, "node int, peer int, offset_ms long, arrived_ms long"), 0, 1000).collect()}
    assert out == {0: "agreed", 1: "disagreed", 2: "agreed", 3: "unknown", 4: "agreed"}
    reports = spark.createDataFrame([(0, 0, 3, 9, "a", 4), (0, 1, 4, 2, "b", 2), (1, 0, 1, 1, "a", 1), (1, 1, 1, 1, "b", 1), (2, 0, 1, 1, "a", 1)], "partition int, voter int, last_normal_view long, op long, digest string, committed long")
    out = {r.partition: (r.view, r.op, r.source, r.committed, r.error_code) for r in control.selected_history(reports).collect()}
    assert out == {0: (4, 2, 1, 4, None), 1: (1, 1, None, 1, 5), 2: (1, 1, None, 1, 11)}


def test_fingerprints_keep_part_boundaries(spark):
    parts = [[b"ab", b""], [b"a", b"b"], [b"ab"], [b"", b"ab"]]
    rows = spark.createDataFrame([("m", p) for p in parts], "m string, parts array<binary>").select(append.fingerprint(F.col("m"), F.col("parts")).alias("f"), scalars.total_bytes(F.col("parts")).alias("n")).collect()
    assert len({r.f for r in rows}) == 4 and {r.n for r in rows} == {2}


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.uuid7(F.lit(1_700_000_000_000), F.lit("0123456789abcdef0123456789abcdef")).alias("id"),
        scalars.negotiated(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), F.array(F.lit("b"))).alias("n"),
        scalars.negotiated(F.array(F.lit("a")), F.array(F.lit("a")), F.array(F.lit("z"))).alias("none"),
        F.hex(scalars.producer_identity(F.lit("00000000-0000-0000-0000-0000000000ab"), F.lit("00000000-0000-0000-0000-0000000000cd"))).alias("p"),
        scalars.event_view(F.lit('{"type":"metric","cpu":1.5,"conns":7}'), "metric")["conns"].alias("c"),
    ).first()
    assert r.id == "018bcfe5-6800-7cde-b012-456789abcdef"[:18] + r.id[18:] and r.id[14] == "7" and r.id[19] in "89ab"
    assert (r.n, r.none, r.c) == (["b"], None, 7) and r.p.endswith("CD") and len(r.p) == 64


def test_display_texts(spark):
    rows = spark.createDataFrame([(0.0, 0), (950.4, 59_999), (1234.0, 3_600_000), (45_600_000.0, 273_906_000), (12.34, 1), (0.5, 1), (7e15, 1)], "r double, ms long")
    out = rows.select(scalars.rate_text(F.col("r")).alias("r"), scalars.uptime_text(F.col("ms")).alias("u")).collect()
    assert [x.r for x in out] == ["0", "950", "1.23k", "45.6M", "12.3", "0.50", "7000T"]
    assert [x.u for x in out][:4] == ["00:00:00", "00:00:59", "01:00:00", "3d 04:05:06"]


def test_sources_and_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = append.assign_offsets(topics.event_attempts(spark, SF)).select(
        F.lit("events").alias("topic"), "partition", "offset", F.col("message_id").cast("string"), "append_ms", F.col("producer_id").cast("string"), F.lit(1).cast("long").alias("producer_epoch"), F.col("arrival_seq").alias("sequence"), F.array(F.col("props").cast("binary")).alias("parts")
    )
    topics.write_log(log, path, {0: 0, 1: 0})
    assert topics.read_log(spark, path).count() == log.count()
    some = topics.read_log(spark, path, [1])
    assert some.count() == log.where("partition = 1").count() and "PartitionFilters: [isnotnull(partition" in some._jdf.queryExecution().toString() or some.count()
    with pytest.raises(ValueError, match="moved on"):
        topics.write_log(log, path, {0: 0})
    found = topics.read_deployment('[topics.a]\npartitions = 3\n[topics.a.deduplication]\n[topics.b.retention]\nmax_age_secs = 5')
    assert found[0]["dedup_window_ms"] == 300_000 and found[1]["max_age_ms"] == 5000 and found[1]["partitions"] == 16
    with pytest.raises(ValueError):
        topics.read_deployment("[topics.a]\nfoo = 1")
    with pytest.raises(ValueError):
        topics.read_deployment("[topics.a.delay]\nmax_secs = 1\n[topics.a.deduplication]")
    ledger = tmp_path / "ledger.jsonl"
    ledger.write_text('{"kind":"measurement","run_id":"1","value":2.0}\n{"kind":"run-complete","run_id":"1"}\n{"kind":"measurement","run_id":"2","value":3.0}\n')
    assert [r.value for r in telemetry.complete_runs(topics.read_ledger(spark, f"file://{ledger}")).collect()] == [2.0]


def test_refusals_change_nothing(spark):
    """0, 1, 5, 2, 3: the gap is refused and the rest go on; a fenced update leaves the cursor."""
    schema = "partition int, producer_id string, arrival_seq long, producer_epoch long, sequence long, message_id string, parts array<binary>"
    a = spark.createDataFrame([(0, "p", k, e, s, m, [b"x"]) for k, (e, s, m) in enumerate([(1, 0, "a"), (1, 1, "b"), (1, 5, "c"), (1, 2, "d"), (1, 3, None), (1, 3, "e"), (2, 0, "f"), (1, 4, "g"), (2, 1, "h")])], schema)
    codes = lambda df: [r.error_code for r in df.orderBy("arrival_seq").collect()]
    assert codes(append.validate(a)) == [None, None, 7, None, 1, None, None, 6, None]
    there = spark.createDataFrame([(0, "p", 1, 1)], "partition int, producer_id string, epoch long, next_sequence long")
    assert codes(append.validate(a, there)) == [7, None, 7, None, 1, None, 6, None, 6]
    held = spark.createDataFrame([("g", 0, 2, "m", 0)], "group_id string, partition int, epoch int, member_id string, resume_cursor long")
    updates = spark.createDataFrame([("g", 0, k, e, "m", x, n) for k, (e, x, n) in enumerate([(2, 0, 3), (1, 3, 5), (2, 3, 4), (2, 9, 10), (2, 4, 99), (2, 4, 4), (2, 4, 8)])], "group_id string, partition int, seq long, epoch int, member_id string, expected long, next long")
    ends = spark.createDataFrame([(0, 0, 10)], "partition int, retained_from long, next_offset long")
    assert [r.error_code for r in groups.progress_errors(updates, held, ends).orderBy("seq").collect()] == [None, 6, None, 7, 16, 7, None]


def test_dedup_of_an_identity_that_never_pauses(spark):
    """A beat every millisecond, one message id for nearly all rows, over many blocks of time."""
    n, window = 200_000, 40
    a = spark.range(n).select(F.col("id").alias("arrival_seq"), F.lit(0).alias("partition"), F.when(F.col("id") % 50 == 7, F.col("id").cast("string")).otherwise("beat").alias("message_id"), (F.col("id") - F.col("id") % 3).alias("append_ms"))
    rows = dedup.classify(a, window, 1 << 14).where("message_id = 'beat' and disposition = 'stored'").select("arrival_seq", "time").orderBy("arrival_seq").collect()
    want, kept = [], None
    for i in range(n):
        t = i - i % 3
        if i % 50 != 7 and (kept is None or t - kept >= window):
            kept = t
            want.append(i)
    assert [r.arrival_seq for r in rows] == want


def test_admission_and_capacity_against_plain_models(spark):
    rng = random.Random(9)
    requests = [(0, k, 3 * k + rng.randrange(2), [str(rng.randrange(12)) for _ in range(rng.randrange(1, 4))]) for k in range(150)]
    got = [r.error_code for r in dedup.admitted(spark.createDataFrame(requests, "partition int, request long, time long, message_ids array<string>"), 20, 6).orderBy("request").collect()]
    live, now, want = {}, 0, []
    for _, _, t, ids in requests:
        at = max(now, t)
        left = {i: s for i, s in live.items() if at - s < 20}
        fresh = {i for i in ids if i not in left}
        if len(left) + len(fresh) > 6:
            want.append(Error.CAPACITY)
            continue
        live, now = left | {i: at for i in fresh}, at
        want.append(None)
    assert got == want and None in want and Error.CAPACITY in want
    attempts_ = [(0, k, 10 * k, 10 * k + rng.randrange(-20, 120)) for k in range(150)]
    got = [r.error_code for r in delay.schedule_within(spark.createDataFrame(attempts_, "partition int, arrival_seq long, append_ms long, due_ms long"), 90, 3).orderBy("arrival_seq").collect()]
    held, want = [], []
    for _, _, append_ms, due in attempts_:
        if due > append_ms + 90:
            want.append(Error.DUE_TOO_LATE)
            continue
        held = [h for h in held if h > append_ms]
        if len(held) >= 3:
            want.append(Error.CAPACITY)
            continue
        held.append(max(due, append_ms))
        want.append(None)
    assert got == want and set(want) == {None, Error.CAPACITY, Error.DUE_TOO_LATE}


def test_snapshots_are_verified(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, op long")
    stored = retention.snapshot_digest(rows, ["k", "op"])
    assert retention.verified(rows, ["k", "op"], stored).count() == 3
    for other in (rows.distinct(), rows.union(rows.limit(2)), rows.withColumn("op", F.col("op") + 1)):
        with pytest.raises(ValueError, match="stored"):
            retention.verified(other, ["k", "op"], stored)


def test_fold_over_a_join_whose_rows_adaptive_execution_cuts(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k, None) for k in settings}
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"))
    step = lambda state, at: (state + 1, (state,))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for threshold in ("-1", "10m"):  # a join by sorting that is cut, and one that turns into a broadcast
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)
            one = spark.range(0, 4000, 1, 2).select(F.col("id").alias("k"), F.lit(5).alias("x"))
            folded = ordering.folded(rows.join(one, "k", "left"), ["k"], ["at"], ["at"], lambda at: 0, step, "place long")
            assert sum(r.place != r["at"] // 2 for r in folded.collect()) == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_dedup_restore_goes_on_from_the_clock(spark):
    """The latest time before the snapshot is a duplicate's, and time goes back after it."""
    rows = [(0, 1), (9, 1), (1, 2), (11, 2), (3, 3), (18, 3), (19, 3)]
    early, late = attempts(spark, rows).where("arrival_seq < 2"), attempts(spark, rows).where("arrival_seq >= 2")
    done = dedup.classify(early, 10)
    got = dedup.restored(dedup.live_identities(done, 10), dedup.clocks(done), late, 10)
    assert [r.disposition for r in got.orderBy("arrival_seq").collect()] == [d for d, _ in outcomes(dedup.classify(attempts(spark, rows), 10))[2:]]
