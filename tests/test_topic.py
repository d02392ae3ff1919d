"""Send, send again, read on: one topic over several batches."""

from tidewater.topic import Topic

SCHEMA = "arrival_seq long, partition int, key binary, message_id string, producer_id string, producer_epoch long, sequence long, parts array<binary>, append_ms long"


def rows(spark, *each):
    return spark.createDataFrame([(k, 0, None, i, "p", 1, s, [body], t) for k, (s, i, body, t) in enumerate(each)], SCHEMA)


def answers(df):
    return [(r.sequence, r.disposition, r.offset, r.error_code) for r in sorted(df.collect(), key=lambda r: r.sequence)]


def test_retries_and_conflicts(spark, tmp_path):
    t = Topic(spark, f"file://{tmp_path}/t", 2)
    assert answers(t.send(rows(spark, (0, "a", b"1", 5), (1, "b", b"2", 6)))) == [(0, "stored", 0, None), (1, "stored", 1, None)]
    again = t.send(rows(spark, (1, "b", b"2", 9), (0, "a", b"other", 9), (2, "c", b"3", 9)))
    assert answers(again) == [(0, None, None, 8), (1, "retry", 1, None), (2, "stored", 2, None)]
    assert sorted(r.message_id for r in t.read().collect()) == ["a", "b", "c"]
    assert [r.message_id for r in t.read(at_ms=7).collect()] == ["c"]
    mark = t.checkpoint(t.read().where("offset < 2"))
    assert [r.message_id for r in t.read(checkpoint=mark).collect()] == ["c"]
    assert t.read(partitions=[1]).count() == 0


def test_dedup_across_sends(spark, tmp_path):
    t = Topic(spark, f"file://{tmp_path}/t", 1, dedup_window_ms=10)
    assert answers(t.send(rows(spark, (0, "a", b"1", 0), (1, "a", b"1", 3)))) == [(0, "stored", 0, None), (1, "duplicate", 0, None)]
    assert answers(t.send(rows(spark, (2, "a", b"1", 9), (3, "b", b"1", 9), (4, "a", b"1", 10)))) == [(2, "duplicate", 0, None), (3, "stored", 1, None), (4, "stored", 2, None)]


def test_keyed_routing(spark, tmp_path):
    t = Topic(spark, f"file://{tmp_path}/t", 16)
    df = spark.createDataFrame([(0, None, b"customer-17", "a", "p", 1, 0, [b""], 0)], SCHEMA)
    assert t.send(df).first().partition == 12


def test_repeats_and_gaps_inside_one_send(spark, tmp_path):
    """0, 1, 5, 2 and 1 twice: what is refused changes nothing, a repeat gets the first receipt, other content is a conflict."""
    t = Topic(spark, f"file://{tmp_path}/t", 1)
    out = t.send(rows(spark, (0, "a", b"1", 1), (1, "b", b"1", 2), (5, "f", b"1", 3), (1, "b", b"1", 4), (2, "c", b"1", 5), (2, "c", b"x", 6))).collect()
    got = sorted((r.sequence, r.disposition or "", r.offset if r.offset is not None else -1, r.error_code or 0) for r in out)
    assert got == [(0, "stored", 0, 0), (1, "retry", 1, 0), (1, "stored", 1, 0), (2, "", -1, 8), (2, "stored", 2, 0), (5, "", -1, 7)]
    assert [r.message_id for r in t.in_order()] == ["a", "b", "c"]
    assert t.statistics().first().stored == 3


def test_a_writer_that_stopped_before_its_receipts(spark, tmp_path):
    t = Topic(spark, f"file://{tmp_path}/t", 1)
    first = rows(spark, (0, "a", b"1", 5), (1, "b", b"2", 6))
    t.send(first)
    import shutil

    shutil.rmtree(tmp_path / "t" / "receipts")
    assert answers(t.send(first)) == [(0, "retry", 0, None), (1, "retry", 1, None)]
    assert t.read().count() == 2
