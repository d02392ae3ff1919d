"""The named queries of the log operators and the SQL that each is held against.

The events table is a topic of four partitions (users choose theirs), the orders are
attempts of the customers as producers, due on their dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import scalars, telemetry
from tidewater.operators import append, consistency, control, dedup, delay, groups, ordering, reading, retention, routing
from tidewater.sources import topics

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Fixed points of the queries: start of reading, window, now, delay.
T0, WINDOW, DAY = 1_705_000_000_000, 3_600_000, 86_400_000
NOW = 1_706_600_000_000
SHIP_NOW = 915_148_800_000

#: The topic as SQL: attempts and log.
A = "a AS (SELECT event_id AS arrival_seq, CAST(user_id % 4 AS INTEGER) AS \"partition\", user_id AS producer_id, event_id AS message_id, epoch_us(ts) // 1000 AS append_ms, event_type, value, props FROM events)"
L = A + ', l AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY arrival_seq) - 1 AS "offset" FROM a)'
E = L + ', ends AS (SELECT "partition", CAST(0 AS BIGINT) AS retained_from, max("offset") + 1 AS next_offset FROM l GROUP BY 1)'
#: The dedup topic: identity is user and kind of event; the chain of stored attempts by recursion.
D = (
    "RECURSIVE a AS (SELECT event_id AS arrival_seq, CAST(user_id % 4 AS INTEGER) AS \"partition\", user_id || '/' || event_type AS message_id, "
    "max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id % 4 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS time FROM events), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY time, arrival_seq) AS rn FROM a), "
    "c AS (SELECT message_id, \"partition\", rn, arrival_seq, time, arrival_seq AS anchor, time AS anchored FROM n WHERE rn = 1 UNION ALL "
    f"SELECT n.message_id, n.\"partition\", n.rn, n.arrival_seq, n.time, CASE WHEN n.time - c.anchored >= {WINDOW} THEN n.arrival_seq ELSE c.anchor END, "
    f"CASE WHEN n.time - c.anchored >= {WINDOW} THEN n.time ELSE c.anchored END FROM c JOIN n ON n.message_id = c.message_id AND n.rn = c.rn + 1), "
    "s AS (SELECT \"partition\", arrival_seq, row_number() OVER (PARTITION BY \"partition\" ORDER BY arrival_seq) - 1 AS \"offset\" FROM c WHERE anchor = arrival_seq), "
    "o AS (SELECT c.\"partition\", c.message_id, c.arrival_seq, c.time, CASE WHEN c.anchor = c.arrival_seq THEN 'stored' ELSE 'duplicate' END AS disposition, s.\"offset\" FROM c JOIN s ON s.arrival_seq = c.anchor)"
)
#: Orders as attempts, due on their dates, accepted 30 days before or, every fifth, 10 days after.
S = (
    "x AS (SELECT o_orderkey AS arrival_seq, CAST(o_custkey % 4 AS INTEGER) AS \"partition\", o_custkey AS producer_id, o_orderkey AS \"sequence\", "
    "o_orderkey % 2000 AS message_id, epoch_us(o_orderdate) // 1000 AS due_ms, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders), "
    "h0 AS (SELECT *, CASE WHEN message_id % 5 = 0 THEN due_ms + 864000000 ELSE due_ms - 2592000000 END AS append_ms FROM x), "
    "h AS (SELECT *, greatest(due_ms, append_ms) AS release_ms, row_number() OVER (PARTITION BY \"partition\" ORDER BY arrival_seq) - 1 AS schedule FROM h0)"
)
#: Segments of 500 records, the last of each partition open.
G = E + ', g0 AS (SELECT "partition", CAST(floor("offset" / 500) AS BIGINT) AS id, max("offset") + 1 AS record_end, max(append_ms) AS newest_append_ms, max(arrival_seq) AS last_operation, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM l GROUP BY 1, 2), g AS (SELECT *, CAST(8192 AS BIGINT) AS capacity, id <> max(id) OVER (PARTITION BY "partition") AS sealed FROM g0)'


def query(sql: str | None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return topics.event_attempts(spark, d)


def _log(spark: SparkSession, d: str) -> DataFrame:
    return append.assign_offsets(_attempts(spark, d))


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    a = _attempts(spark, d).select("arrival_seq", "partition", F.concat_ws("/", "producer_id", "event_type").alias("message_id"), "append_ms")
    return dedup.classify(a, WINDOW).drop("append_ms")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    x = topics.order_attempts(spark, d)
    return x.withColumn("append_ms", F.when(F.col("message_id") % 5 == 0, F.col("due_ms") + 864000000).otherwise(F.col("due_ms") - 2592000000))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return delay.schedule(_orders(spark, d), 60 * DAY).drop("error_code")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumns({"operation": F.col("arrival_seq"), "bytes": F.octet_length("props").cast("long")})
    made = retention.summaries(log, F.floor(F.col("offset") / 500).cast("long"))
    last = made.groupBy("partition").agg(F.max("id").alias("_last"))
    return made.join(last, "partition").withColumns({"capacity": F.lit(8192).cast("long"), "sealed": F.col("id") != F.col("_last")}).drop("_last")


# --- routing -----------------------------------------------------------------------------


@query(f'WITH {A} SELECT arrival_seq, "partition", CASE WHEN "partition" < 3 THEN NULL ELSE 1 END AS error_code FROM a')
def route_explicit(spark, d):
    return routing.explicit_partition(_attempts(spark, d), "partition", 3).select("arrival_seq", "partition", "error_code")


@query(None)
def route_keyed(spark, d):
    """XXH3 has no SQL form; a test holds it against the library."""
    return _attempts(spark, d).select("arrival_seq", routing.keyed_partition(F.col("producer_id").cast("string"), 0, 16).alias("partition"))


@query("SELECT event_id AS arrival_seq, CAST((event_id // 64) % 4 AS INTEGER) AS \"partition\" FROM events")
def route_sticky(spark, d):
    return _attempts(spark, d).select("arrival_seq", routing.sticky_partition(F.floor(F.col("arrival_seq") / 64), 4).alias("partition"))


@query("SELECT o_orderkey AS view, CASE o_orderkey % 3 WHEN 0 THEN 'b0' WHEN 1 THEN 'b1' ELSE 'b2' END AS leader FROM orders")
def route_leader(spark, d):
    brokers = F.array(*map(F.lit, ("b0", "b1", "b2")))
    return topics.table(spark, d, "orders").select(F.col("o_orderkey").alias("view"), routing.leader_of(brokers, F.col("o_orderkey")).alias("leader"))


@query(
    'WITH r AS (SELECT c_nationkey AS "partition", c_custkey % 3 AS broker, c_custkey AS view, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 3 END AS leader FROM customer), '
    't AS (SELECT "partition", arg_max(leader, view) AS leader, max(view) AS view FROM r WHERE leader IS NOT NULL GROUP BY 1), '
    'n AS (SELECT t."partition", count(DISTINCT CASE WHEN r.view > t.view THEN r.broker END) AS n FROM t LEFT JOIN r ON r."partition" = t."partition" AND r.leader IS NULL GROUP BY 1) '
    'SELECT t."partition", CASE WHEN n.n * 2 <= 3 THEN t.leader END AS leader, t.view, CAST(NULL AS INTEGER) AS error_code FROM t JOIN n USING ("partition")'
)
def route_cache(spark, d):
    c = topics.table(spark, d, "customer")
    leader = F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 3)
    return routing.routes(c.select(F.col("c_nationkey").alias("partition"), (F.col("c_custkey") % 3).alias("broker"), F.col("c_custkey").alias("view"), leader.alias("leader")))


@query(
    "WITH w AS (SELECT s_suppkey AS writer, CASE WHEN s_suppkey < 6 THEN s_suppkey // 3 ELSE s_suppkey - 4 END AS lane FROM supplier) "
    "SELECT writer, lane, CAST(CASE WHEN lane < 2 THEN 0 ELSE 1 + (lane - 2) % 7 END AS INTEGER) AS \"partition\" FROM w"
)
def route_feeds(spark, d):
    w = topics.table(spark, d, "supplier").select(F.col("s_suppkey").alias("writer")).withColumn("lane", routing.logical_lane(F.col("writer"), 3, 2))
    return w.withColumn("partition", routing.feed_partition(F.col("lane"), 2, 8))


# --- append ------------------------------------------------------------------------------


@query(f'WITH {L} SELECT arrival_seq, "partition", "offset" FROM l')
def assign_offsets(spark, d):
    return _log(spark, d).select("arrival_seq", "partition", "offset")


@query(
    "WITH RECURSIVE n AS (SELECT user_id AS k, event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, CAST(floor(value) AS BIGINT) % 3 AS sq, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id // 100 END AS ep, event_id % 13 = 0 AS bad FROM events), "
    "c AS (SELECT k, line, rn, CAST(NULL AS INTEGER) AS error_code, CAST(-1 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS nxt FROM (SELECT DISTINCT k, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS rn FROM n) UNION ALL "
    "SELECT n.k, n.line, n.rn, CASE WHEN n.bad THEN 1 WHEN n.ep < c.cur THEN 6 WHEN n.sq <> CASE WHEN n.ep > c.cur THEN 0 ELSE c.nxt END THEN 7 END, CASE WHEN n.bad THEN c.cur ELSE greatest(c.cur, n.ep) END, "
    "CASE WHEN n.bad OR n.ep < c.cur THEN c.nxt WHEN n.ep > c.cur THEN CASE WHEN n.sq = 0 THEN 1 ELSE 0 END WHEN n.sq = c.nxt THEN c.nxt + 1 ELSE c.nxt END FROM c JOIN n ON n.k = c.k AND n.rn = c.rn + 1) "
    "SELECT k AS producer_id, line AS arrival, error_code FROM c WHERE rn > 0"
)
def validate_attempts(spark, d):
    """Sequences and epochs that go astray: what is refused changes nothing."""
    e = _attempts(spark, d)
    i = F.col("arrival_seq")
    a = e.select(
        "partition",
        "producer_id",
        "arrival_seq",
        F.when(i % 11 == 0, 0).otherwise(F.floor(i / 100)).cast("long").alias("producer_epoch"),
        (F.floor("value").cast("long") % 3).alias("sequence"),
        F.when(i % 13 != 0, F.col("message_id")).alias("message_id"),
        F.array(F.lit("x").cast("binary")).alias("parts"),
    )
    return append.validate(a).select("producer_id", F.col("arrival_seq").alias("arrival"), "error_code")


@query(
    "WITH p AS (SELECT c_custkey AS producer_id, CAST(c_nationkey % 4 AS BIGINT) AS floor, CAST(c_nationkey AS BIGINT) AS nxt FROM customer) "
    "SELECT producer_id, CASE WHEN producer_id % 7 = 0 THEN 6 WHEN producer_id % 5 = 0 OR nxt // 2 <= floor THEN 7 END AS error_code, CASE WHEN producer_id % 7 = 0 OR producer_id % 5 = 0 OR nxt // 2 <= floor THEN floor ELSE nxt // 2 END AS result_floor FROM p"
)
def floor_advances(spark, d):
    """Floors go to half of what was sent; some requests name another epoch or floor."""
    p = topics.table(spark, d, "customer").select(F.lit(0).alias("partition"), F.col("c_custkey").alias("producer_id"), F.lit(3).alias("epoch"), (F.col("c_nationkey") % 4).cast("long").alias("result_floor"), F.col("c_nationkey").cast("long").alias("next_sequence"))
    i = F.col("producer_id")
    ask = p.select("partition", "producer_id", F.when(i % 7 == 0, 2).otherwise(3).alias("epoch"), (F.col("result_floor") + F.when(i % 5 == 0, 1).otherwise(0)).alias("expected_floor"), F.floor(F.col("next_sequence") / 2).alias("new_floor"))
    return append.advance_floors(ask, p).select("producer_id", "error_code", "result_floor")


@query(
    "WITH q AS (SELECT c_custkey AS producer_id, c_custkey % 3 AS mode, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 WHEN c_custkey % 3 = 1 THEN c_nationkey END AS expected, CASE WHEN c_custkey % 4 < 2 THEN c_nationkey END AS live, c_nationkey % 4 AS pt FROM customer), "
    "f AS (SELECT c_nationkey % 4 AS pt, max(c_nationkey) FILTER (c_custkey % 4 >= 2) AS gone FROM customer GROUP BY 1), "
    "r AS (SELECT q.*, f.gone, CASE WHEN mode = 1 AND expected IS NULL OR mode = 2 AND expected IS NOT NULL THEN 1 WHEN expected IS NOT NULL AND expected IS DISTINCT FROM live OR mode = 2 AND live IS NOT NULL THEN 6 END AS error_code FROM q LEFT JOIN f USING (pt)) "
    "SELECT producer_id, error_code, CASE WHEN error_code IS NULL THEN CASE WHEN mode = 0 AND live IS NOT NULL THEN live ELSE greatest(coalesce(live, 0), coalesce(gone, 0)) + 1 END END AS epoch FROM r"
)
def producer_modes(spark, d):
    """Half of the customers have a session; the others' were retired at the number of their nation."""
    c = topics.table(spark, d, "customer").select((F.col("c_nationkey") % 4).alias("partition"), F.col("c_custkey").alias("producer_id"), F.col("c_nationkey").alias("epoch"))
    i = F.col("producer_id")
    ask = c.select("partition", "producer_id", (i % 3).alias("mode"), F.when(i % 5 == 0, F.col("epoch") + 1).when(i % 3 == 1, F.col("epoch")).alias("expected_epoch"))
    live = c.where("producer_id % 4 < 2").withColumn("next_sequence", F.lit(9))
    return append.open_by_mode(ask, live, c.where("producer_id % 4 >= 2").select("partition", "epoch")).select("producer_id", "error_code", "epoch")


@query(
    f"WITH RECURSIVE {L}, n AS (SELECT \"partition\", arrival_seq, \"offset\" + 1 AS rn, octet_length(encode(props)) * (1 + arrival_seq % 9) AS bytes FROM l), "
    'c AS (SELECT DISTINCT "partition", CAST(-1 AS BIGINT) AS arrival_seq, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS t FROM n UNION ALL '
    "SELECT n.\"partition\", n.arrival_seq, n.rn, CASE WHEN c.k > 0 AND (c.k = 7 OR c.t + n.bytes > 200) THEN c.batch + 1 ELSE c.batch END, CASE WHEN c.k > 0 AND (c.k = 7 OR c.t + n.bytes > 200) THEN 1 ELSE c.k + 1 END, "
    'CASE WHEN c.k > 0 AND (c.k = 7 OR c.t + n.bytes > 200) THEN n.bytes ELSE c.t + n.bytes END FROM c JOIN n ON n."partition" = c."partition" AND n.rn = c.rn + 1) SELECT "partition", arrival_seq, batch FROM c WHERE rn > 0'
)
def writer_batches(spark, d):
    a = _attempts(spark, d).withColumn("bytes", F.octet_length("props") * (1 + F.col("arrival_seq") % 9))
    return append.batches(a, 7, 200).select("partition", "arrival_seq", "batch")


@query(f"WITH {D} SELECT \"partition\", count(*) FILTER (disposition = 'stored') AS stored, count(*) FILTER (disposition = 'duplicate') AS duplicate, CAST(0 AS BIGINT) AS retry, CAST(0 AS BIGINT) AS refused, max(\"offset\") AS last_offset FROM o GROUP BY 1")
def writer_stats(spark, d):
    return append.writer_stats(_dedup(spark, d).withColumn("error_code", F.lit(None).cast("int")))


@query("WITH s AS (SELECT conv_id, turn, octet_length(encode(text)) AS n FROM conversations), w AS (SELECT conv_id, count(*) AS k, sum(n) AS t FROM s GROUP BY 1) SELECT conv_id, turn, CASE WHEN n > 2000 THEN 17 WHEN k > 8 OR t > 6000 THEN 1 END AS error_code FROM s JOIN w USING (conv_id)")
def request_limits(spark, d):
    """Conversations as requests, their turns as records."""
    c = topics.table(spark, d, "conversations").select("conv_id", "turn", F.array(F.col("text").cast("binary")).alias("parts"))
    return append.within_limits(c, {"record_bytes": 2000, "parts": 4000, "records": 8, "payload_bytes": 6000}, "conv_id").select("conv_id", "turn", "error_code")


@query("SELECT page_id, CASE WHEN octet_length(encode(html)) + octet_length(encode(url)) > 4096 THEN 17 END AS error_code FROM pages")
def record_limits(spark, d):
    p = topics.table(spark, d, "pages").withColumn("parts", F.array(F.col("html").cast("binary"), F.col("url").cast("binary")))
    return append.within_limits(p, {"record_bytes": 4096, "parts": 4000}).select("page_id", "error_code")


@query(
    f"WITH {S} SELECT producer_id, \"sequence\", CASE WHEN \"sequence\" < 2000 OR (\"sequence\" % 2 = 0 AND message_id % 7 = 0) THEN NULL WHEN \"sequence\" % 2 = 0 THEN 'retry' ELSE 'fresh' END AS disposition, "
    "CASE WHEN \"sequence\" >= 2000 AND \"sequence\" % 2 = 0 AND message_id % 7 <> 0 THEN \"sequence\" + 5 END AS \"offset\", CASE WHEN \"sequence\" < 2000 THEN 9 WHEN \"sequence\" % 2 = 0 AND message_id % 7 = 0 THEN 8 END AS error_code FROM x"
)
def retry_resolution(spark, d):
    x = topics.order_attempts(spark, d).select("partition", "producer_id", F.lit(1).alias("producer_epoch"), "sequence", F.col("message_id").cast("string").alias("fingerprint"))
    known = x.where("sequence % 2 = 0").withColumns({"offset": F.col("sequence") + 5, "fingerprint": F.when(F.col("fingerprint").cast("long") % 7 == 0, "other").otherwise(F.col("fingerprint"))})
    floors = x.select("partition", "producer_id").distinct().withColumn("result_floor", F.lit(2000))
    return append.resolve_retries(x, known, floors).select("producer_id", "sequence", "disposition", "offset", "error_code")


_SPANS = (
    f'WITH {L}, r AS (SELECT "partition", producer_id, row_number() OVER (PARTITION BY producer_id ORDER BY arrival_seq) - 1 AS "sequence", "offset", CASE WHEN value > 900 THEN \'scheduled\' ELSE \'stored\' END AS source FROM l), '
    'i AS (SELECT *, CASE WHEN "sequence" = lag("sequence") OVER w + 1 AND "offset" = lag("offset") OVER w + 1 AND source = lag(source) OVER w THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY "partition", producer_id ORDER BY "sequence")), '
    'k AS (SELECT *, sum(fresh) OVER (PARTITION BY "partition", producer_id ORDER BY "sequence") AS span FROM i), '
    'sp AS (SELECT "partition", producer_id, min("sequence") AS first_sequence, min("offset") AS first_offset, count(*) AS records, min(source) AS source FROM k GROUP BY "partition", producer_id, span) '
)


def _spans(spark, d):
    r = ordering.position(_log(spark, d), ["producer_id"], "arrival_seq", "sequence").withColumn("source", F.when(F.col("value") > 900, "scheduled").otherwise("stored"))
    return append.result_spans(r.select("partition", "producer_id", "sequence", "offset", "source"))


@query(_SPANS + "SELECT * FROM sp")
def result_spans(spark, d):
    return _spans(spark, d)


@query(_SPANS + ', w AS (SELECT "partition", producer_id, "sequence" FROM r) SELECT w.*, sp.source, sp.first_offset + w."sequence" - sp.first_sequence AS "offset" FROM w JOIN sp ON w."partition" = sp."partition" AND w.producer_id = sp.producer_id AND w."sequence" >= sp.first_sequence AND w."sequence" < sp.first_sequence + sp.records')
def span_lookup(spark, d):
    wanted = ordering.position(_log(spark, d), ["producer_id"], "arrival_seq", "sequence").select("partition", "producer_id", "sequence")
    return append.lookup(_spans(spark, d), wanted)


@query(
    _SPANS + ', f AS (SELECT *, CASE WHEN source <> \'stored\' THEN first_offset >= 600 ELSE greatest(700 - first_offset, 0) < records END AS holds, CASE WHEN source <> \'stored\' THEN first_sequence ELSE first_sequence + greatest(700 - first_offset, 0) END AS place FROM sp) '
    'SELECT "partition", producer_id, coalesce(min(CASE WHEN holds THEN place END), max(first_sequence + records)) AS result_floor FROM f GROUP BY 1, 2'
)
def retry_floors(spark, d):
    return append.retry_floors(_spans(spark, d).withColumn("source_operation", F.col("first_offset")), 700, 600)


@query(_SPANS + 'SELECT "partition", producer_id, first_sequence, first_offset, records, source FROM (SELECT *, row_number() OVER (PARTITION BY "partition", producer_id ORDER BY first_sequence DESC) AS n FROM sp) WHERE n <= 5')
def span_eviction(spark, d):
    return append.kept_spans(_spans(spark, d), 5)


@query(f'WITH {L} SELECT "partition", producer_id, max(append_ms) AS last_ms, max(arrival_seq) AS last_sequence FROM l GROUP BY 1, 2 HAVING {NOW} - max(append_ms) >= {DAY}')
def idle_producers(spark, d):
    return append.idle_producers(_attempts(spark, d).withColumn("sequence", F.col("arrival_seq")), NOW, DAY)


@query(
    "WITH p AS (SELECT c_custkey AS producer_id, CAST(c_nationkey AS BIGINT) AS epoch, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_nationkey + 3 AS BIGINT) END AS retired FROM customer), "
    "q AS (SELECT *, CASE WHEN producer_id % 2 = 0 THEN CASE WHEN producer_id % 6 = 0 THEN epoch + 1 ELSE epoch END END AS expected, epoch + producer_id % 4 AS fresh FROM p), "
    "r AS (SELECT *, CASE WHEN coalesce(expected <> epoch, false) OR fresh <= greatest(epoch, coalesce(retired, -1)) THEN 6 END AS error_code FROM q) "
    "SELECT producer_id, error_code, CASE WHEN error_code IS NULL THEN fresh ELSE epoch END AS epoch FROM r"
)
def open_producers(spark, d):
    c = topics.table(spark, d, "customer")
    p = c.select(F.lit(0).alias("partition"), F.col("c_custkey").alias("producer_id"), F.col("c_nationkey").cast("long").alias("epoch"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey").cast("long") + 3).alias("retired_epoch"))
    expected = F.when(F.col("producer_id") % 2 == 0, F.when(F.col("producer_id") % 6 == 0, F.col("epoch") + 1).otherwise(F.col("epoch")))
    q = p.select("partition", "producer_id", expected.alias("expected_epoch"), (F.col("epoch") + F.col("producer_id") % 4).alias("new_epoch"))
    return append.open_producers(q, p).select("producer_id", "error_code", "epoch")


@query("SELECT event_id AS message_id, sha256(event_id || '|2|' || lpad(printf('%X', octet_length(encode(event_type))), 16, '0') || hex(encode(event_type)) || lpad(printf('%X', octet_length(encode(props))), 16, '0') || hex(encode(props))) AS fingerprint FROM events")
def record_fingerprint(spark, d):
    e = topics.table(spark, d, "events")
    parts = F.array(F.col("event_type").cast("binary"), F.col("props").cast("binary"))
    return e.select(F.col("event_id").alias("message_id"), append.fingerprint(F.col("event_id").cast("string"), parts).alias("fingerprint"))


@query("SELECT user_id % 4 AS log, event_id AS op FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS n FROM events) WHERE n > 1 AND event_id % 97 = 0")
def chain_breaks(spark, d):
    """Digests are of the row; every 97th predecessor has been tampered with."""
    log = _log(spark, d).select(F.pmod("producer_id", F.lit(4)).alias("log"), F.col("arrival_seq").alias("id"), (F.col("offset")).alias("op"))
    digest = lambda c: F.sha2(c.cast("string"), 256)
    before = log.select("log", (F.col("op") + 1).alias("op"), F.col("id").alias("_before"))
    ops = log.join(before, ["log", "op"], "left").select("log", "op", "id", digest(F.col("id")).alias("digest"), F.when(F.col("id") % 97 == 0, "tampered").otherwise(digest(F.col("_before"))).alias("predecessor"))
    return append.broken_chain(ops).select("log", F.col("id").alias("op"))


@query(f'WITH {A} SELECT producer_id AS identity, max(arrival_seq) AS op FROM a WHERE arrival_seq BETWEEN 2000 AND 7000 GROUP BY 1')
def live_claims(spark, d):
    return append.live_claims(_attempts(spark, d).select(F.col("producer_id").alias("identity"), F.col("arrival_seq").alias("op")), 2000, 7000)


@query("SELECT n_name AS topic, CAST(n_regionkey + CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS policy_revision, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 1 END AS max_age_ms FROM nation")
def policy_changes(spark, d):
    n = topics.table(spark, d, "nation")
    now = n.select(F.col("n_name").alias("topic"), F.col("n_regionkey").alias("policy_revision"), F.lit(1).alias("max_age_ms"))
    changes = n.select(F.col("n_name").alias("topic"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).otherwise(F.col("n_regionkey") + 1).alias("expected_revision"), F.lit(7).alias("max_age_ms"))
    return append.change_policies(now, changes)


@query(f'WITH {L} SELECT "partition", "offset" AS op, CASE WHEN "offset" < 900 THEN \'first\' ELSE \'second\' END AS generation FROM l WHERE "offset" < 1000')
def committed_prefix(spark, d):
    ops = _log(spark, d).select("partition", F.col("offset").alias("op"), F.lit("first").alias("generation"))
    return append.committed(append.replace_suffix(ops, ops.withColumn("generation", F.lit("second")), 900), 999)


# --- dedup -------------------------------------------------------------------------------


@query(f"WITH {D} SELECT * FROM o")
def dedup_outcomes(spark, d):
    return _dedup(spark, d)


@query(f"WITH {D} SELECT \"partition\", \"offset\", message_id, time FROM o WHERE disposition = 'stored'")
def dedup_kept(spark, d):
    return _dedup(spark, d).where("disposition = 'stored'").select("partition", "offset", "message_id", "time")


@query(
    f'WITH {D}, z AS (SELECT *, CASE WHEN disposition = lag(disposition) OVER w AND "offset" = lag("offset") OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY "partition" ORDER BY arrival_seq)), '
    'y AS (SELECT *, sum(fresh) OVER (PARTITION BY "partition" ORDER BY arrival_seq) AS run FROM z) '
    'SELECT "partition", min(disposition) AS disposition, min(arrival_seq) AS first_arrival, min("offset") AS first_offset, count(*) AS records FROM y GROUP BY "partition", run'
)
def dedup_outcome_runs(spark, d):
    return dedup.outcome_runs(_dedup(spark, d))


_LIVE = f"WITH {D}, m AS (SELECT \"partition\", max(time) AS now FROM o GROUP BY 1), v AS (SELECT \"partition\", message_id, max(time) AS time, max(\"offset\") AS \"offset\" FROM o WHERE disposition = 'stored' GROUP BY 1, 2), li AS (SELECT v.* FROM v JOIN m USING (\"partition\") WHERE m.now - v.time < {WINDOW}) "


@query(_LIVE + "SELECT * FROM li")
def dedup_live_identities(spark, d):
    return dedup.live_identities(_dedup(spark, d), WINDOW)


@query(_LIVE + f'SELECT "partition", min(time) + {WINDOW} AS expires_ms FROM li GROUP BY 1')
def dedup_next_expiration(spark, d):
    return dedup.next_expiration(dedup.live_identities(_dedup(spark, d), WINDOW), WINDOW)


@query(f"WITH {D} SELECT \"partition\", count(*) FILTER (disposition = 'stored') AS stored, count(*) FILTER (disposition = 'duplicate') AS duplicate, CAST(0 AS BIGINT) AS scheduled, count(*) AS attempts FROM o GROUP BY 1")
def disposition_counts(spark, d):
    return telemetry.dispositions(_dedup(spark, d), ["partition"])


@query(f'WITH {A} SELECT "partition", count(*) AS attempts, count(DISTINCT producer_id || \'/\' || event_type) AS unique_ids, (count(*) - count(DISTINCT producer_id || \'/\' || event_type)) / count(*) AS duplicate_fraction FROM a GROUP BY 1')
def duplicate_fraction(spark, d):
    return telemetry.duplicate_share(_attempts(spark, d).withColumn("message_id", F.concat_ws("/", "producer_id", "event_type")), ["partition"])


# --- delay -------------------------------------------------------------------------------


@query(f'WITH {S} SELECT "partition", arrival_seq, release_ms, schedule FROM h')
def schedule_assign(spark, d):
    return _held(spark, d).select("partition", "arrival_seq", "release_ms", "schedule")


@query(f'WITH {S} SELECT "partition", arrival_seq, CASE WHEN due_ms > append_ms + {20 * DAY} THEN 21 END AS error_code FROM h')
def schedule_refused(spark, d):
    return delay.schedule(_orders(spark, d), 20 * DAY).select("partition", "arrival_seq", "error_code")


@query(f'WITH {S} SELECT "partition", arrival_seq, release_ms, row_number() OVER (PARTITION BY "partition" ORDER BY release_ms, schedule) - 1 AS "offset" FROM h WHERE release_ms <= {SHIP_NOW}')
def release_due(spark, d):
    return delay.release(_held(spark, d), SHIP_NOW).select("partition", "arrival_seq", "release_ms", "offset")


@query(
    f'WITH {S}, b AS (SELECT "partition", due_ms AS effective_ms, 1 AS class, arrival_seq AS seq, message_id FROM h WHERE message_id % 3 = 0 UNION ALL SELECT "partition", release_ms, 0, schedule, message_id FROM h WHERE message_id % 3 <> 0) '
    'SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY effective_ms, class, seq) - 1 AS "offset" FROM b'
)
def release_merged_log(spark, d):
    h = _held(spark, d)
    now = h.where("message_id % 3 = 0").withColumn("append_ms", F.col("due_ms"))
    return delay.merged_log(now, h.where("message_id % 3 <> 0"))


@query(f'WITH {S} SELECT "partition", count(*) AS held_records, CAST(sum(bytes) AS BIGINT) AS held_bytes, min(release_ms) AS next_release_ms FROM h WHERE release_ms > {SHIP_NOW} GROUP BY 1')
def held_totals(spark, d):
    return delay.held_totals(delay.still_held(_held(spark, d), SHIP_NOW))


@query(f'WITH {S} SELECT "partition", release_ms, schedule, message_id FROM h WHERE release_ms > {SHIP_NOW} AND schedule < 5000')
def carry_rows(spark, d):
    held = delay.still_held(_held(spark, d), SHIP_NOW).withColumn("operation", F.col("schedule"))
    return delay.carry(held, 5000).select("partition", "release_ms", "schedule", "message_id")


@query(f'WITH {S} SELECT "partition", max(release_ms - due_ms) AS max_late_ms, count(*) FILTER (release_ms - due_ms > 0) AS late FROM h GROUP BY 1')
def lateness(spark, d):
    late = delay.lateness(_held(spark, d).withColumn("delivered_ms", F.col("release_ms")))
    return late.groupBy("partition").agg(F.max("late_ms").alias("max_late_ms"), F.count_if(F.col("late_ms") > 0).alias("late"))


@query(f'WITH {S} SELECT "partition", arrival_seq FROM h WHERE append_ms + {DAY} < due_ms')
def early_deliveries(spark, d):
    return delay.early(_orders(spark, d).withColumn("delivered_ms", F.col("append_ms")), DAY).select("partition", "arrival_seq")


# --- reading -----------------------------------------------------------------------------

_OUT = 'SELECT l."partition", l."offset", l.message_id, l.append_ms'


def _delivered(log: DataFrame) -> DataFrame:
    return log.select("partition", "offset", "message_id", "append_ms")


@query(f'WITH {E} {_OUT} FROM l')
def seek_earliest(spark, d):
    log = _log(spark, d)
    return _delivered(reading.replay(log, reading.start_earliest(reading.ends_of(log))))


@query(f'WITH {E} {_OUT} FROM l JOIN ends USING ("partition") WHERE l."offset" >= ends.next_offset')
def seek_latest(spark, d):
    log = _log(spark, d)
    return _delivered(reading.replay(log, reading.start_latest(reading.ends_of(log))))


@query(f'WITH {E}, st AS (SELECT ends."partition", coalesce((SELECT min("offset") FROM l WHERE l."partition" = ends."partition" AND append_ms >= {T0}), ends.next_offset) AS start FROM ends) {_OUT} FROM l JOIN st USING ("partition") WHERE l."offset" >= st.start')
def seek_timestamp(spark, d):
    log = _log(spark, d)
    return _delivered(reading.replay(log, reading.start_timestamp(log, reading.ends_of(log), T0)))


@query(f'WITH {E} SELECT "partition", CASE WHEN next_offset >= 2500 AND retained_from <= 2500 THEN CAST(2500 AS BIGINT) END AS start, CASE WHEN retained_from > 2500 THEN 14 WHEN next_offset < 2500 THEN 16 END AS error_code FROM ends')
def seek_offset(spark, d):
    return reading.start_offset(reading.ends_of(_log(spark, d)), 2500)


def _by_kind(spark, d, policy):
    log = _log(spark, d).withColumn("message_id", F.concat_ws("/", "producer_id", "event_type"))
    return reading.start_record(log, reading.ends_of(log, 5), "7/click", policy)


def _record_sql(policy: str) -> str:
    code = "WHEN f <> z THEN 20" if policy == "unique" else ""
    start = "z" if policy == "last" else "f"
    return (
        f"WITH {E}, m AS (SELECT \"partition\", min(\"offset\") AS f, max(\"offset\") AS z FROM l WHERE producer_id || '/' || event_type = '7/click' AND \"offset\" >= 5 GROUP BY 1), "
        f'j AS (SELECT "partition", f, z, CASE WHEN f IS NULL THEN 19 {code} END AS error_code FROM ends LEFT JOIN m USING ("partition")) '
        f'SELECT "partition", CASE WHEN error_code IS NULL THEN {start} END AS start, f AS first_offset, z AS last_offset, error_code FROM j'
    )


@query(_record_sql("unique"))
def seek_record_id_unique(spark, d):
    return _by_kind(spark, d, "unique")


@query(_record_sql("first"))
def seek_record_id_first(spark, d):
    return _by_kind(spark, d, "first")


@query(_record_sql("last"))
def seek_record_id_last(spark, d):
    return _by_kind(spark, d, "last")


@query(f'WITH {E} {_OUT} FROM l WHERE l."offset" >= 100 * (l."partition" + 1)')
def replay_from_checkpoint(spark, d):
    log = _log(spark, d)
    mark = reading.ends_of(log).select("partition", ((F.col("partition") + 1) * 100).cast("long").alias("next_offset"))
    both = mark.withColumn("topic", F.lit("events")).unionByName(mark.select("partition", F.lit(7).cast("long").alias("next_offset"), F.lit("other").alias("topic")))
    return _delivered(reading.replay(log, reading.start_checkpoint(reading.ends_of(log), both, "events")))


@query(f'WITH {L} SELECT "partition", max("offset") + 1 AS next_offset FROM l GROUP BY 1')
def reader_checkpoint(spark, d):
    return reading.checkpoint(_log(spark, d))


@query(f'WITH {L} {_OUT} FROM l WHERE "partition" IN (1, 3)')
def read_partitions(spark, d):
    return _delivered(reading.select_partitions(_log(spark, d), [1, 3], 4))


_MERGE = f"WITH {L}, b AS (SELECT \"partition\", \"offset\", message_id, 'replay' AS source FROM l WHERE \"offset\" < 600 UNION ALL SELECT \"partition\", \"offset\", message_id, 'live' FROM l WHERE \"offset\" >= 500 AND \"offset\" <> 800), o1 AS (SELECT \"partition\", \"offset\", max(source) AS source, min(message_id) AS message_id FROM b WHERE \"offset\" >= 50 GROUP BY 1, 2), o2 AS (SELECT *, row_number() OVER (PARTITION BY \"partition\" ORDER BY \"offset\") - 1 AS n FROM o1), o3 AS (SELECT \"partition\", \"offset\", source, message_id FROM o2 WHERE \"offset\" = 50 + n) "


def _merged(spark, d):
    log = _log(spark, d).select("partition", "offset", "message_id")
    starts = log.select("partition").distinct().withColumn("start", F.lit(50).cast("long"))
    return reading.merge_live(log.where("offset >= 500 and offset <> 800"), log.where("offset < 600"), starts)


@query(_MERGE + "SELECT * FROM o3")
def merge_live_replay(spark, d):
    return _merged(spark, d).select("partition", "offset", "source", "message_id")


@query(_MERGE + "SELECT \"partition\", count(*) FILTER (source = 'live') AS live, count(*) FILTER (source = 'replay') AS replayed, CAST(0 AS BIGINT) AS gaps FROM o3 GROUP BY 1")
def reader_stats(spark, d):
    return reading.delivery_stats(_merged(spark, d))


@query(f'WITH {L}, z AS (SELECT *, sum(octet_length(encode(props))) OVER (PARTITION BY "partition" ORDER BY "offset") AS total FROM l) SELECT "partition", "offset", message_id, CAST(NULL AS INTEGER) AS error_code FROM z WHERE "offset" < 400 AND total <= 3000')
def bounded_read(spark, d):
    log = _log(spark, d).withColumn("bytes", F.octet_length("props"))
    return reading.bounded(log, 400, 3000).select("partition", "offset", "message_id", "error_code")


# --- groups ------------------------------------------------------------------------------

#: Nations are members of their regions' groups; customers' keys are partitions.
_PARTS = "p AS (SELECT n_regionkey AS group_id, c_custkey AS \"partition\", c_custkey % 3 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(
    'WITH p AS (SELECT n_regionkey AS g, c_custkey AS pt, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS old FROM customer JOIN nation ON c_nationkey = n_nationkey), '
    "m AS (SELECT n_regionkey AS g, n_nationkey AS mb, CASE WHEN n_nationkey % 7 = 0 THEN 2 ELSE 1 END AS j FROM nation WHERE n_nationkey % 5 <> 1), "
    "o AS (SELECT p.*, m.mb AS owner FROM p LEFT JOIN m ON m.g = p.g AND m.mb = p.old AND m.j = 1), "
    "q AS (SELECT m.*, (SELECT count(*) FROM o WHERE o.g = m.g AND o.owner = m.mb) AS owned, (SELECT count(*) FROM p WHERE p.g = m.g) AS slots, count(*) OVER (PARTITION BY m.g) AS n FROM m), "
    "r AS (SELECT *, slots // n + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY owned DESC, mb) <= slots % n THEN 1 ELSE 0 END AS quota FROM q), "
    "k AS (SELECT o.*, o.owner IS NOT NULL AND row_number() OVER (PARTITION BY o.g, o.owner ORDER BY o.pt) <= r.quota AS kept FROM o LEFT JOIN r ON r.g = o.g AND r.mb = o.owner), "
    "f AS (SELECT g, pt, row_number() OVER (PARTITION BY g ORDER BY pt) AS place FROM k WHERE NOT kept), "
    "s AS (SELECT g, mb, unnest(range(quota - least(owned, quota))) AS i FROM r), e AS (SELECT g, mb, row_number() OVER (PARTITION BY g ORDER BY mb, i) AS place FROM s), "
    "t AS (SELECT k.g, k.pt, k.old, CASE WHEN k.kept THEN k.owner ELSE e.mb END AS mb FROM k LEFT JOIN f ON f.g = k.g AND f.pt = k.pt LEFT JOIN e ON e.g = k.g AND e.place = f.place), "
    "u AS (SELECT t.*, m.j, coalesce(t.old = t.mb AND m.j = 1, false) AS same FROM t LEFT JOIN m ON m.g = t.g AND m.mb = t.mb) "
    'SELECT g AS group_id, pt AS "partition", mb AS member_id, j AS join_id, CASE WHEN same THEN 3 ELSE 4 END AS plan_revision, CASE WHEN NOT same THEN old END AS prior_member_id FROM u'
)
def group_plan(spark, d):
    """Partitions spread over the nations of a region; some members have restarted, some have left.
    A test holds plans against a plain sequential planner too."""
    n, c = topics.table(spark, d, "nation"), topics.table(spark, d, "customer")
    parts = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("group_id"), F.col("c_custkey").alias("partition"), "c_nationkey", "c_acctbal")
    members = n.where("n_nationkey % 5 <> 1").select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("member_id"), F.when(F.col("n_nationkey") % 7 == 0, 2).otherwise(1).alias("join_id"))
    prior = parts.where("c_acctbal > 0").select("group_id", "partition", F.col("c_nationkey").alias("member_id"), F.lit(1).alias("join_id"), F.lit(3).cast("long").alias("plan_revision"), F.lit(None).cast("int").alias("prior_member_id"))
    return groups.plan(members, parts.select("group_id", "partition"), prior, 4)


@query(f'WITH {L} SELECT "partition", coalesce(min(CASE WHEN NOT (value > 20 OR "offset" < 300) THEN "offset" END), max("offset") + 1) AS "cursor" FROM l GROUP BY 1')
def ack_cursor(spark, d):
    return groups.ack_cursor(_log(spark, d).select("partition", "offset", ((F.col("value") > 20) | (F.col("offset") < 300)).alias("acked")))


def _progress(spark, d):
    e = _attempts(spark, d)
    return e.groupBy(F.col("event_type").alias("group_id"), "partition").agg((F.floor(F.max("value"))).cast("long").alias("next_offset")).where("partition <> 2")


_PROG = f'WITH {E}, pr AS (SELECT event_type AS group_id, "partition", CAST(floor(max(value)) AS BIGINT) AS next_offset FROM a WHERE "partition" <> 2 GROUP BY 1, 2), tg AS (SELECT DISTINCT event_type AS group_id, "partition" FROM a) '


def _targets(spark, d):
    return _attempts(spark, d).select(F.col("event_type").alias("group_id"), "partition").distinct()


@query(_PROG + 'SELECT tg.group_id, count(*) AS partitions, count(pr.next_offset) AS cursors, CAST(sum(greatest(ends.next_offset - pr.next_offset, 0)) FILTER (pr.next_offset IS NOT NULL) AS BIGINT) AS lag FROM tg LEFT JOIN pr USING (group_id, "partition") JOIN ends USING ("partition") GROUP BY 1')
def group_lag(spark, d):
    return groups.group_lag(_targets(spark, d), _progress(spark, d), reading.ends_of(_log(spark, d)))


@query(_PROG + 'SELECT tg.group_id, tg."partition", coalesce(pr.next_offset, 0) AS start FROM tg LEFT JOIN pr USING (group_id, "partition")')
def group_start(spark, d):
    return groups.start_of(_targets(spark, d), _progress(spark, d), reading.start_earliest(reading.ends_of(_log(spark, d))))


@query(_PROG + "SELECT pr.group_id, pr.\"partition\", pr.next_offset, CAST(300 AS BIGINT) AS retained_from, 9 AS error_code FROM pr WHERE next_offset < 300")
def expired_cursors(spark, d):
    return groups.expired_cursors(_progress(spark, d), reading.ends_of(_log(spark, d), 300))


_UPD = f"WITH {E}, u AS (SELECT event_type AS group_id, \"partition\", arrival_seq AS seq, coalesce(CASE WHEN lag(arrival_seq) OVER w % 50 = 0 THEN lag(\"offset\", 2) OVER w ELSE lag(\"offset\") OVER w END, 0) AS expected, \"offset\" AS nxt, CASE WHEN arrival_seq % 50 = 0 THEN 1 ELSE 2 END AS epoch FROM l WINDOW w AS (PARTITION BY event_type, \"partition\" ORDER BY arrival_seq)), "


def _updates(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type", "partition").orderBy("arrival_seq")
    before = F.when(F.lag("arrival_seq").over(w) % 50 == 0, F.lag("offset", 2).over(w)).otherwise(F.lag("offset").over(w))  # a fenced update's place isn't expected
    return _log(spark, d).select(F.col("event_type").alias("group_id"), "partition", F.col("arrival_seq").alias("seq"), F.when(F.col("arrival_seq") % 50 == 0, 1).otherwise(2).alias("epoch"), F.lit("m").alias("member_id"), F.coalesce(before, F.lit(0)).alias("expected"), F.col("offset").alias("next"))


@query(
    _UPD.replace("WITH ", "WITH RECURSIVE ", 1) + 'v AS (SELECT *, row_number() OVER (PARTITION BY group_id, "partition" ORDER BY seq) AS rn FROM u WHERE nxt IS NOT NULL), '
    'c AS (SELECT DISTINCT group_id, "partition", CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS cur, CAST(NULL AS INTEGER) AS error_code FROM v UNION ALL '
    'SELECT v.group_id, v."partition", v.seq, v.rn, CASE WHEN v.epoch = 2 AND v.expected = c.cur AND v.nxt > c.cur THEN v.nxt ELSE c.cur END, CASE WHEN v.epoch <> 2 THEN 6 WHEN v.expected <> c.cur OR v.nxt <= c.cur THEN 7 END '
    'FROM c JOIN v ON v.group_id = c.group_id AND v."partition" = c."partition" AND v.rn = c.rn + 1) SELECT group_id, "partition", seq, error_code FROM c WHERE rn > 0'
)
def progress_monotone(spark, d):
    """Some owners expect what they were told, others start from where the log stood; fenced updates change nothing."""
    held = _targets(spark, d).withColumns({"epoch": F.lit(2), "member_id": F.lit("m"), "resume_cursor": F.lit(0)})
    return groups.progress_errors(_updates(spark, d), held, reading.ends_of(_log(spark, d))).select("group_id", "partition", "seq", "error_code")


@query(_UPD + 'v AS (SELECT * FROM u WHERE nxt IS NOT NULL) SELECT group_id, "partition", max(nxt) AS next_offset, count(*) AS riders FROM v GROUP BY 1, 2')
def progress_coalesced(spark, d):
    return groups.coalesced(_updates(spark, d))


@query(
    f'WITH {L}, b AS (SELECT event_type AS group_id, producer_id AS member_id, max(append_ms) AS seen_ms FROM l GROUP BY 1, 2) '
    f"SELECT group_id, member_id, CAST(1 AS INTEGER) AS join_id, seen_ms FROM b WHERE {NOW} - seen_ms < {3 * DAY} AND member_id % 3 <> 0"
)
def group_live_members(spark, d):
    """Each first event of a user is a join, the others are beats; the last of every third user is a leave."""
    e = _attempts(spark, d).select(F.col("event_type").alias("group_id"), F.col("producer_id").alias("member_id"), F.lit(1).alias("join_id"), F.col("append_ms").alias("seen_ms"))
    at = e.groupBy("group_id", "member_id", "join_id").agg(F.min("seen_ms").alias("a"), F.max("seen_ms").alias("z"))
    beats = e.withColumn("kind", F.lit("beat")).unionByName(at.select("group_id", "member_id", "join_id", F.col("a").alias("seen_ms"), F.lit("join").alias("kind"))).unionByName(at.where("member_id % 3 = 0").select("group_id", "member_id", "join_id", F.col("z").alias("seen_ms"), F.lit("leave").alias("kind")))
    return groups.live_members(beats, NOW, 3 * DAY)


@query(
    f'WITH {_PARTS}, t AS (SELECT group_id, "partition", n_nationkey AS m, CASE WHEN k = 0 THEN NULL ELSE 99 END AS prior, n_nationkey % 4 = 0 AS leaving, n_nationkey % 2 = 0 AS reported, CASE WHEN "partition" % 9 = 0 THEN 1 END AS held FROM p JOIN nation ON n_regionkey = group_id) '
    'SELECT group_id, "partition", bool_and(prior IS NULL OR leaving OR m = 0 OR (reported AND (held IS NULL OR held >= 2))) AS activatable FROM t GROUP BY 1, 2'
)
def group_activatable(spark, d):
    n, c = topics.table(spark, d, "nation"), topics.table(spark, d, "customer")
    parts = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("group_id"), F.col("c_custkey").alias("partition"))
    targets = parts.select("group_id", "partition", F.lit(0).alias("member_id"), F.lit(1).alias("join_id"), F.lit(2).alias("plan_revision"), F.when(F.col("partition") % 3 != 0, 99).alias("prior_member_id"), F.lit(NOW).alias("first_seen_ms"))
    members = n.select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("member_id"), F.lit(1).alias("join_id"), (F.col("n_nationkey") % 4 == 0).alias("leaving"), (F.col("n_nationkey") % 2 == 0).alias("reported"))
    owned = parts.where("partition % 9 = 0").join(n.select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("member_id")), "group_id").withColumn("plan_revision", F.lit(1))
    return groups.activatable(targets, members, owned, NOW, 1000)


@query(
    "WITH r AS (SELECT c_custkey AS \"partition\", CASE WHEN c_custkey % 5 = 0 THEN 9 ELSE 3 END AS expected, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 5 END AS rev, CAST(c_nationkey * 10 AS BIGINT) AS start, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey * 12 AS BIGINT) END AS progress FROM customer), "
    "q AS (SELECT *, coalesce(progress, start) AS resume FROM r), c AS (SELECT *, CASE WHEN expected <> 3 THEN 6 WHEN rev <= 4 THEN 5 WHEN resume < 20 THEN 9 WHEN resume > 230 THEN 16 END AS error_code FROM q) "
    "SELECT \"partition\", CASE WHEN error_code IS NULL THEN 4 END AS epoch, CASE WHEN error_code IS NULL THEN resume END AS resume_cursor, error_code FROM c"
)
def group_assign(spark, d):
    c = topics.table(spark, d, "customer").withColumns({"group_id": F.lit("g"), "partition": F.col("c_custkey")})
    requests = c.select("group_id", "partition", F.when(F.col("partition") % 5 == 0, 9).otherwise(3).alias("expected_epoch"), F.when(F.col("partition") % 7 == 0, 2).otherwise(5).alias("plan_revision"), F.lit("m").alias("member_id"), (F.col("c_nationkey") * 10).cast("long").alias("start"))
    held = c.select("group_id", "partition", F.lit(3).alias("epoch"), F.lit(4).alias("plan_revision"))
    progress = c.where("partition % 2 = 0").select("group_id", "partition", (F.col("c_nationkey") * 12).cast("long").alias("next_offset"))
    ends = c.select("partition", F.lit(20).cast("long").alias("retained_from"), F.lit(230).cast("long").alias("next_offset"))
    return groups.assign(requests, held, ends, progress).select("partition", "epoch", "resume_cursor", "error_code")


@query("SELECT r_name AS group_id, n_name AS member_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 2 = 0) AS partitions FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def group_inspect(spark, d):
    n, c, r = (topics.table(spark, d, t) for t in ("nation", "customer", "region"))
    all_ = r.select(F.col("r_name").alias("group_id"), "r_regionkey")
    members = n.join(all_, n.n_regionkey == all_.r_regionkey).select("group_id", F.col("n_name").alias("member_id"), "n_nationkey")
    targets = c.where("c_custkey % 2 = 0").join(members, F.col("c_nationkey") == F.col("n_nationkey")).select("group_id", "member_id", F.col("c_custkey").alias("partition"))
    left = groups.without_groups(all_.select("group_id"), all_.where("group_id = 'ASIA'"))
    return groups.inspect(left, members.select("group_id", "member_id"), targets)


# --- retention ---------------------------------------------------------------------------


@query(f'WITH {G} SELECT "partition", id, record_end, newest_append_ms, last_operation, bytes FROM g')
def segment_summary(spark, d):
    return _segments(spark, d).select("partition", "id", "record_end", "newest_append_ms", "last_operation", "bytes")


def _policies(spark, d):
    return reading.ends_of(_log(spark, d)).select(
        "partition",
        F.when(F.col("partition") != 1, F.lit(20 * DAY)).alias("max_age_ms"),
        F.when(F.col("partition") == 1, F.lit(16384)).cast("long").alias("max_bytes"),
        F.lit(9000).cast("long").alias("committed_operation"),
        F.when(F.col("partition") == 3, F.lit(4000)).cast("long").alias("held_operation"),
        F.when(F.col("partition") == 2, F.lit(1500)).cast("long").alias("trimmed"),
    )


@query(
    f'WITH {G}, k AS (SELECT *, sum(capacity) OVER (PARTITION BY "partition") AS total, sum(capacity) OVER (PARTITION BY "partition" ORDER BY id DESC) AS selected FROM g), '
    f'w AS (SELECT *, ("partition" <> 1 AND {NOW} - newest_append_ms >= {20 * DAY}) AS aged, sealed AND last_operation <= 9000 AND (("partition" = 1 AND selected > 16384) OR ("partition" <> 1 AND {NOW} - newest_append_ms >= {20 * DAY}) OR ("partition" = 2 AND record_end <= 1500)) AS due, ("partition" = 3 AND last_operation >= 4000) AS holds FROM k), '
    'z AS (SELECT *, min(CASE WHEN NOT due OR holds THEN id END) OVER (PARTITION BY "partition") AS stop FROM w) '
    'SELECT "partition", coalesce(string_agg(CASE WHEN id < stop THEN id END, \',\' ORDER BY id), \'\') AS retire, coalesce(max(CASE WHEN id < stop THEN record_end END), 0) AS record_floor, coalesce(max(CASE WHEN id < stop THEN last_operation END) + 1, 0) AS operation_floor, '
    'CAST(max(total) - coalesce(sum(CASE WHEN id < stop THEN capacity END), 0) AS BIGINT) AS selected_bytes, bool_or(NOT sealed AND aged AND last_operation <= 9000) AS roll_active, max(CASE WHEN id = stop AND due AND holds THEN last_operation + 1 END) AS carry_end, bool_or(CASE WHEN id = stop AND due AND holds THEN aged END) AS carry_expired FROM z GROUP BY 1'
)
def retention_plan(spark, d):
    return retention.plan(_segments(spark, d), _policies(spark, d), NOW)


@query(
    f'WITH {G}, b AS (SELECT "partition", id, CASE WHEN id = 1 THEN 0 ELSE capacity END AS capacity, CASE WHEN id = 0 THEN false ELSE sealed END AS sealed, CASE WHEN id = 2 THEN 1 ELSE record_end END AS record_end, CASE WHEN id = 3 THEN 0 ELSE last_operation END AS last_operation FROM g), '
    'n AS (SELECT *, lead(id) OVER w IS NULL AS newest, lag(record_end) OVER w AS e, lag(last_operation) OVER w AS o FROM b WINDOW w AS (PARTITION BY "partition" ORDER BY id)) SELECT "partition", id FROM n WHERE capacity <= 0 OR sealed = newest OR record_end < e OR last_operation < o'
)
def segment_violations(spark, d):
    """The first is unsealed, the second has no capacity, the third has lost its records, the fourth its operations."""
    n = F.col("id")
    s = _segments(spark, d).withColumns({"capacity": F.when(n == 1, 0).otherwise(F.col("capacity")), "sealed": F.when(n == 0, False).otherwise(F.col("sealed")), "record_end": F.when(n == 2, 1).otherwise(F.col("record_end")), "last_operation": F.when(n == 3, 0).otherwise(F.col("last_operation"))})
    return retention.invalid_segments(s).select("partition", "id")


@query(f'WITH {E} SELECT "partition", CASE WHEN "partition" IN (0, 3) THEN CAST(100 + "partition" AS BIGINT) ELSE CAST(10 AS BIGINT) END AS retained_from, CASE WHEN "partition" IN (0, 3) THEN CAST(12 + "partition" AS BIGINT) ELSE CAST(10 AS BIGINT) END AS retained_operation, CASE "partition" WHEN 1 THEN 5 WHEN 2 THEN 7 END AS error_code FROM ends')
def trim_floor(spark, d):
    ends = reading.ends_of(_log(spark, d))
    have = ends.select("partition", F.lit(10).cast("long").alias("retained_from"), F.lit(10).cast("long").alias("retained_operation"), F.lit(500).cast("long").alias("result_floor"))
    ask = ends.select(
        "partition",
        F.when(F.col("partition") == 1, 9).otherwise(10).cast("long").alias("expected_record_floor"),
        F.lit(10).cast("long").alias("expected_operation_floor"),
        F.when(F.col("partition") == 2, 900).otherwise(100 + F.col("partition")).cast("long").alias("record_floor"),
        (12 + F.col("partition")).cast("long").alias("operation_floor"),
    )
    return retention.trim(have, ask)


@query(
    f'WITH {G}, q AS (SELECT "partition", id, 1000 + (id * 2711) % 5000 AS live, row_number() OVER (PARTITION BY "partition" ORDER BY id) AS n FROM g WHERE sealed), '
    'r AS (SELECT a."partition", a.n AS first_n, a.id AS first_id, b.id AS last_id, b.n - a.n AS freed, (SELECT sum(live) FROM q c WHERE c."partition" = a."partition" AND c.n BETWEEN a.n AND b.n) AS bytes FROM q a JOIN q b ON a."partition" = b."partition" AND b.n > a.n), '
    'f AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY freed / bytes DESC, first_n, freed) AS k FROM r WHERE bytes <= 8192 AND freed * 8192 >= bytes) '
    'SELECT "partition", first_id, last_id, freed, CAST(bytes AS BIGINT) AS bytes FROM f WHERE k = 1'
)
def pack_best_run(spark, d):
    return retention.best_run(_segments(spark, d).withColumn("live_bytes", 1000 + (F.col("id") * 2711) % 5000), 8192)


@query("SELECT c_custkey AS \"partition\", 128 - c_custkey % 128 > 8 + c_nationkey % 3 AS records, 128 - c_custkey % 128 > 2 + c_nationkey % 3 AS control, 128 - c_custkey % 128 > 2 AS release, true AS trim FROM customer")
def partition_room(spark, d):
    c = topics.table(spark, d, "customer")
    return retention.room(c.select(F.col("c_custkey").alias("partition"), (F.col("c_custkey") % 128).alias("used_segments"), F.lit(128).alias("limit_segments"), (F.col("c_nationkey") % 3).alias("held_segments")))


@query(f'WITH {G} SELECT "partition", id FROM g WHERE id % 3 = 0')
def unselected_objects(spark, d):
    s = _segments(spark, d).select("partition", "id")
    return retention.unselected(s, s.where("id % 3 <> 0"))


@query(f'WITH {L} SELECT producer_id, max(arrival_seq) AS op, arg_max(value, arrival_seq) AS value FROM l GROUP BY 1')
def snapshot_recovery(spark, d):
    a = _attempts(spark, d).select("producer_id", F.col("arrival_seq").alias("op"), "value")
    empty = a.where("op < 0")
    snapshot = retention.recovered(empty, a.where("op < 6000"), ["producer_id"], "op")
    return retention.recovered(snapshot, a.where("op >= 6000"), ["producer_id"], "op")


# --- telemetry ---------------------------------------------------------------------------

_NS = "CAST(round(value * 1000) AS BIGINT)"


def _samples(spark, d):
    return _attempts(spark, d).select("event_type", F.round(F.col("value") * 1000).cast("long").alias("ns"))


def _bin(ns: str, keep: int) -> str:
    """Bin and bounds by the position of the leading bit."""
    shift = f"greatest(CASE WHEN {ns} = 0 THEN 0 ELSE length(format('{{:b}}', {ns})) END - {keep + 1}, 0)"
    return f"CAST({2**keep} * {shift} + ({ns} >> CAST({shift} AS INTEGER)) AS INTEGER)"


_HIST = f"WITH n AS (SELECT event_type, {_NS} AS ns FROM events), hb AS (SELECT event_type, ns, {_bin('ns', 3)} AS bin FROM n), hg AS (SELECT event_type, bin, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total_ns, max(ns) AS max_ns FROM hb GROUP BY 1, 2) "


@query(_HIST + "SELECT * FROM hg")
def stage_histogram_bins(spark, d):
    return telemetry.stage_histogram(_samples(spark, d), ["event_type"])


def _upper(b: str) -> str:
    return f"CASE WHEN {b} < 16 THEN CAST({b} AS BIGINT) ELSE (CAST(9 + {b} % 8 AS BIGINT) << CAST({b} // 8 - 1 AS INTEGER)) - 1 END"


@query(
    _HIST + ", cu AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS c, sum(n) OVER (PARTITION BY event_type) AS t FROM hg), "
    "q AS (SELECT event_type, CAST(max(t) AS BIGINT) AS samples, max(max_ns) AS max_ns, min(CASE WHEN c >= ceil(t * 0.5) THEN bin END) AS b50, min(CASE WHEN c >= ceil(t * 99 / 100) THEN bin END) AS b99 FROM cu GROUP BY 1) "
    f"SELECT event_type, samples, max_ns, least({_upper('b50')}, max_ns) AS p50, least({_upper('b99')}, max_ns) AS p99 FROM q"
)
def stage_quantiles(spark, d):
    return telemetry.histogram_quantiles(telemetry.stage_histogram(_samples(spark, d), ["event_type"]), ["event_type"], [50, 99])


@query(f"WITH n AS (SELECT event_type, {_NS} AS us FROM events) SELECT event_type, {_bin('us', 6)} AS bin, count(*) AS n FROM n GROUP BY 1, 2")
def latency_histogram_bins(spark, d):
    return _samples(spark, d).groupBy("event_type", telemetry.latency_bin(F.col("ns")).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT event_type, quantile_disc(value, 0.25) AS p250, quantile_disc(value, 0.5) AS p500, quantile_disc(value, 0.99) AS p990 FROM events GROUP BY 1")
def nearest_rank_percentiles(spark, d):
    return telemetry.nearest_rank(_attempts(spark, d), ["event_type"], "value", [250, 500, 990])


def _counters(spark, d):
    e = _attempts(spark, d)
    kind = F.when(F.col("event_type") == "click", "peak").when(F.col("event_type") == "view", "gauge").otherwise("count")
    return e.select("partition", F.col("event_type").alias("event"), kind.alias("kind"), F.floor("value").cast("long").alias("value"))


@query("SELECT CAST(user_id % 4 AS INTEGER) AS \"partition\", event_type AS event, CASE event_type WHEN 'click' THEN 'peak' WHEN 'view' THEN 'gauge' ELSE 'count' END AS kind, CAST(CASE WHEN event_type = 'click' THEN max(CAST(floor(value) AS BIGINT)) ELSE sum(CAST(floor(value) AS BIGINT)) END AS BIGINT) AS value FROM events GROUP BY 1, 2")
def counter_totals(spark, d):
    return telemetry.counter_totals(_counters(spark, d), ["partition"])


@query("WITH t AS (SELECT event_type AS event, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS value FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT l.event, l.label, t.value FROM (VALUES ('view', 'Views'), ('purchase', 'Sales'), ('nothing', 'None')) l(event, label) JOIN t USING (event)")
def labelled_counters(spark, d):
    labels = spark.createDataFrame([("view", "Views"), ("purchase", "Sales"), ("nothing", "None")], "event string, label string")
    totals = telemetry.counter_totals(_counters(spark, d), []).where("event <> 'click'")
    return telemetry.labelled(totals, labels).select("event", "label", "value")


@query(
    f'WITH {L}, r AS (SELECT "partition", arrival_seq, append_ms, "offset", lag("offset") OVER w AS b, lag(append_ms) OVER w AS t FROM l WINDOW w AS (PARTITION BY "partition" ORDER BY append_ms, "offset")) '
    'SELECT "partition", "offset", CASE WHEN "offset" >= b AND append_ms > t THEN ("offset" - b) * 1000.0 / (append_ms - t) END AS rate FROM r'
)
def commit_rate(spark, d):
    s = _log(spark, d).select("partition", "offset", F.col("append_ms").alias("uptime_ms"), F.col("offset").alias("value"))
    return telemetry.rates(s, ["partition"]).select("partition", "offset", "rate")


@query(f'WITH {A} SELECT event_type, (append_ms - {T0}) // 1000 AS "second", count(*) AS n FROM a WHERE append_ms >= {T0} AND append_ms < {T0 + 5 * DAY} GROUP BY 1, 2')
def per_second_throughput(spark, d):
    return telemetry.per_second(_attempts(spark, d), "append_ms", T0, T0 + 5 * DAY, ["event_type"])


@query(
    f'WITH {A}, r AS (SELECT "partition", append_ms AS s, append_ms + CAST(floor(value * 1000) AS BIGINT) AS c FROM a) SELECT "partition", count(*) FILTER (s >= {T0} AND s < {T0 + DAY}) AS submitted, count(*) FILTER (c >= {T0} AND c < {T0 + DAY}) AS completed, '
    f'max(CASE WHEN s >= {T0} AND s < {T0 + DAY} THEN c - s END) AS max_latency_ms, count(*) FILTER (c >= {T0} AND c < {T0 + DAY}) * 1000.0 / {DAY} AS per_second FROM r GROUP BY 1'
)
def latency_cohort(spark, d):
    r = _attempts(spark, d).select("partition", F.col("append_ms").alias("submitted_ms"), (F.col("append_ms") + F.floor(F.col("value") * 1000).cast("long")).alias("completed_ms"))
    return telemetry.cohort(r, T0, T0 + DAY, ["partition"])


@query(
    f"WITH {A}, r AS (SELECT append_ms AS due, append_ms + arrival_seq % 100 AS s, append_ms + CAST(floor(value * 1000) AS BIGINT) AS c FROM a) "
    f"SELECT (due - {T0}) // {2 * DAY} AS stage, count(*) AS n, max(s - due) AS max_lag_ms, max(c - due) AS max_latency_ms FROM r WHERE due >= {T0} AND due < {T0 + 10 * DAY} GROUP BY 1"
)
def ramp_stages(spark, d):
    stages = spark.range(5).select(F.col("id").alias("stage"), (F.lit(T0) + F.col("id") * 2 * DAY).alias("start_ms"), (F.lit(T0) + (F.col("id") + 1) * 2 * DAY).alias("end_ms"))
    r = _attempts(spark, d).select(F.col("append_ms").alias("due_ms"), (F.col("append_ms") + F.col("arrival_seq") % 100).alias("submitted_ms"), (F.col("append_ms") + F.floor(F.col("value") * 1000).cast("long")).alias("completed_ms"))
    return telemetry.staged(r, stages)


def _cases(spark, d, half=None):
    e = _attempts(spark, d)
    e = e if half is None else e.where(f"arrival_seq % 2 = {half}")
    metric = F.when(F.col("partition") < 2, "confirmed_s").otherwise("p50_us")
    return telemetry.case_summary(e.select("event_type", metric.alias("metric"), (F.col("value") + 1).alias("value"), (F.col("value") < 0).alias("failed")), ["event_type"])


_CASES = "(SELECT event_type, CASE WHEN user_id %% 4 < 2 THEN 'confirmed_s' ELSE 'p50_us' END AS metric, median(value + 1) AS \"median\", min(value + 1) AS \"min\", max(value + 1) AS \"max\", count(*) AS runs, bool_or(value < 0) AS failed FROM events WHERE event_id %% 2 = %d GROUP BY 1, 2)"


@query(_CASES.replace(" WHERE event_id %% 2 = %d", "").replace("%%", "%"))
def case_summary(spark, d):
    return _cases(spark, d)


@query(
    f"WITH b AS {_CASES % 0}, n AS {_CASES % 1} SELECT event_type, metric, (n.\"median\" / b.\"median\" - 1) * 100 AS delta_percent, CASE WHEN metric = 'confirmed_s' THEN n.\"median\" / b.\"median\" <= 0.95 ELSE n.\"median\" / b.\"median\" >= 1.05 END OR least(b.runs, n.runs) < 2 AS regression, "
    'b."min" <= n."max" AND n."min" <= b."max" AS overlapping FROM b JOIN n USING (event_type, metric)'
)
def regression_gate(spark, d):
    """Every second event was measured before the change, the others after it."""
    return telemetry.regressions(_cases(spark, d, 0), _cases(spark, d, 1), ["event_type"], ["confirmed_s", "delivered_s"])


@query("SELECT o_orderkey AS run_id, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 3 <> 0")
def complete_runs(spark, d):
    o = topics.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus", "o_custkey", F.col("o_totalprice").alias("value"))
    kinds = o.select("run_id", "value", F.lit("measurement").alias("kind")).unionByName(o.where("o_orderstatus <> 'P'").select("run_id", "value", F.lit("run-complete").alias("kind"))).unionByName(o.where("o_custkey % 3 = 0").select("run_id", "value", F.lit("run-failed").alias("kind")))
    return telemetry.complete_runs(kinds).select("run_id", "value")


_FIRST = f'WITH {L}, z AS (SELECT "partition", "offset" AS i, append_ms - min(append_ms) OVER (PARTITION BY "partition") AS m FROM l), '


@query(_FIRST + 'q AS (SELECT "partition", m, i * 1000000000 // 3 AS ns FROM z) SELECT "partition", count(*) AS arrivals, max(m - ns // 1000000) AS max_late_ms, count(*) FILTER (m < ns // 1000000) AS early FROM q GROUP BY 1')
def offered_load(spark, d):
    """How far each partition's events are from a steady load of three a second."""
    return telemetry.lateness_of_load(_arrivals(spark, d), ["partition"], 3)


@query(_FIRST + 'q AS (SELECT "partition", m, i * 1000000000 // 3 AS st FROM z), b AS (SELECT *, (st // 10000000000) * 10000000000 + (st % 10000000000) * 2000 // 10000 AS ns FROM q) SELECT "partition", count(*) AS arrivals, max(m - ns // 1000000) AS max_late_ms, count(*) FILTER (m < ns // 1000000) AS early FROM b GROUP BY 1')
def burst_load(spark, d):
    """The same with all of ten seconds' events in the first two."""
    return telemetry.lateness_of_load(_arrivals(spark, d), ["partition"], 3, 10_000, 2_000)


@query('WITH i AS (SELECT event_id AS i FROM events) SELECT i AS "index", CASE WHEN i < 100 THEN i * 1000000000 // 10 WHEN i < 500 THEN 10000000000 + (i - 100) * 1000000000 // 40 WHEN i < 1500 THEN 20000000000 + (i - 500) * 1000000000 // 100 END AS due_ns FROM i')
def ramp_load(spark, d):
    """Ten seconds each of 10, 40 and 100 a second, for events by number; past the ramp none is due."""
    e = topics.table(spark, d, "events").select(F.col("event_id").alias("index"))
    return e.withColumn("due_ns", telemetry.due_in_ramp(F.col("index"), [(10, 10), (40, 10), (100, 10)]))


def _arrivals(spark, d):
    log = _log(spark, d).select("partition", F.col("offset").alias("index"), "append_ms")
    first = log.groupBy("partition").agg(F.min("append_ms").alias("_first"))
    return log.join(first, "partition").select("partition", "index", (F.col("append_ms") - F.col("_first")).alias("at_ms"))


@query(
    f"WITH {A}, r AS (SELECT \"partition\", message_id, append_ms AS s, append_ms + CAST(floor(value) AS BIGINT) AS c, CASE WHEN event_type <> 'error' THEN append_ms + CAST(floor(value * 2) AS BIGINT) END AS dl FROM a), w AS (SELECT {T0} AS b, {T0 + DAY} AS e) "
    'SELECT "partition", count(*) FILTER (s >= b AND s < e) / 86400.0 AS submitted_per_second, count(*) FILTER (c >= b AND c < e) / 86400.0 AS confirmed_per_second, count(*) FILTER (dl >= b AND dl < e) / 86400.0 AS delivered_per_second, count(c) AS total_confirmed, count(DISTINCT CASE WHEN dl IS NOT NULL THEN message_id END) AS total_verified, '
    "greatest(max(c) - max(e), 0) / 1000.0 AS writer_drain_s, greatest(max(dl) - max(e), 0) / 1000.0 AS reader_drain_s FROM r, w GROUP BY 1"
)
def run_summary(spark, d):
    a = _attempts(spark, d)
    after = lambda k: F.col("append_ms") + F.floor(F.col("value") * k).cast("long")
    r = a.select("partition", "message_id", F.col("append_ms").alias("submitted_ms"), after(1).alias("confirmed_ms"), F.when(F.col("event_type") != "error", after(2)).alias("delivered_ms"))
    return telemetry.run_summary(r, ["partition"], T0, T0 + DAY)


@query(
    f'WITH {A}, s AS (SELECT "partition", append_ms AS t, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY "partition" ORDER BY append_ms, arrival_seq) AS v FROM a), u AS (SELECT "partition", t, max(v) AS v FROM s GROUP BY 1, 2), '
    f'g AS (SELECT "partition", coalesce(max(CASE WHEN t <= {T0} THEN v END), 0) AS b, max(v) AS z, max(t) AS z_at FROM u GROUP BY 1) SELECT "partition", CAST(z - b AS BIGINT) AS delta, CASE WHEN z_at > {T0} THEN (z - b) * 1000.0 / (z_at - {T0}) END AS per_second FROM g'
)
def counter_deltas(spark, d):
    """A counter that only grows, seen at every moment that has an event."""
    a = _attempts(spark, d).groupBy("partition", F.col("append_ms").alias("uptime_ms")).agg(F.sum(F.floor("value").cast("long")).alias("_v"))
    s = ordering.running(a, ["partition"], "uptime_ms", F.col("_v"), "value", "sum", DAY)
    return telemetry.counter_deltas(s, ["partition"], T0)


@query(
    "WITH k AS (SELECT event_type AS group_id, count(*) FILTER (event_id % 10 > 1) AS confirmed, count(*) FILTER (event_id % 10 = 1) AS redelivered, count(*) FILTER (event_id % 10 = 0) AS fenced FROM events GROUP BY 1), "
    "u AS (SELECT event_type AS group_id, count(DISTINCT (user_id, event_id // 100)) AS update_requests FROM events WHERE event_type <> 'view' GROUP BY 1) "
    "SELECT group_id, confirmed, redelivered, fenced, coalesce(update_requests, 0) AS update_requests, confirmed / update_requests AS acknowledgments_per_update FROM k LEFT JOIN u USING (group_id)"
)
def group_processing(spark, d):
    e = topics.table(spark, d, "events").withColumn("group_id", F.col("event_type"))
    acks = e.select("group_id", F.when(F.col("event_id") % 10 == 0, "fenced").when(F.col("event_id") % 10 == 1, "redelivered").otherwise("confirmed").alias("outcome"))
    asked = e.where("group_id <> 'view'").select("group_id", "user_id", F.floor(F.col("event_id") / 100)).distinct()
    return telemetry.group_processing(acks, asked, ["group_id"])


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 64")
def newest_diagnostics(spark, d):
    return telemetry.newest(topics.table(spark, d, "events").select("event_id", "event_type"), [F.desc("event_id")], 64)


def _lanes(spark, d):
    return topics.line_attempts(spark, d).select((F.col("producer_id") % 16).alias("lane"), F.concat_ws("/", "producer_id", "sequence").alias("lane_sequence"), "message_id", "bytes")


@query("SELECT l_orderkey % 16 AS lane, count(*) AS records, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(sha256(l_orderkey || '/' || l_linenumber || '/' || l_partkey), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM lineitem GROUP BY 1")
def lane_digests(spark, d):
    return telemetry.lane_digests(_lanes(spark, d)).withColumn("digest", F.col("digest").cast("string"))


# --- control -----------------------------------------------------------------------------


@query(
    "WITH s AS (SELECT c_nationkey AS node, CAST(floor(c_acctbal) AS BIGINT) AS o FROM customer WHERE c_custkey % 4 <> 0), f AS (SELECT node, list_sort(list_append(list(o), 0)) AS c FROM s GROUP BY 1), "
    "q AS (SELECT n_nationkey AS node, coalesce(c, [0]) AS c FROM nation LEFT JOIN f ON node = n_nationkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)) "
    "SELECT node, CASE WHEN len(c) < 2 THEN 'unknown' WHEN abs(c[(len(c) - 1) // 2 + 1]) <= 1000 AND abs(c[len(c) // 2 + 1]) <= 1000 THEN 'agreed' ELSE 'disagreed' END AS verdict FROM q"
)
def clock_verdict(spark, d):
    c = topics.table(spark, d, "customer")
    s = c.select(F.col("c_nationkey").alias("node"), F.col("c_custkey").alias("peer"), F.floor("c_acctbal").cast("long").alias("offset_ms"), F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(NOW - 1000).cast("long").alias("arrived_ms"))
    return control.clock_verdicts(s, NOW, 1000)


@query(
    "WITH r AS (SELECT c_custkey AS \"partition\", c_nationkey % 3 AS node, c_custkey * 10 AS durable, c_custkey * 9 AS known FROM customer), f AS (SELECT c_custkey AS \"partition\", CAST(max(c_custkey * 8 + s) AS BIGINT) AS best FROM customer, range(1, 3) t(s) GROUP BY 1) "
    "SELECT \"partition\", node, CASE WHEN node = 0 THEN least(durable, best) ELSE least(durable, known) END AS commit FROM r JOIN f USING (\"partition\")"
)
def quorum_commit(spark, d):
    c = topics.table(spark, d, "customer").withColumn("partition", F.col("c_custkey"))
    r = c.select("partition", (F.col("c_nationkey") % 3).alias("node"), F.when(F.col("c_nationkey") % 3 == 0, "leader").otherwise("follower").alias("role"), (F.col("c_custkey") * 10).alias("durable"), (F.col("c_custkey") * 9).alias("known_commit"))
    f = c.select("partition", F.explode(F.array(F.col("c_custkey") * 8 + 1, F.col("c_custkey") * 8 + 2)).alias("acked"))
    return control.quorum_commit(r, f)


@query(
    "WITH r AS (SELECT l_orderkey AS \"partition\", l_linenumber AS voter, l_suppkey % 3 AS v, l_partkey % 4 AS op, CASE WHEN l_quantity > 45 THEN 'x' ELSE 'd' END AS digest, l_linenumber * 2 AS committed FROM lineitem), "
    "t AS (SELECT \"partition\", max(v * 10 + op) AS k, max(committed) AS committed, count(DISTINCT voter) AS voters FROM r GROUP BY 1), a AS (SELECT \"partition\", min(voter) AS voter, count(DISTINCT digest) AS ds FROM r JOIN t USING (\"partition\") WHERE v * 10 + op = k GROUP BY 1), "
    "j AS (SELECT *, CASE WHEN voters < 2 THEN 11 WHEN ds > 1 THEN 5 END AS error_code FROM t JOIN a USING (\"partition\")) "
    "SELECT \"partition\", k // 10 AS view, k % 10 AS op, CASE WHEN error_code IS NULL THEN voter END AS source, committed, error_code FROM j"
)
def select_history(spark, d):
    x = topics.table(spark, d, "lineitem")
    return control.selected_history(x.select(F.col("l_orderkey").alias("partition"), F.col("l_linenumber").alias("voter"), (F.col("l_suppkey") % 3).alias("last_normal_view"), (F.col("l_partkey") % 4).alias("op"), F.when(F.col("l_quantity") > 45, "x").otherwise("d").alias("digest"), (F.col("l_linenumber") * 2).alias("committed")))


@query(
    "SELECT c_custkey AS \"partition\", c_nationkey AS node, CASE WHEN c_nationkey % 5 = 0 THEN 'unknown' WHEN c_nationkey % 3 = 0 THEN 'leader' ELSE 'ops' END AS kind, "
    "CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 7 ELSE greatest(CAST(c_nationkey AS BIGINT) * 10 - 100, 0) END AS ops FROM customer"
)
def replica_behind(spark, d):
    c = topics.table(spark, d, "customer")
    n = F.col("c_nationkey").cast("long")
    return control.behind(c.select(F.col("c_custkey").alias("partition"), F.col("c_nationkey").alias("node"), F.when(n % 5 == 0, "electing").otherwise("normal").alias("state"), F.when(n % 3 == 0, "leader").otherwise("follower").alias("role"), F.lit(100).cast("long").alias("accepted"), F.lit(93).cast("long").alias("acked"), (n * 10).alias("leader_commit")))


@query("SELECT c_nationkey AS node, count(*) FILTER (c_custkey % 3 = 0) AS leads, count(*) AS replicas FROM customer GROUP BY 1")
def broker_leads(spark, d):
    c = topics.table(spark, d, "customer")
    return control.leads(c.select(F.col("c_nationkey").alias("node"), F.when(F.col("c_custkey") % 3 == 0, "leader").otherwise("follower").alias("role")))


@query("SELECT n_nationkey AS node, s AS shard FROM nation, range(4) t(s) WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 4 = s)")
def missing_shards(spark, d):
    n, s = topics.table(spark, d, "nation"), topics.table(spark, d, "supplier")
    return control.missing_shards(n.select(F.col("n_nationkey").alias("node"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("shard")), s.select(F.col("s_nationkey").alias("node"), (F.col("s_suppkey") % 4).alias("shard")))


@query("SELECT coalesce(p_partkey, l_partkey) AS \"partition\", p_name AS name, n AS records FROM (SELECT * FROM part WHERE p_partkey % 2 = 0) FULL OUTER JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) ON p_partkey = l_partkey")
def partition_rows(spark, d):
    p, x = topics.table(spark, d, "part"), topics.table(spark, d, "lineitem")
    return control.with_names(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("partition"), F.col("p_name").alias("name")), x.where("l_partkey % 3 = 0").groupBy(F.col("l_partkey").alias("partition")).agg(F.count("*").alias("records")))


# --- scalars -----------------------------------------------------------------------------


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-z0-9][a-z0-9._-]{0,127}') AS valid FROM part")
def topic_names(spark, d):
    return topics.table(spark, d, "part").select("p_partkey", scalars.valid_topic_name(F.col("p_name")).alias("valid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_view(spark, d):
    """The optional typed view of a payload."""
    return topics.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- consistency -------------------------------------------------------------------------


def _receipts(spark, d):
    """Outcomes of the dedup topic with some receipts made wrong."""
    o = _dedup(spark, d)
    return o.select("partition", "message_id", F.lit(1).alias("producer_id"), F.lit(1).alias("producer_epoch"), F.col("arrival_seq").alias("sequence"), "disposition", F.when(F.col("arrival_seq") % 37 == 0, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"))


_RC = f"WITH {D}, rc AS (SELECT \"partition\", message_id, arrival_seq AS \"sequence\", disposition, CASE WHEN arrival_seq % 37 = 0 THEN 0 ELSE \"offset\" END AS \"offset\" FROM o) "


@query(_RC + "SELECT \"partition\", message_id, count(DISTINCT \"sequence\") AS attempts FROM rc WHERE disposition = 'stored' GROUP BY 1, 2 HAVING count(DISTINCT \"sequence\") > 1")
def oracle_dedup_disposition(spark, d):
    return consistency.dedup_disposition(_receipts(spark, d))


@query(_RC + ", w AS (SELECT *, lag(\"offset\") OVER (PARTITION BY \"partition\" ORDER BY \"sequence\") AS previous_offset FROM rc WHERE disposition = 'stored') SELECT \"partition\", \"sequence\", \"offset\", previous_offset FROM w WHERE \"offset\" <= previous_offset")
def oracle_producer_order(spark, d):
    return consistency.producer_order(_receipts(spark, d)).select("partition", "sequence", "offset", "previous_offset")


@query(_RC + "SELECT \"partition\", \"sequence\" FROM rc WHERE \"sequence\" % 500 = 0")
def oracle_changed_retry(spark, d):
    r = _receipts(spark, d)
    again = r.withColumn("offset", F.when(F.col("sequence") % 500 == 0, F.col("offset") + 1).otherwise(F.col("offset")))
    return consistency.changed_retries(r.unionByName(again)).select("partition", "sequence")


def _seen(spark, d):
    """Reads of the log, and receipts of which some contradict them."""
    log = _log(spark, d).select("partition", "offset", F.col("arrival_seq").alias("message_id"), F.col("arrival_seq").alias("fingerprint"), "arrival_seq")
    read = log.withColumns({"attempt_only": F.lit(False), "disposition": F.lit(None).cast("string")})
    n = F.col("arrival_seq")
    told = log.withColumns({"attempt_only": F.lit(True), "disposition": F.when(n % 10 == 9, "duplicate").otherwise("stored"), "offset": F.when(n % 333 == 0, F.col("offset") - 1).otherwise(F.col("offset")), "fingerprint": F.when(n % 10 >= 8, -n).otherwise(n)})
    return read.unionByName(told).drop("arrival_seq")


_SN = f"WITH {L}, sn AS (SELECT \"partition\", \"offset\", arrival_seq AS message_id, arrival_seq AS fingerprint, NULL AS told FROM l UNION ALL SELECT \"partition\", CASE WHEN arrival_seq % 333 = 0 THEN \"offset\" - 1 ELSE \"offset\" END, arrival_seq, CASE WHEN arrival_seq % 10 >= 8 THEN -arrival_seq ELSE arrival_seq END, CASE WHEN arrival_seq % 10 = 9 THEN 'duplicate' ELSE 'stored' END FROM l) "


@query(_SN + "SELECT \"partition\", \"offset\", count(DISTINCT (message_id, fingerprint)) AS values FROM sn WHERE told IS DISTINCT FROM 'duplicate' GROUP BY 1, 2 HAVING count(DISTINCT (message_id, fingerprint)) > 1")
def oracle_conflicting_offset(spark, d):
    return consistency.conflicting_offsets(_seen(spark, d))


@query(_SN + 'SELECT "partition", message_id, count(DISTINCT "offset") AS places FROM sn GROUP BY 1, 2 HAVING count(DISTINCT "offset") > 1')
def oracle_duplicate_storage(spark, d):
    return consistency.duplicate_storage(_seen(spark, d))


@query("SELECT r AS round, range AS key FROM range(12), (VALUES ('warm'), ('cold')) t(r) WHERE range NOT IN (SELECT DISTINCT c_nationkey % 10 FROM customer WHERE c_acctbal > 0)")
def oracle_missing_markers(spark, d):
    markers = topics.table(spark, d, "customer").where("c_acctbal > 0").select((F.col("c_nationkey") % 10).cast("long").alias("key"))
    return consistency.missing_markers(markers, spark.range(12).withColumnRenamed("id", "key"), ["warm", "cold"])


@query("SELECT l_orderkey % 16 AS lane, count(*) AS written_records, count(*) + count(*) FILTER (l_partkey % 1000 = 0) AS read_records FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_partkey % 1000 = 0) > 0")
def oracle_lane_digest(spark, d):
    """Some records were delivered twice more."""
    x = _lanes(spark, d)
    return consistency.lane_mismatches(x, x.unionByName(x.where("message_id % 1000 = 0")))


@query(f"WITH {D}, st AS (SELECT \"partition\", \"offset\", message_id AS stored_id FROM o WHERE disposition = 'stored'), du AS (SELECT \"partition\", arrival_seq, message_id, CASE WHEN arrival_seq % 37 = 0 THEN 0 ELSE \"offset\" END AS \"offset\" FROM o WHERE disposition = 'duplicate') SELECT du.\"partition\", du.arrival_seq AS \"sequence\" FROM du LEFT JOIN st USING (\"partition\", \"offset\") WHERE du.message_id IS DISTINCT FROM stored_id")
def oracle_wrong_dedup_target(spark, d):
    seen = _dedup(spark, d).where("disposition = 'stored'").select("partition", "offset", "message_id", F.lit(False).alias("attempt_only"))
    return consistency.wrong_dedup_targets(_receipts(spark, d), seen).select("partition", "sequence")


@query(f'WITH {L} SELECT event_type AS session, "partition", "offset", row_number() OVER (PARTITION BY event_type, "partition" ORDER BY arrival_seq) - 1 AS expected FROM l QUALIFY "offset" <> row_number() OVER (PARTITION BY event_type, "partition" ORDER BY arrival_seq) - 1')
def oracle_reader_order(spark, d):
    return consistency.reader_order(_log(spark, d).select(F.col("event_type").alias("session"), "partition", "offset", F.col("arrival_seq").alias("delivery_seq"))).select("session", "partition", "offset", "expected")


@query(f'WITH {A} SELECT k AS round, "partition", message_id FROM a, range(1, 3) t(k) WHERE event_type = \'purchase\' AND arrival_seq % (100 * k) = 0')
def oracle_lost_ack(spark, d):
    a = _attempts(spark, d)
    sent = a.where("event_type = 'purchase'").select("partition", "message_id")
    rounds = a.select("partition").distinct().withColumn("round", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    read = sent.join(rounds, "partition").where("message_id % (100 * round) <> 0")
    return consistency.lost(sent, read, rounds)


@query(f'WITH {A} SELECT message_id FROM a WHERE arrival_seq % 250 = 0 OR arrival_seq % 350 = 0')
def oracle_uninvoked(spark, d):
    a = _attempts(spark, d).select("partition", "message_id", F.col("props").alias("fingerprint"))
    seen = a.withColumn("fingerprint", F.when(F.col("message_id") % 250 == 0, "changed").otherwise(F.col("fingerprint"))).withColumn("partition", F.when(F.col("message_id") % 350 == 0, F.col("partition") + 1).otherwise(F.col("partition")))
    return consistency.uninvoked(seen, a).select("message_id")


@query(f'WITH {A} SELECT message_id FROM a WHERE arrival_seq % 400 = 0')
def oracle_fenced_visible(spark, d):
    a = _attempts(spark, d).select("partition", "message_id")
    refused = a.where("message_id % 200 = 0").withColumn("partition", F.when(F.col("message_id") % 400 == 0, F.col("partition")).otherwise(F.col("partition") + 1))
    return consistency.fenced_visible(a, refused).select("message_id")


@query("SELECT c_custkey AS request_id FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 11 = 0")
def oracle_wrong_receipt(spark, d):
    c = topics.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("message_id"), F.col("c_nationkey").alias("partition"))
    r = c.withColumns({"policy": F.when(F.col("request_id") % 9 == 0, "local").otherwise("quorum"), "message_id": F.when(F.col("request_id") % 11 == 0, "other").otherwise(F.col("message_id"))})
    return consistency.wrong_receipts(r, c, "quorum").select("request_id")


@query("SELECT c_custkey AS request_id FROM customer WHERE c_nationkey % 4 < 2")
def oracle_minority(spark, d):
    c = topics.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_nationkey") % 4).alias("votes"))
    return consistency.minority_confirmations(c).select("request_id")


@query("SELECT range AS key FROM range(12) WHERE range NOT IN (SELECT DISTINCT c_nationkey % 10 FROM customer)")
def oracle_coverage(spark, d):
    return consistency.uncovered(topics.table(spark, d, "customer").select((F.col("c_nationkey") % 10).cast("long").alias("key")), spark.range(12).withColumnRenamed("id", "key"))


@query(f'WITH {L} SELECT "partition", "offset" FROM l WHERE octet_length(encode(props)) <> 9')
def oracle_lane(spark, d):
    x = ordering.position(_log(spark, d), ["producer_id"], "arrival_seq", "lane_sequence")
    return consistency.lane_errors(x.select("partition", "offset", F.col("producer_id").alias("lane"), "lane_sequence", F.col("arrival_seq").alias("delivery_seq"), F.octet_length("props").alias("bytes")), 9).select("partition", "offset")


@query("WITH f AS (SELECT l_orderkey AS fault, l_linenumber AS n, l_quantity < 25 AS ends FROM lineitem), b AS (SELECT fault, n AS s, row_number() OVER (PARTITION BY fault ORDER BY n) AS k FROM f), e AS (SELECT fault, n AS s, row_number() OVER (PARTITION BY fault ORDER BY n) AS k FROM f WHERE ends) SELECT b.fault, b.k AS n FROM b LEFT JOIN e USING (fault, k) WHERE e.s IS NULL OR e.s * 2 + 1 < b.s * 2")
def oracle_faults(spark, d):
    x = topics.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fault"), F.col("l_linenumber").alias("n"), "l_quantity")
    begun = x.select("fault", (F.col("n") * 2).alias("seq"), F.lit("begin").alias("phase"))
    ended = x.where("l_quantity < 25").select("fault", (F.col("n") * 2 + 1).alias("seq"), F.lit("end").alias("phase"))
    return consistency.unmatched_faults(begun.unionByName(ended)).select("fault", "n")


# --- guards ------------------------------------------------------------------------------


@query(_LIVE + 'SELECT "partition", count(*) AS entries, 10 AS error_code FROM li GROUP BY 1 HAVING count(*) > 5')
def dedup_capacity(spark, d):
    return dedup.over_capacity(dedup.live_identities(_dedup(spark, d), WINDOW), 5)


@query("SELECT c_custkey AS \"partition\", c_nationkey AS node FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING min(s_suppkey) % 2 = 0)")
def trusted_partitions(spark, d):
    c, s = topics.table(spark, d, "customer"), topics.table(spark, d, "supplier")
    first = s.groupBy(F.col("s_nationkey").alias("node")).agg(F.min("s_suppkey").alias("k"))
    samples = first.select("node", F.lit(1).alias("peer"), F.when(F.col("k") % 2 == 0, 10).otherwise(5000).cast("long").alias("offset_ms"), F.lit(NOW).alias("arrived_ms"))
    return control.while_trusted(c.select(F.col("c_custkey").alias("partition"), F.col("c_nationkey").alias("node")), control.clock_verdicts(samples, NOW, 1000))


@query("SELECT r_regionkey AS group_id, r_regionkey + 1 AS revision, 1 AS prior_revision, CASE WHEN r_regionkey = 2 THEN 1 ELSE 7 END AS error_code FROM region WHERE r_regionkey <> 1")
def group_plan_errors(spark, d):
    """The third region's members repeat; all but the second expect another revision."""
    r, n = topics.table(spark, d, "region"), topics.table(spark, d, "nation")
    g = r.select(F.col("r_regionkey").alias("group_id"), (F.col("r_regionkey") + 1).alias("revision"), F.lit(1).alias("prior_revision"))
    m = n.select(F.col("n_regionkey").alias("group_id"), F.when(F.col("n_regionkey") == 2, 0).otherwise(F.col("n_nationkey")).alias("member_id"))
    return groups.invalid_plans(g, m, n.select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("partition")))


@query("SELECT c_custkey AS \"partition\", CASE WHEN c_custkey % 3 = 0 THEN 8 WHEN c_nationkey % 2 = 0 THEN 2 END AS error_code FROM customer")
def partition_creation(spark, d):
    c = topics.table(spark, d, "customer")
    ask = c.select(F.lit("t").alias("topic"), F.col("c_custkey").alias("partition"), F.lit(1000).alias("dedup_window_ms"), F.when(F.col("c_nationkey") % 2 == 0, 5).alias("delay_max_ms"))
    return append.create_partitions(ask, ask.where("partition % 3 = 0")).select("partition", "error_code")


@query(
    "WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS kase, o_orderpriority AS mode, epoch_us(o_orderdate) // 1000 AS started_ms FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY kase ORDER BY started_ms DESC, run_id DESC) AS k FROM r) "
    "SELECT r.run_id, r.kase, r.mode FROM r JOIN n ON n.k = 1 AND n.kase = r.kase AND n.mode = r.mode"
)
def ledger_selection(spark, d):
    o = topics.table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("kase"), F.col("o_orderpriority").alias("mode"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started_ms"))
    return telemetry.selected_runs(runs, ["kase"], ["mode"]).select("run_id", "kase", "mode")


# --- bounded state -----------------------------------------------------------------------


@query(
    f"WITH {D}, cf AS (SELECT \"partition\", CAST(max(\"offset\") * 3 // 4 AS BIGINT) AS ok FROM o GROUP BY 1), pe AS (SELECT o.\"partition\", split_part(message_id, '/', 1) AS producer_id, min(arrival_seq) AS since FROM o JOIN cf USING (\"partition\") WHERE disposition = 'duplicate' AND \"offset\" >= ok GROUP BY 1, 2) "
    "SELECT o.\"partition\", arrival_seq, arrival_seq = since AS pending FROM o JOIN pe ON pe.\"partition\" = o.\"partition\" AND pe.producer_id = split_part(o.message_id, '/', 1) WHERE arrival_seq >= since"
)
def dedup_waiting(spark, d):
    """What waits while three quarters of each partition are confirmed."""
    o = _dedup(spark, d).withColumn("producer_id", F.split_part("message_id", F.lit("/"), F.lit(1)))
    confirmed = o.groupBy("partition").agg(F.floor(F.max("offset") * 3 / 4).cast("long").alias("next_offset"))
    return dedup.waiting(o, confirmed).select("partition", "arrival_seq", "pending")


@query(None)
def dedup_admission(spark, d):
    """Refusals depend on all that came before: a test holds them against a plain index."""
    a = _attempts(spark, d).select("partition", F.floor(F.col("arrival_seq") / 20).alias("request"), "append_ms", F.concat_ws("/", "producer_id", "event_type").alias("id"))
    r = a.groupBy("partition", "request").agg(F.max("append_ms").alias("time"), F.collect_set("id").alias("message_ids"))
    return dedup.admitted(r, WINDOW, 8).select("partition", "request", "error_code")


@query(
    f'WITH {D} SELECT o."partition", arrival_seq, disposition FROM o WHERE arrival_seq >= (SELECT max(arrival_seq) // 2 FROM o)'
)
def dedup_restore(spark, d):
    """The second half of the attempts, decided from what the first half left, gives what all together give."""
    a = _attempts(spark, d).select("arrival_seq", "partition", F.concat_ws("/", "producer_id", "event_type").alias("message_id"), "append_ms")
    half = a.agg(F.max("arrival_seq")).first()[0] // 2
    early = dedup.classify(a.where(F.col("arrival_seq") < half), WINDOW)
    return dedup.restored(dedup.live_identities(early, WINDOW), dedup.clocks(early), a.where(F.col("arrival_seq") >= half), WINDOW).select("partition", "arrival_seq", "disposition")


@query(None)
def schedule_capacity(spark, d):
    """Refusals depend on what is held: a test holds them against a plain queue."""
    return delay.schedule_within(_orders(spark, d), 60 * DAY, 300).select("partition", "arrival_seq", "error_code")


@query(f'WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY release_ms, schedule) - 1 AS place FROM h WHERE release_ms <= {SHIP_NOW}) SELECT "partition", arrival_seq, place FROM r WHERE place < 64')
def due_prefix(spark, d):
    """What one step of 64 releases."""
    return delay.due_prefix(_held(spark, d), SHIP_NOW, 64).select("partition", "arrival_seq", "place")


@query(
    "WITH g AS (SELECT r_regionkey AS group_id, r_name AS name, r_regionkey + 1 AS revision FROM region), p AS (SELECT n_nationkey AS group_id, CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE n_name END AS name, n_nationkey % 4 AS expected FROM nation JOIN region ON r_regionkey = n_nationkey % 5), "
    "j AS (SELECT p.*, g.name AS own, g.revision AS rev, o.group_id AS owner FROM p LEFT JOIN g USING (group_id) LEFT JOIN g o ON o.name = p.name), "
    "e AS (SELECT *, CASE WHEN coalesce(rev, 0) <> expected THEN 5 WHEN own <> name OR owner <> group_id THEN 1 END AS error_code FROM j) SELECT group_id, name, CASE WHEN error_code IS NULL THEN expected + 1 ELSE rev END AS revision, error_code FROM e"
)
def group_install(spark, d):
    """Plans for groups that are there and new ones, some at a stale revision, some under another's name."""
    r, n = topics.table(spark, d, "region"), topics.table(spark, d, "nation")
    there = r.select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).alias("revision"))
    named = n.join(r, r.r_regionkey == n.n_nationkey % 5)
    plans = named.select(F.col("n_nationkey").alias("group_id"), F.when(F.col("n_nationkey") % 3 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("name"), (F.col("n_nationkey") % 4).alias("expected_revision"), (F.col("n_nationkey") % 4 + 1).alias("revision"))
    return groups.install_plans(there, plans)


@query("SELECT n_nationkey AS group_id, CASE WHEN r_regionkey + 1 = n_nationkey % 3 + 1 THEN r_name END AS freed, CASE WHEN r_regionkey IS NULL THEN 1 WHEN r_regionkey + 1 <> n_nationkey % 3 + 1 THEN 5 END AS error_code FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def group_delete(spark, d):
    r, n = topics.table(spark, d, "region"), topics.table(spark, d, "nation")
    there = r.select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).alias("revision"))
    return groups.delete_groups(there, n.select(F.col("n_nationkey").alias("group_id"), (F.col("n_nationkey") % 3 + 1).alias("revision")))


@query(_PROG + 'SELECT pr.group_id, l."partition", l."offset" FROM l JOIN pr ON pr."partition" = l."partition" AND l."offset" >= pr.next_offset AND l."offset" < pr.next_offset + 32')
def group_deliverable(spark, d):
    """What each group may have in processing from its cursors on, 32 records to a partition."""
    return groups.deliverable(_log(spark, d), _progress(spark, d).withColumnRenamed("next_offset", "cursor"), 32).select("group_id", "partition", "offset")


@query(_PROG + 'SELECT group_id, "partition", next_offset, (row_number() OVER (PARTITION BY "partition" ORDER BY group_id) - 1) // 2 AS proposal FROM pr')
def progress_proposals(spark, d):
    return groups.proposals(_progress(spark, d), 2)


@query(
    f"WITH RECURSIVE {L}, n AS (SELECT \"partition\", \"offset\", \"offset\" + 1 AS rn, octet_length(encode(props)) * (1 + arrival_seq % 9) AS bytes FROM l), "
    'c AS (SELECT DISTINCT "partition", CAST(-1 AS BIGINT) AS "offset", CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seg, CAST(0 AS BIGINT) AS used FROM n UNION ALL '
    'SELECT n."partition", n."offset", n.rn, CASE WHEN c.used > 0 AND c.used + n.bytes > 4096 THEN c.seg + 1 ELSE c.seg END, CASE WHEN c.used > 0 AND c.used + n.bytes > 4096 THEN n.bytes ELSE c.used + n.bytes END FROM c JOIN n ON n."partition" = c."partition" AND n.rn = c.rn + 1) '
    'SELECT "partition", seg AS segment, min("offset") AS first_offset, max("offset") + 1 AS record_end FROM c WHERE rn > 0 GROUP BY 1, 2'
)
def segment_roll(spark, d):
    """Segments of 4 KiB, however many records that takes."""
    log = _log(spark, d).withColumn("bytes", F.octet_length("props") * (1 + F.col("arrival_seq") % 9))
    return retention.rolled(log, 4096).groupBy("partition", "segment").agg(F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("record_end"))


@query(
    _SQL["retention_plan"].replace("SELECT \"partition\", coalesce(string_agg", ", rp AS (SELECT \"partition\", coalesce(string_agg", 1).replace("z AS (SELECT *, min(CASE WHEN NOT due OR holds THEN id END) OVER (PARTITION BY \"partition\") AS stop FROM w) ,", "z AS (SELECT *, min(CASE WHEN NOT due OR holds THEN id END) OVER (PARTITION BY \"partition\") AS stop FROM w),")
    + ') SELECT l."partition", min(l."offset") AS retained_from, count(*) AS records FROM l JOIN rp USING ("partition") WHERE l."offset" >= rp.record_floor GROUP BY 1'
)
def retention_turn(spark, d):
    """What is left of the log after one turn."""
    left = retention.turn(_log(spark, d), _segments(spark, d), _policies(spark, d), NOW)
    return left.groupBy("partition").agg(F.min("offset").alias("retained_from"), F.count("*").alias("records"))


@query(f"WITH {L}, s AS (SELECT producer_id, max(arrival_seq) AS op FROM l GROUP BY 1) SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(sha256(producer_id || '/' || op), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM s")
def snapshot_digest(spark, d):
    a = _attempts(spark, d).groupBy("producer_id").agg(F.max("arrival_seq").alias("op"))
    return retention.snapshot_digest(a, ["producer_id", "op"]).withColumn("digest", F.col("digest").cast("string"))


@query(
    "WITH p AS (SELECT c_nationkey % 4 AS pt, c_custkey AS id, c_nationkey AS epoch, c_custkey % 10 AS nxt FROM customer), r AS (SELECT *, id % 3 = 0 AND id % 5 <> 0 AS goes FROM p) "
    'SELECT pt AS "partition", count(*) FILTER (NOT goes) AS sessions, greatest(max(CASE WHEN goes THEN epoch END), 2) AS retired_epoch FROM r GROUP BY 1'
)
def producer_retirement(spark, d):
    """Every third session is seen idle, every fifth of them sends again before it is retired."""
    p = topics.table(spark, d, "customer").select((F.col("c_nationkey") % 4).alias("partition"), F.col("c_custkey").alias("producer_id"), F.col("c_nationkey").alias("epoch"), (F.col("c_custkey") % 10).alias("next_sequence"))
    seen = p.where("producer_id % 3 = 0").withColumn("next_sequence", F.col("next_sequence") - F.when(F.col("producer_id") % 5 == 0, 1).otherwise(0))
    left = append.retire(p, seen).groupBy("partition").agg(F.count("*").alias("sessions"))
    before = p.select("partition").distinct().withColumn("epoch", F.lit(2))
    return left.join(append.retired_epochs(p, seen, before).withColumnRenamed("epoch", "retired_epoch"), "partition")


@query("SELECT n_nationkey, coalesce(r_name, '?') || '/' || n_name AS label, lpad(CAST((n_nationkey * 3000) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((n_nationkey * 3000) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((n_nationkey * 3000) % 60 AS VARCHAR), 2, '0') AS uptime, CASE WHEN n_nationkey = 0 THEN '0' WHEN n_nationkey < 4 THEN printf('%.0f', n_nationkey * 250.0) WHEN n_nationkey < 40 THEN printf('%.2fk', n_nationkey * 0.25) END AS rate FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 3")
def display_texts(spark, d):
    n, r = topics.table(spark, d, "nation"), topics.table(spark, d, "region")
    joined = n.join(r, (n.n_regionkey == r.r_regionkey) & (r.r_regionkey != 3), "left")
    return joined.select("n_nationkey", scalars.group_label(F.col("r_name"), F.col("n_name")).alias("label"), scalars.uptime_text(F.col("n_nationkey") * 3_000_000).alias("uptime"), scalars.rate_text(F.col("n_nationkey") * 250.0).alias("rate"))
