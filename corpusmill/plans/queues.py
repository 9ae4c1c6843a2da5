"""Queries of bounded queues, staleness and streaming tables, replayed from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.runtime import table
from corpusmill.plans.registry import REGISTRY as R
from corpusmill.plans.views import rounded
from corpusmill.streaming import queue as Q


def _log(spark, sf):
    """Two puts for a get, one queue an event type; the version rises every 500 events."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 2, "get").otherwise("put").alias("kind"), F.col("event_id").alias("item"), F.floor(F.col("event_id") / 500).cast("bigint").alias("version"))


def _fifo(log: str, capacity: int | None) -> str:
    """SQL of a queue's state after each event of ``log`` (queue, seq, kind, item, k from 1 per queue), by recursion over k."""
    full = f"len(s.items) >= {capacity}" if capacity is not None else "false"
    return f"""s AS (
  SELECT queue, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS kind, CAST(NULL AS BIGINT) AS item, CAST([] AS BIGINT[]) AS items, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS produced, CAST(0 AS BIGINT) AS consumed FROM {log} WHERE k = 1
  UNION ALL SELECT l.queue, l.k, l.seq, l.kind, CASE WHEN l.kind = 'put' THEN l.item ELSE s.items[1] END, CASE WHEN l.kind = 'put' THEN list_append(CASE WHEN {full} THEN s.items[2:] ELSE s.items END, l.item) ELSE s.items[2:] END,
    s.dropped + CASE WHEN l.kind = 'put' AND {full} THEN 1 ELSE 0 END, s.produced + CASE WHEN l.kind = 'put' THEN 1 ELSE 0 END, s.consumed + CASE WHEN l.kind = 'get' AND len(s.items) > 0 THEN 1 ELSE 0 END
  FROM s JOIN {log} l ON l.queue = s.queue AND l.k = s.k + 1)"""


_LOG = "l AS (SELECT event_type AS queue, event_id AS seq, CASE WHEN event_id % 3 = 2 THEN 'get' ELSE 'put' END AS kind, event_id AS item, event_id // 500 AS version, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)"
_STATE = "queue, seq, kind, item, CAST(len(items) AS BIGINT) AS size, dropped, produced, consumed"


@R.add("st1_bounded_queue", f"WITH RECURSIVE {_LOG}, {_fifo('l', 16)} SELECT {_STATE} FROM s WHERE k > 0")
def st1_bounded_queue(spark, sf):
    """The queue after every event, its oldest sample dropped when full."""
    return Q.replay(_log(spark, sf), 16)


@R.add("st1_counters", f"WITH RECURSIVE {_LOG}, {_fifo('l', 16)} SELECT queue, max(produced) AS produced, max(consumed) AS consumed, max(dropped) AS dropped FROM s GROUP BY queue")
def st1_counters(spark, sf):
    """Samples produced, consumed and dropped by each queue."""
    return Q.replay(_log(spark, sf), 16).groupBy("queue").agg(*[F.max(c).alias(c) for c in ("produced", "consumed", "dropped")])


_SIDE = "v AS (SELECT event_type || '/validation' AS queue, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'get' ELSE 'put' END AS kind, event_id AS item, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE event_id % 5 = 0 OR event_id % 10 = 1)"


@R.add("st5_side_queue", f"WITH RECURSIVE {_SIDE}, {_fifo('v', None)} SELECT {_STATE} FROM s WHERE k > 0")
def st5_side_queue(spark, sf):
    """The side queue of validation samples: without a limit, asked more often than filled."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    side = e.filter((i % 5 == 0) | (i % 10 == 1)).select(F.concat("event_type", F.lit("/validation")).alias("queue"), i.alias("seq"), F.when(i % 5 == 0, "get").otherwise("put").alias("kind"), i.alias("item"))
    return Q.replay(side, None)


@R.add(
    "st2_staleness",
    f"""WITH RECURSIVE {_LOG}, {_fifo('l', 16)},
m AS (SELECT s.queue, s.seq, s.kind, CAST(len(s.items) AS BIGINT) AS size, CASE WHEN l.version > lag(l.version) OVER (PARTITION BY s.queue ORDER BY s.seq) THEN 1 ELSE 0 END AS fresh FROM s JOIN l ON l.queue = s.queue AND l.seq = s.seq),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY queue ORDER BY seq) AS span FROM m),
t AS (SELECT queue, seq, size, CAST(first_value(CASE WHEN fresh = 1 THEN size ELSE 0 END) OVER w + sum(CASE WHEN kind = 'put' AND fresh = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS stale FROM g WINDOW w AS (PARTITION BY queue, span ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT queue, seq, stale, stale >= 48 OR size >= 16 AS paused FROM t""",
)
def st2_staleness(spark, sf):
    """Which puts find production paused: queue full or staleness at its limit."""
    log = _log(spark, sf)
    state = Q.replay(log, 16).join(log.select("queue", "seq", "version"), ["queue", "seq"])
    return Q.pauses(state, Q.staleness_limit(16, 0.5, 2), 16).select("queue", "seq", "stale", "paused")


@R.add("st2_stale_counts", "SELECT count(*) AS samples, count(*) FILTER (event_id % 4 >= 1) AS stale, round(count(*) FILTER (event_id % 4 >= 1) / count(*), 6) + 0.0 AS stale_share FROM events")
def st2_stale_counts(spark, sf):
    rows = table(spark, sf, "events").select(F.lit(0).alias("version"), (F.col("event_id") % 4).alias("current_version"))
    return rounded(Q.stale_counts(rows), "stale_share")


@R.add("st4_resume_order", "SELECT event_id AS seq, row_number() OVER (ORDER BY event_id % 5 <> 0, event_id) - 1 AS place, event_id % 5 <> 0 AS counts FROM events")
def st4_resume_order(spark, sf):
    """Every sample's place when cancelled ones are resumed first."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 5 == 0).alias("cancelled"))
    return Q.resume_order(rows).select("seq", "place", "counts")


@R.add("st6_count_windows", 'SELECT event_id // 250 AS "window", count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY 1')
def st6_count_windows(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "value")
    return rounded(Q.count_windows(rows, 250).groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


_CELLS = "c AS (SELECT event_id // 3 AS sample, (['prompt', 'response', 'reward'])[1 + event_id % 3] AS field, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, event_id AS seq FROM events)"


def _cells(spark, sf):
    names = F.array(*map(F.lit, ["prompt", "response", "reward"]))
    return table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).cast("bigint").alias("sample"), F.get(names, (F.col("event_id") % 3).cast("int")).alias("field"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.col("event_id").alias("seq"))


@R.add("st7_ready", f"WITH {_CELLS} SELECT sample FROM c WHERE field IN ('prompt', 'response') AND value IS NOT NULL AND sample % 10 <> 0 GROUP BY sample HAVING count(DISTINCT field) = 2")
def st7_ready(spark, sf):
    cells = _cells(spark, sf)
    return Q.ready_samples(cells, ["prompt", "response"], cells.filter("sample % 10 = 0"))


@R.add("st7_fields", f"WITH {_CELLS}, r AS (SELECT sample FROM c WHERE field IN ('prompt', 'reward') AND value IS NOT NULL GROUP BY sample HAVING count(DISTINCT field) = 2) SELECT sample, max(value) FILTER (field = 'prompt') AS prompt, max(value) FILTER (field = 'reward') AS reward FROM c WHERE sample IN (SELECT sample FROM r) GROUP BY sample")
def st7_fields(spark, sf):
    cells = _cells(spark, sf)
    return Q.get_fields(cells, Q.ready_samples(cells, ["prompt", "reward"]), ["prompt", "reward"])


@R.add(
    "st8_token_bucket",
    """WITH RECURSIVE q AS (SELECT event_type AS bucket, event_id * 0.01::DOUBLE AS at_, value AS cost FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY at_, cost) AS k FROM q),
s AS (SELECT bucket, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS at_, CAST(0 AS DOUBLE) AS cost, CAST(300 AS DOUBLE) AS tokens, CAST(0 AS DOUBLE) AS now FROM r WHERE k = 1
  UNION ALL SELECT bucket, k, at_, cost, have + wait * 600 - cost, t + wait FROM (
    SELECT *, greatest(0.0::DOUBLE, (cost - have) / 600) AS wait FROM (
      SELECT r.bucket, r.k, r.at_, r.cost, greatest(r.at_, s.now) AS t, least(300.0::DOUBLE, s.tokens + (greatest(r.at_, s.now) - s.now) * 600) AS have FROM s JOIN r ON r.bucket = s.bucket AND r.k = s.k + 1)))
SELECT bucket, round(at_, 6) + 0.0 AS "at", round(cost, 6) + 0.0 AS cost, round(now, 6) + 0.0 AS start FROM s WHERE k > 0""",
)
def st8_token_bucket(spark, sf):
    """When requests may start under a rate limit, a bucket an event type."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("bucket"), (F.col("event_id") * 0.01).alias("at"), F.col("value").alias("cost"))
    return rounded(Q.token_bucket(rows, 600.0, 300.0))


@R.add("st_event_windows", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY 1, 2")
def st_event_windows(spark, sf):
    """Event-time windows, an extension."""
    out = Q.event_windows(table(spark, sf, "events"), "6 hours", "1 hour", by=["event_type"])
    return rounded(out, "total").withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add(
    "st3_take",
    """WITH p AS (SELECT event_type AS queue, event_id AS seq, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 8 AS batch FROM events WHERE event_id % 3 <> 2)
SELECT queue, seq, batch FROM p QUALIFY count(*) OVER (PARTITION BY queue, batch) = 8""",
)
def st3_take(spark, sf):
    """The batch of exactly eight samples in which each sample of a queue is taken, oldest first."""
    puts = _log(spark, sf).filter("kind = 'put'")
    return Q.full_batches(puts, 8).select("queue", "seq", "batch")
