"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinspark.plans.registry import Registry
from skeinspark.streaming import streams as S
from skeinspark.streaming.stateful import timed_sessions

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _events(spark, sf_dir):
    return S.events(spark, f"{sf_dir}/events.parquet")


@query("""
SELECT start, event_type, n, total FROM (
  SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def t4_watermark_append(spark, sf_dir):
    out = S.run_to_end(S.windowed_counts(_events(spark, sf_dir)), "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, event_type FROM events")
def t5_stream_dedup(spark, sf_dir):
    e = _events(spark, sf_dir)
    return S.run_to_end(S.deduplicated(e.union(e), ["event_id"]), "dedup").select("event_id", "user_id", "event_type")


@query("""
SELECT v.user_id, v.event_id AS first_id, p.event_id AS then_id FROM events v JOIN events p
  ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'
""")
def t6_stream_join(spark, sf_dir):
    return S.run_to_end(S.followed_by(_events(spark, sf_dir), "view", "purchase"), "join")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def t7_custom_state(spark, sf_dir):
    out = S.run_to_end(S.running_totals(_events(spark, sf_dir)), "state")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("""
WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a),
k AS (SELECT user_id, s, event_type, count(*) AS c FROM b GROUP BY ALL),
m AS (SELECT user_id, s, count(*) AS kinds, arg_min(event_type, (-c, event_type)) AS most FROM k GROUP BY ALL)
SELECT * FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n, any_value(kinds) AS kinds, any_value(most) AS most, round(sum(value), 4) AS total
  FROM b JOIN m USING (user_id, s) GROUP BY user_id, s)
WHERE finish < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)
""")
def t7_timed_sessions(spark, sf_dir):
    """State in a list, a map and a value for each user, emitted and dropped by timers in event time."""
    out = S.run_to_end(timed_sessions(_events(spark, sf_dir)), "timers", S.ROCKS)
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "finish")), "n", "kinds", "most", F.round("total", 4).alias("total"))


@query("""
WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT * FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM b GROUP BY user_id, s)
WHERE finish <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def t8_stream_sessions(spark, sf_dir):
    out = S.run_to_end(S.sessions(_events(spark, sf_dir)), "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "finish")})


@query("""
SELECT start, event_type, n FROM (
  SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-16') GROUP BY 1, 2)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def t8_late_data(spark, sf_dir):
    """Errors of the first half of the month arrive after everything else, two batches behind the watermark, and reopen no window."""
    parts = ["not late and ts < middle", "not late and ts >= middle and ts < middle + interval 9 days", "ts >= middle + interval 9 days", "late"]
    out = S.run_in_order(spark, f"{sf_dir}/events.parquet", parts, S.windowed_counts, "late", late="event_type = 'error' and ts < middle", middle="timestamp_ntz '2024-01-16'")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
