"""Streaming queries over events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import pipelines as p


def tumbling(s, d):
    out = p.run_available(p.tumbling(p.events_stream(s, d), "1 day"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("v", 2).alias("v"))


def sliding(s, d):
    out = p.run_available(p.sliding(p.events_stream(s, d), "6 hours", "2 hours"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(s, d):
    out = p.run_available(p.sessions(p.events_stream(s, d), "2 hours"), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first"), "n")


def deduplicated(s, d):
    ev = p.events_stream(s, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return p.run_available(p.deduplicated(ev, ["event_id"]), "append").select("event_id", "event_type")


def current(s, d):
    """The last emission per user: the newest event."""
    out = p.run_available(p.current_state(p.events_stream(s, d)), "update")
    return out.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("v")).select("user_id", "v.event_id", "v.event_type")


def enriched(s, d):
    kinds = s.createDataFrame([("click", 1), ("view", 2), ("purchase", 3)], "event_type string, weight int")
    out = p.run_available(p.enriched(p.events_stream(s, d), kinds, "event_type"), "append")
    return out.groupBy("event_type").agg(F.sum("weight").alias("weights"))


QUERIES = {"stream_tumbling": tumbling, "stream_sliding": sliding, "stream_sessions": sessions, "stream_dedup": deduplicated, "stream_current": current, "stream_enriched": enriched}
SQL = {
    "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([b, b - INTERVAL 2 HOUR, b - INTERVAL 4 HOUR]) AS start FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS b FROM events)) GROUP BY 1",
    "stream_sessions": """
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m)
SELECT user_id, min(ts) AS first, count(*) AS n FROM r GROUP BY user_id, run""",
    "stream_dedup": "SELECT event_id, event_type FROM events",
    "stream_current": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_enriched": "SELECT event_type, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END) AS BIGINT) AS weights FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1",
}
