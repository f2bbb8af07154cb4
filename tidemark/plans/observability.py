"""Queries over spans, logs, fleet samples and object listings made of events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import observe
from tidemark.plans.changes import read

SPANS = """spans AS (SELECT concat('n', user_id % 4) AS node, md5(CAST(user_id AS STRING)) AS trace_id, substr(md5(CAST(event_id AS STRING)), 1, 16) AS span_id, event_type AS name,
  event_id * 1000000 AS start_unix_us, CAST(round(value * 1000) AS BIGINT) AS duration_us, event_type <> 'error' AS ok, CASE WHEN event_id % 10 = 0 THEN event_id % 20 = 0 END AS parent_sampled, event_id, user_id, value FROM EVENTS)"""
PEERS = """peers AS (SELECT concat('p', user_id) AS node, count(*) AS owned_cells, 1 + user_id % 3 AS placement_weight, 100000 - user_id AS sampled_ms, 100000 + 10 * user_id - 5 AS expires_ms, user_id % 11 = 0 AS draining, user_id % 13 % 2 * (user_id % 13) AS restoring, TRUE AS paced, FALSE AS paused FROM EVENTS GROUP BY user_id)"""
OBJECTS = """objects AS (SELECT concat('spans/n', o_custkey % 3, '/', CASE WHEN o_orderkey % 50 = 0 THEN 'junk' ELSE concat('2024/0', 1 + o_orderkey % 9, '/1', o_orderkey % 10, '/0', o_orderkey % 7) END, '/', o_orderkey, '-x.parquet') AS key, o_orderkey % 1000 AS size FROM ORDERS)"""


def _made(cte: str, name: str):
    table, mark = ("orders", "ORDERS") if "ORDERS" in cte else ("events", "EVENTS")
    return lambda s, d: s.sql(f"WITH {cte.replace(mark, '{t}')} SELECT * FROM {name}", t=read(s, d, table))


_spans, _peers, _objects = _made(SPANS, "spans"), _made(PEERS, "peers"), _made(OBJECTS, "objects")


def log_span_join(s, d):
    spans = _spans(s, d)
    logs = spans.select(F.when(F.col("event_id") % 4 != 1, F.col("trace_id")).alias("trace_id"), "span_id", F.concat(F.lit("log "), "event_id").alias("body"))
    return logs.join(spans.select("trace_id", "span_id", "name", "duration_us", "ok"), ["trace_id", "span_id"])


def histogram(s, d):
    spans = _spans(s, d).withColumn("v", F.when(F.col("event_id") % 40 == 0, 0.0).when(F.col("event_id") % 41 == 0, -1.0).otherwise(F.col("value") + 0.003))
    out = observe.exp_histogram(spans, "name", "v")
    return out.select("name", "scale", "zero_count", "n", F.round("total", 2).alias("total"), "low", "high", "bucket", "bucket_count")


def eviction(s, d):
    entries = _spans(s, d).select(F.col("node").alias("cache"), F.col("event_id").alias("key"), (F.col("event_id") * 7919 % 10007).alias("used_at"), (F.col("duration_us") % 9000 + 1).alias("size"))
    return observe.eviction_plan(entries, budget=2_000_000)


def hour_compaction(s, d):
    """One past hour of spans, as one sorted file's worth of rows."""
    hour = _spans(s, d).where("start_unix_us >= 3600000000 AND start_unix_us < 7200000000")
    return hour.coalesce(1).sortWithinPartitions("start_unix_us").select("node", "span_id", "start_unix_us")


def sustained(s, d):
    return observe.sustained(_spans(s, d), member="node", at="event_id", suspect=F.col("value") > 3.0, for_at_least=15)


def sliding_median(s, d):
    out = observe.sliding_median(_spans(s, d), member="node", at="event_id", value="duration_us", span=30, least=5)
    worst = out.groupBy("node").agg(F.max("median").alias("worst"), F.min("median").alias("best"), F.count("median").alias("judged"))
    return worst


GAUGES = {"cells": "$.k", "absent": "$.nothing"}

QUERIES = {
    "log_span_join": log_span_join,
    "slowest_requests": lambda s, d: _spans(s, d).where("ok").orderBy(F.desc("duration_us"), "span_id").limit(20).select("trace_id", "span_id", "name", "duration_us"),
    "exp_histogram": histogram,
    "sliding_median": sliding_median,
    "sustained_suspicion": sustained,
    "pressure_latch": lambda s, d: observe.latch(_spans(s, d), member="node", order=["event_id"], value="value", ceiling=50.0).groupBy("node").agg(F.count_if("engaged").alias("engaged"), F.count("*").alias("n")),
    "trace_sample": lambda s, d: observe.sampled(_spans(s, d), 0.3, parent=F.col("parent_sampled")).select("trace_id", "span_id"),
    "rebalance_targets": lambda s, d: observe.rebalance(_peers(s, d), now=100_000, batch=40),
    "shared_heap": lambda s, d: observe.shared_heap(_peers(s, d).select(F.col("node").alias("isolate"), (F.col("owned_cells") * 1000).alias("bytes"), F.col("placement_weight").alias("cells"))),
    "state_gauges": lambda s, d: observe.gauges(read(s, d, "events").select(F.col("event_id").alias("member"), "props"), "props", GAUGES),
    "eviction_plan": eviction,
    "due_alarms": lambda s, d: observe.due(_spans(s, d).select(F.concat(F.lit("c"), "user_id").alias("cell"), F.date_format(F.timestamp_seconds(F.col("event_id") * 60), "yyyy-MM-dd'T'HH:mm").alias("minute")), now_minute="1970-01-03T12:00"),
    "retention_expired": lambda s, d: observe.expired_objects(_objects(s, d), today="2024-07-01", days=60),
    "object_list_delimiter": lambda s, d: observe.list_objects(_objects(s, d), prefix="spans/n1/", delimiter="/"),
    "object_list_page": lambda s, d: observe.list_objects(_objects(s, d), prefix="spans/", start_after="spans/n1/2024/05", limit=100),
    "hour_compaction": hour_compaction,
}


def _sql(cte: str, select: str) -> str:
    return f"WITH RECURSIVE {cte} {select}".replace("EVENTS", "events").replace("ORDERS", "orders")


SQL = {
    "log_span_join": _sql(SPANS, "SELECT l.trace_id, l.span_id, concat('log ', l.event_id) AS body, s.name, s.duration_us, s.ok FROM spans l JOIN spans s USING (trace_id, span_id) WHERE l.event_id % 4 <> 1"),
    "slowest_requests": _sql(SPANS, "SELECT trace_id, span_id, name, duration_us FROM spans WHERE ok ORDER BY duration_us DESC, span_id LIMIT 20"),
    "exp_histogram": _sql(SPANS, """
, v AS (SELECT name, CASE WHEN event_id % 40 = 0 THEN 0 WHEN event_id % 41 = 0 THEN -1 ELSE value + 0.003 END AS v FROM spans),
i AS (SELECT name, v, CASE WHEN v > 0 THEN CAST(ceil(log2(v) * 1048576) - 1 AS BIGINT) END AS i FROM v WHERE v >= 0),
g AS (SELECT name, min(i) AS first, max(i) AS last, count(*) AS n, round(sum(v), 2) AS total, min(v) AS low, max(v) AS high, count(*) FILTER (i IS NULL) AS zero_count FROM i GROUP BY name),
s AS (SELECT g.*, (SELECT min(k) FROM range(0, 32) t(k) WHERE floor(last / pow(2, k)) - floor(first / pow(2, k)) < 160) AS k FROM g)
SELECT name, CAST(20 - k AS INT) AS scale, zero_count, n, total, low, high, CAST(floor(i / pow(2, k)) AS BIGINT) AS bucket, count(*) AS bucket_count FROM i JOIN s USING (name) WHERE i IS NOT NULL GROUP BY ALL"""),
    "sliding_median": _sql(SPANS, """
, m AS (SELECT node, list_sort(list(duration_us) OVER (PARTITION BY node ORDER BY event_id RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)) AS held FROM spans),
x AS (SELECT node, CASE WHEN len(held) >= 5 THEN held[len(held) // 2 + 1] END AS median FROM m)
SELECT node, max(median) AS worst, min(median) AS best, count(median) AS judged FROM x GROUP BY node"""),
    "sustained_suspicion": _sql(SPANS, """
, m AS (SELECT node, event_id, value > 3.0 AS s, sum(CASE WHEN value > 3.0 THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY event_id) AS run FROM spans)
SELECT node, min(event_id) AS since, max(event_id) AS until, count(*) AS n FROM m WHERE s GROUP BY node, run HAVING max(event_id) - min(event_id) >= 15"""),
    "pressure_latch": _sql(SPANS, """
, m AS (SELECT node, last_value(CASE WHEN value >= 50 THEN TRUE WHEN value <= 40 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY node ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM spans)
SELECT node, count(*) FILTER (e) AS engaged, count(*) AS n FROM m GROUP BY node"""),
    "trace_sample": _sql(SPANS, "SELECT trace_id, span_id FROM spans WHERE coalesce(parent_sampled, substr(trace_id, 1, 16) < '4ccccccccccccc00')"),
    "rebalance_targets": _sql(PEERS, """
, live AS (SELECT *, greatest(placement_weight, 1) AS w FROM peers WHERE expires_ms > 100000),
t AS (SELECT *, CAST((sum(owned_cells) OVER () * w + sum(w) OVER () - 1) // sum(w) OVER () AS BIGINT) AS target, bool_and(paced AND NOT paused AND sampled_ms > 0 AND sampled_ms + 60000 >= 100000) OVER () AS ready FROM live),
r AS (SELECT *, CASE WHEN draining OR restoring > 0 THEN 0 ELSE greatest(target - (target * 2 + 99) // 100 - owned_cells, 0) END AS room FROM t WHERE ready),
p AS (SELECT *, CAST(sum(room) OVER () AS BIGINT) - room AS others, row_number() OVER (ORDER BY owned_cells / w DESC, node) AS rank FROM r)
SELECT node, owned_cells, target, CASE WHEN rank = 1 THEN greatest(least(owned_cells - target, others, 40), 0) ELSE 0 END AS surplus, room FROM p"""),
    "shared_heap": _sql(PEERS, "SELECT node AS isolate, owned_cells * 1000 // placement_weight AS bytes, CAST(unnest(range(1, placement_weight + 1)) AS INT) AS cell FROM peers"),
    "state_gauges": "SELECT event_id AS member, 'cells' AS gauge, CAST(props->>'$.k' AS DOUBLE) AS value FROM events WHERE props->>'$.k' IS NOT NULL",
    "eviction_plan": _sql(SPANS, """
, e AS (SELECT node AS cache, event_id AS key, duration_us % 9000 + 1 AS size, row_number() OVER (PARTITION BY node ORDER BY event_id * 7919 % 10007 DESC, event_id) AS r FROM spans),
w AS (SELECT cache, key, r, size <= 2000000 AS stays, CASE WHEN size <= 2000000 THEN size ELSE 0 END AS used FROM e WHERE r = 1
  UNION ALL SELECT e.cache, e.key, e.r, w.used + e.size <= 2000000, CASE WHEN w.used + e.size <= 2000000 THEN w.used + e.size ELSE w.used END FROM w JOIN e ON e.cache = w.cache AND e.r = w.r + 1)
SELECT cache, key, stays FROM w"""),
    "due_alarms": _sql(SPANS, ", a AS (SELECT concat('c', user_id) AS cell, strftime(make_timestamp(event_id * 60000000), '%Y-%m-%dT%H:%M') AS minute FROM spans) SELECT cell, min(minute) AS minute FROM a WHERE minute <= '1970-01-03T12:00' GROUP BY cell"),
    "retention_expired": _sql(OBJECTS, "SELECT * FROM objects WHERE key NOT LIKE '%/junk/%' AND make_date(CAST(split_part(key, '/', 3) AS INT), CAST(split_part(key, '/', 4) AS INT), CAST(split_part(key, '/', 5) AS INT)) < DATE '2024-05-02'"),
    "object_list_delimiter": _sql(OBJECTS, "SELECT concat('spans/n1/', split_part(key, '/', 3), '/') AS name, TRUE AS is_prefix, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objects WHERE starts_with(key, 'spans/n1/') GROUP BY ALL"),
    "object_list_page": _sql(OBJECTS, "SELECT key AS name, FALSE AS is_prefix, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM objects WHERE key > 'spans/n1/2024/05' GROUP BY ALL ORDER BY name LIMIT 100"),
    "hour_compaction": _sql(SPANS, "SELECT node, span_id, start_unix_us FROM spans WHERE start_unix_us >= 3600000000 AND start_unix_us < 7200000000"),
}
