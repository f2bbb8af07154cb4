"""Key-value, queue and audit queries over tables made of orders, events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, kv, queue
from tidemark.plans.changes import read

NOW = 900_000_000_000

#: Orders as keys: expiry by date, sizes by price.
KV = f"""kv AS (SELECT concat('k/', o_orderpriority, '/', o_orderkey) AS name, o_orderstatus AS value, CAST(floor(o_totalprice / 100) AS BIGINT) AS size,
  CASE WHEN o_orderkey % 4 <> 0 THEN {NOW} + (o_orderkey % 1000 - 400) * 86400000 END AS expires_at FROM ORDERS)"""

#: Orders as messages: leases, delays and hand-overs by divisibility.
QUEUE = f"""q AS (SELECT o_orderkey AS seq, concat('m', o_orderkey) AS id, CAST(floor(o_totalprice / 10) AS BIGINT) AS size, {NOW} - o_orderkey * 1000 AS enqueued_at,
  {NOW} + (o_orderkey % 13 - 9) * 1000 AS visible_at, o_orderkey % 6 AS attempts, CASE WHEN o_orderkey % 5 = 0 THEN concat('l', o_orderkey % 50) END AS lease_id,
  CASE WHEN o_orderkey % 5 = 0 THEN {NOW} + (o_orderkey % 3 - 1) * 1000 END AS leased_until, CASE WHEN o_orderkey % 17 = 0 THEN concat('dlq', o_orderkey % 3) END AS dlq_target,
  o_orderkey % 20 = 0 AS purge_on_settle, CASE WHEN o_orderkey % 19 = 0 THEN 'main' END AS dead_letter_source FROM ORDERS)"""

#: Lines as stored transaction ranges of two epochs; some begin at 0 or end before they begin.
FILES = f"""files AS (SELECT concat('Cell:', l_suppkey) AS scope, 1 + l_partkey % 2 AS epoch, CAST(CASE WHEN l_orderkey % 50 = 0 THEN 9 ELSE l_linenumber % 4 END AS INT) AS level,
  CASE WHEN l_orderkey % 50 = 0 THEN 1 WHEN l_orderkey % 41 = 0 THEN 0 WHEN l_orderkey % 43 = 0 THEN l_orderkey % 97 + 20 ELSE l_orderkey % 97 + 1 END AS lo, l_orderkey % 97 + 1 + l_linenumber AS hi, 1000 + l_orderkey AS modified_ms FROM LINES)"""


def _kv(spark, d):
    return spark.sql(f"WITH {KV.replace('ORDERS', '{o}')} SELECT * FROM kv", o=read(spark, d, "orders"))


def _q(spark, d):
    return spark.sql(f"WITH {QUEUE.replace('ORDERS', '{o}')} SELECT * FROM q", o=read(spark, d, "orders"))


def _files(spark, d):
    return spark.sql(f"WITH {FILES.replace('LINES', '{l}')} SELECT * FROM files", l=read(spark, d, "lineitem"))


def _hex(c: str):
    return F.lpad(F.lower(F.hex(F.col(c))), 16, "0")


def inventory(spark, d):
    key = F.concat(F.lit("cells/"), "scope", F.lit("/ltx/e"), "epoch", F.lit("/ltx/"), "level", F.lit("/"), _hex("lo"), F.lit("-"), _hex("hi"), F.lit(".ltx"))
    return audit.inventory(_files(spark, d).select(key.alias("key"), "modified_ms").unionByName(spark.createDataFrame([("cells/x/other", 1)], "key string, modified_ms bigint")))


def _targets(spark, d):
    return _files(spark, d).groupBy("scope", "epoch").agg(F.max("hi").alias("top")).select("scope", "epoch", (F.col("top") - F.col("epoch") * 20).alias("target"))


def _heads(spark, d):
    return _kv(spark, d).select(F.col("name").alias("cell"), (F.col("size") % 50).alias("head"), (F.lit(NOW) - F.col("size")).alias("stored_ms"), F.when(F.col("size") % 11 == 0, F.lit(NOW) - F.col("size")).alias("deleted_ms")).where("head % 7 <> 3")


def _streams(spark, d):
    return _kv(spark, d).where("size % 5 <> 0").select(F.col("name").alias("cell"), (F.col("size") % 40).alias("certified"), (F.col("size") % 33 == 0).alias("deleted"), (F.lit(NOW) - F.col("size")).alias("last_ms"))


def reconcile(spark, d):
    return audit.reconcile(_heads(spark, d), _streams(spark, d), now_ms=NOW, settle_ms=1000)


def verify_drift(spark, d):
    base = _kv(spark, d).select("name", "value", "size")
    actual = base.where("size % 10 <> 0").withColumn("size", F.when(F.col("size") % 9 == 0, F.col("size") + 1).otherwise(F.col("size"))).unionByName(base.where("size % 100 = 1").withColumn("name", F.concat(F.lit("x"), "name")))
    return audit.compare(base, actual, ["name"])


def snapshot_diff(spark, d):
    base = _kv(spark, d).select("name", "value", "size")
    after = base.where("size % 8 <> 0").withColumn("value", F.when(F.col("size") % 3 == 0, F.lit("Z")).otherwise(F.col("value")))
    return audit.net_changes(base, after, ["name"])


def repair_jobs(spark, d):
    gaps = _kv(spark, d).select(F.concat(F.lit("c"), F.col("size") % 100).alias("cell"), F.when(F.col("size") % 37 != 0, F.col("size")).alias("bound"), F.when(F.col("size") % 2 == 0, "gap").otherwise("loss").alias("reason"))
    return audit.repair_jobs(gaps)


def page_compaction(spark, d):
    pages = read(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 10).alias("scope"), (F.col("l_partkey") % 100).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("input"), F.concat(F.lit("p"), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("data"))
    return audit.compact_pages(pages, 80)


QUERIES = {
    "kv_list_page": lambda s, d: kv.list_page(_kv(s, d), now=NOW, prefix="k/1", after="k/1-URGENT/2", limit=50),
    "kv_do_list": lambda s, d: kv.do_list(_kv(s, d), start="k/2", end="k/4", reverse=True, limit=40).select("name", "size"),
    "kv_metrics": lambda s, d: kv.metrics(_kv(s, d), now=NOW),
    "kv_sweep": lambda s, d: kv.sweep(_kv(s, d), now=NOW, limit=100).select("name", "expires_at"),
    "queue_candidates": lambda s, d: queue.candidates(_q(s, d), now=NOW, limit=100).select("seq", "visible_at"),
    "queue_batch": lambda s, d: queue.batch(_q(s, d), now=NOW, limit=10, wait_ms=500).select("seq"),
    "queue_expire": lambda s, d: queue.expire_leases(_q(s, d), now=NOW, max_retries=3, delay_ms=7000, dlq="dead"),
    "queue_metrics": lambda s, d: queue.metrics(_q(s, d), now=NOW),
    "queue_peek_state": lambda s, d: queue.peek(_q(s, d), now=NOW, limit=200),
    "queue_purge_plan": lambda s, d: queue.purge_plan(_q(s, d), now=NOW),
    "queue_retention": lambda s, d: queue.expired(_q(s, d), now=NOW, retention_ms=5_000_000).select("seq"),
    "queue_dead_letters": lambda s, d: queue.dead_letters(_q(s, d), _q(s, d).where("seq % 34 = 0")),
    "queue_redrive": lambda s, d: queue.redrive(_q(s, d), now=NOW, limit=25),
    "queue_backoff": lambda s, d: _q(s, d).select("seq", queue.alarm_delay(F.col("attempts") + 1).alias("alarm_ms"), queue.workflow_delay(F.element_at(F.array(*map(F.lit, ("constant", "linear", "exponential"))), (F.col("seq") % 3 + 1).cast("int")), F.lit(500), F.col("attempts") + 1).alias("workflow_ms")),
    "object_inventory": inventory,
    "restorable_cuts": lambda s, d: audit.restorable_cuts(_files(s, d)),
    "restore_plan": lambda s, d: audit.restore_plan(_files(s, d), _targets(s, d)),
    "epoch_spans": lambda s, d: audit.epoch_spans(_files(s, d).groupBy("scope", "epoch").agg((F.min("lo") + F.col("epoch") * 50).alias("lo"), (F.max("hi") + F.col("epoch") * 50).alias("hi"))),
    "oldest_holding": lambda s, d: audit.oldest_holding(_files(s, d), _files(s, d).select("scope", "epoch", F.col("hi").alias("txid")).distinct()),
    "choose_cut": lambda s, d: audit.choose_cut(_files(s, d).select("scope", "epoch", F.col("hi").alias("txid")).distinct(), _targets(s, d).select("scope", "epoch", F.col("target").alias("txid"))),
    "reconcile_findings": reconcile,
    "reconcile_records": lambda s, d: audit.as_records(reconcile(s, d)),
    "verify_drift": verify_drift,
    "snapshot_diff": snapshot_diff,
    "repair_jobs": repair_jobs,
    "page_compaction": page_compaction,
}

_LEASED = f"(lease_id IS NOT NULL AND leased_until > {NOW})"
_STATE = f"CASE WHEN dlq_target IS NOT NULL THEN 'moving' WHEN {_LEASED} THEN 'leased' WHEN lease_id IS NOT NULL THEN 'expired' WHEN visible_at > {NOW} THEN 'delayed' ELSE 'ready' END"


def _sql(cte: str, select: str) -> str:
    return f"WITH RECURSIVE {cte} {select}".replace("ORDERS", "orders").replace("LINES", "lineitem")


_READY = f"lease_id IS NULL AND dlq_target IS NULL AND visible_at <= {NOW}"
_HEADS = f"heads AS (SELECT name AS cell, size % 50 AS head, {NOW} - size AS stored_ms, CASE WHEN size % 11 = 0 THEN {NOW} - size END AS deleted_ms FROM kv WHERE size % 50 % 7 <> 3), streams AS (SELECT name AS cell, size % 40 AS certified, size % 33 = 0 AS deleted, {NOW} - size AS last_ms FROM kv WHERE size % 5 <> 0)"
_FOUND = f"""found AS (SELECT * FROM (SELECT coalesce(h.cell, s.cell) AS cell, head, certified,
  CASE WHEN h.cell IS NULL THEN CASE WHEN NOT deleted AND last_ms + 1000 <= {NOW} THEN 'unknown_stream' END
    WHEN deleted_ms IS NOT NULL THEN CASE WHEN NOT coalesce(deleted, FALSE) AND deleted_ms + 1000 <= {NOW} THEN 'missing_deleted' END
    WHEN stored_ms + 1000 <= {NOW} AND head > coalesce(certified, 0) THEN 'gap' END AS finding
  FROM heads h FULL JOIN streams s ON h.cell = s.cell) WHERE finding IS NOT NULL)"""

SQL = {
    "kv_list_page": _sql(KV, f"""
, page AS (SELECT name, size, expires_at, row_number() OVER (ORDER BY name) AS r FROM kv WHERE starts_with(name, 'k/1') AND name > 'k/1-URGENT/2' AND (expires_at IS NULL OR expires_at > {NOW}))
SELECT name, size, expires_at, (SELECT count(*) FROM page) <= 50 AS list_complete FROM page WHERE r <= 50"""),
    "kv_do_list": _sql(KV, "SELECT name, size FROM kv WHERE name >= 'k/2' AND name < 'k/4' ORDER BY name DESC LIMIT 40"),
    "kv_metrics": _sql(KV, f"SELECT count(*) FILTER (expires_at IS NULL OR expires_at > {NOW}) AS keys, CAST(coalesce(sum(size) FILTER (expires_at IS NULL OR expires_at > {NOW}), 0) AS BIGINT) AS bytes, min(expires_at) AS next_expiry FROM kv"),
    "kv_sweep": _sql(KV, f"SELECT name, expires_at FROM kv WHERE expires_at <= {NOW} ORDER BY expires_at, name LIMIT 100"),
    "queue_candidates": _sql(QUEUE, f"SELECT seq, visible_at FROM q WHERE {_READY} ORDER BY visible_at, seq LIMIT 100"),
    "queue_batch": _sql(QUEUE, f"SELECT seq FROM q WHERE {_READY} ORDER BY visible_at, seq LIMIT 10"),
    "queue_expire": _sql(QUEUE, f"SELECT seq, id, attempts, CASE WHEN purge_on_settle THEN 'purge' WHEN attempts > 3 THEN 'dead_letter' ELSE 'retry' END AS fate, CASE WHEN NOT purge_on_settle AND attempts <= 3 THEN {NOW + 7000} END AS visible_at FROM q WHERE lease_id IS NOT NULL AND leased_until <= {NOW} AND dlq_target IS NULL"),
    "queue_metrics": _sql(QUEUE, f"SELECT count(*) AS backlog, CAST(sum(size) AS BIGINT) AS bytes, min(enqueued_at) AS oldest, count(*) FILTER ({_LEASED}) AS leased, count(dlq_target) AS moving, count(*) FILTER ({_STATE} = 'delayed') AS delayed, count(DISTINCT lease_id) FILTER ({_LEASED}) AS active_leases FROM q"),
    "queue_peek_state": _sql(QUEUE, f"SELECT seq, id, attempts, {_STATE} AS state FROM q ORDER BY seq LIMIT 200"),
    "queue_purge_plan": _sql(QUEUE, f"SELECT seq, id, CASE WHEN {_LEASED} THEN 'on_settle' ELSE 'now' END AS \"when\" FROM q WHERE dlq_target IS NULL"),
    "queue_retention": _sql(QUEUE, f"SELECT seq FROM q WHERE enqueued_at + 5000000 <= {NOW} AND NOT coalesce({_LEASED}, FALSE)"),
    "queue_dead_letters": _sql(QUEUE, "SELECT dlq_target, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(seq) AS first_seq FROM q WHERE dlq_target IS NOT NULL AND seq % 34 <> 0 GROUP BY ALL"),
    "queue_redrive": _sql(QUEUE, f"SELECT seq, id, dead_letter_source, 0 AS attempts, {NOW} AS visible_at FROM q WHERE dead_letter_source IS NOT NULL AND lease_id IS NULL ORDER BY seq LIMIT 25"),
    "queue_backoff": _sql(QUEUE, "SELECT seq, CASE WHEN attempts + 1 < 6 THEN CAST(2000 * pow(2, least(attempts + 1, 6)) AS BIGINT) END AS alarm_ms, CAST(CASE seq % 3 WHEN 0 THEN 500 WHEN 1 THEN 500 * (attempts + 1) ELSE 500 * pow(2, attempts) END AS BIGINT) AS workflow_ms FROM q"),
    "object_inventory": _sql(FILES, "SELECT * FROM files"),
    "restorable_cuts": _sql(f"""{FILES}, reach AS (SELECT DISTINCT scope, epoch, CAST(0 AS BIGINT) AS txid FROM files UNION SELECT f.scope, f.epoch, f.hi FROM reach r JOIN files f ON f.scope = r.scope AND f.epoch = r.epoch AND r.txid >= f.lo - 1 AND r.txid < f.hi AND f.lo > 0 AND f.hi >= f.lo)""", "SELECT * FROM reach WHERE txid > 0"),
    "restore_plan": _sql(f"""{FILES},
target AS (SELECT scope, epoch, max(hi) - epoch * 20 AS target FROM files GROUP BY scope, epoch),
snap AS (SELECT t.scope, t.epoch, t.target, max(CASE WHEN f.hi IS NOT NULL THEN row(f.hi, f.lo) END) AS s FROM target t LEFT JOIN files f ON f.scope = t.scope AND f.epoch = t.epoch AND level = 9 AND hi <= target GROUP BY ALL),
step AS (SELECT scope, epoch, target, CASE WHEN s IS NULL THEN -1 ELSE 0 END AS step, CAST(s[2] AS BIGINT) AS lo, CAST(coalesce(s[1], 0) AS BIGINT) AS hi FROM snap
  UNION ALL SELECT scope, epoch, target, step + 1, w[2], w[1] FROM (
    SELECT p.scope, p.epoch, p.target, p.step, max(row(f.hi, -f.lo)) AS m, row(max(row(f.hi, -f.lo))[1], -max(row(f.hi, -f.lo))[2]) AS w
    FROM step p JOIN files f ON f.scope = p.scope AND f.epoch = p.epoch AND f.level <> 9 AND f.lo <= p.hi + 1 AND f.hi > p.hi AND f.hi <= p.target GROUP BY p.scope, p.epoch, p.target, p.step)),
done AS (SELECT scope, epoch FROM step WHERE hi = target)""", "SELECT scope, epoch, CAST(step AS INT) AS step, lo, hi FROM step JOIN done USING (scope, epoch) WHERE step >= 0"),
    "epoch_spans": _sql(FILES, ", h AS (SELECT scope, epoch, min(lo) + epoch * 50 AS lo, max(hi) + epoch * 50 AS hi FROM files GROUP BY scope, epoch) SELECT *, coalesce(lead(lo) OVER (PARTITION BY scope ORDER BY epoch) - 1, hi) AS served_to FROM h"),
    "oldest_holding": _sql(FILES, "SELECT w.scope, w.epoch, w.txid, min(modified_ms) AS stored_ms FROM (SELECT DISTINCT scope, epoch, hi AS txid FROM files) w JOIN files f ON f.scope = w.scope AND f.epoch = w.epoch AND txid BETWEEN lo AND hi GROUP BY ALL"),
    "choose_cut": _sql(FILES, ", t AS (SELECT scope, epoch, max(hi) - epoch * 20 AS txid FROM files GROUP BY scope, epoch) SELECT t.*, (SELECT min(hi) FROM files f WHERE f.scope = t.scope AND f.epoch = t.epoch AND hi >= t.txid) AS cut FROM t"),
    "reconcile_findings": _sql(f"{KV}, {_HEADS}, {_FOUND}", "SELECT cell, finding, head, certified FROM found"),
    "reconcile_records": _sql(f"{KV}, {_HEADS}, {_FOUND}", "SELECT cell, CASE finding WHEN 'missing_deleted' THEN 'deleted' ELSE 'gap' END AS kind, greatest(coalesce(head, 0), coalesce(certified, 0)) AS txid, 'repair' AS origin, 'reconciler' AS node FROM found WHERE finding <> 'unknown_stream'"),
    "verify_drift": _sql(KV, "SELECT name, CASE WHEN size % 10 = 0 THEN 'missing' ELSE 'changed' END AS drift, CASE WHEN size % 10 <> 0 THEN 'size' END AS columns FROM kv WHERE size % 10 = 0 OR size % 9 = 0 UNION ALL SELECT concat('x', name), 'extra', NULL FROM kv WHERE size % 100 = 1"),
    "snapshot_diff": _sql(KV, "SELECT name, CASE WHEN size % 8 = 0 THEN 'D' ELSE 'U' END AS op, CASE WHEN size % 8 <> 0 THEN 'value' END AS columns FROM kv WHERE size % 8 = 0 OR size % 3 = 0"),
    "repair_jobs": _sql(KV, "SELECT concat('c', size % 100) AS cell, CASE WHEN NOT bool_or(size % 37 = 0) THEN max(size) END AS target, string_agg(DISTINCT CASE WHEN size % 2 = 0 THEN 'gap' ELSE 'loss' END, ',' ORDER BY CASE WHEN size % 2 = 0 THEN 'gap' ELSE 'loss' END) AS reasons FROM kv GROUP BY 1"),
    "page_compaction": "SELECT concat('s', l_suppkey % 10) AS scope, l_partkey % 100 AS page, concat('p', max(l_orderkey * 10 + l_linenumber)) AS data, max(l_orderkey * 10 + l_linenumber) AS input FROM lineitem GROUP BY 1, 2 HAVING page <= 80",
}
