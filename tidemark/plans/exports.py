"""Queries on packing, delivery and upkeep, over orders, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import exports as x
from tidemark.plans.changes import read


def _div(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


def _over(table: str, select: str):
    return lambda s, d: s.sql(select.replace("FROM T", "FROM {t}"), t=read(s, d, table))


NAMES = "SELECT DISTINCT CASE p_partkey % 9 WHEN 0 THEN 'sqlite_stat' WHEN 1 THEN '_cf_KV' WHEN 2 THEN '_CF_other' WHEN 3 THEN '_litestream_seq' WHEN 4 THEN '__queue_main' WHEN 5 THEN '__kv_meta' WHEN 6 THEN '__internal' WHEN 7 THEN 'users' ELSE concat('t', p_size) END AS name FROM T"
CLASSES = "SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN '__D1Database' WHEN 1 THEN '__Queue' WHEN 2 THEN '__Workflow.x' WHEN 3 THEN 'a.cron' WHEN 4 THEN '__Other' WHEN 5 THEN '__KvNamespace' ELSE concat('App', p_size) END AS name FROM T"
COMMITS = "SELECT concat('c', user_id % 20) AS cell, event_id AS commit, event_id % 397 <> 5 AS acked FROM T"
SESSIONS = f"SELECT {_div('event_id', 1000)} AS epoch, concat('s', event_id % 5) AS session, concat('c', user_id % 30) AS cell, CASE WHEN event_id % 4 = 0 THEN 'f' ELSE '' END AS facet, 30 + user_id % 20 AS expected, event_id % 313 = 0 AS loss FROM T"
CATALOG = "SELECT concat('t', n_nationkey) AS name, CAST(n_nationkey AS BIGINT) AS root, CAST(1 + n_regionkey AS BIGINT) AS generation FROM T WHERE n_nationkey % 5 <> 4"
CATALOG2 = "SELECT CASE WHEN n_nationkey % 6 = 1 THEN concat('r', n_nationkey) ELSE concat('t', n_nationkey) END AS name, CAST(CASE WHEN n_nationkey % 4 = 2 THEN n_nationkey + 100 ELSE n_nationkey END AS BIGINT) AS root, CAST(0 AS BIGINT) AS generation FROM T WHERE n_nationkey % 7 <> 3"
LOAD = "SELECT o_orderkey AS id, o_orderkey % 100 AS buffered, o_custkey % 80 AS waiting, 90 AS budget FROM T"
STORED = "SELECT o_orderkey AS id, concat('e', o_orderkey % 3) AS etag, o_orderkey * 10 AS modified_ms, o_orderpriority AS data FROM T"
MESSAGES = "SELECT concat('q', user_id % 6) AS queue, event_id * 7 AS ready_at FROM T"
MEDIANS = "SELECT concat('g', n_regionkey) AS grp, n_name AS member, CAST(10 + n_nationkey * n_nationkey % 37 AS DOUBLE) AS median FROM T"


def split_records(s, d):
    rows = read(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.concat_ws(",", F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.repeat(F.col("o_orderpriority"), (F.col("o_orderkey") % 4).cast("int"))))).alias("rows"))
    return x.split_records(rows, max_bytes=50).select("o_custkey", "fragment", "fragments", "kind", F.concat_ws(";", "rows").alias("rows"))


def sync_plan(s, d):
    parts = read(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.when(F.col("p_brand") != "Brand#1", F.col("p_type")))).alias("columns"))
    wanted = parts.select(F.col("p_brand").alias("name"), "columns")
    digest = F.md5(F.concat_ws(",", "columns"))
    known = wanted.select("name", F.when(F.length("name") % 2 == 0, digest).otherwise(F.lit("old")).alias("digest")).where("substring(name, -1) <> '3'")
    return x.sync_plan(wanted, known)


CAPTURES = "SELECT concat('c', user_id % 20) AS cell, event_id AS commit, event_id * 2 AS last_frame, event_id AS capture, event_id * 2 - 20 AS from_frame, CASE WHEN event_id % 3 = 0 THEN event_id * 2 - 30 ELSE event_id * 2 + 40 END AS to_frame FROM T"


def attribution(s, d):
    """Each event's commit among the captures that events make; one in three of them is empty, and one commit in seven lies between frames of others."""
    both = _over("events", CAPTURES)(s, d)
    commits = both.select("cell", "commit", F.when(F.col("commit") % 7 == 0, -F.col("last_frame")).otherwise(F.col("last_frame")).alias("last_frame"))
    return x.attribute_commits(commits, both.select("cell", "capture", "from_frame", "to_frame"), ["cell"])


QUERIES = {
    "split_records": split_records,
    "exported_tables": lambda s, d: _over("part", NAMES)(s, d).where(x.exported_table(F.col("name"))),
    "exported_classes": lambda s, d: _over("part", CLASSES)(s, d).where(x.exported_class(F.col("name"))),
    "delivered_positions": lambda s, d: x.delivered(_over("events", COMMITS)(s, d), ["cell"]),
    "recovered_sessions": lambda s, d: x.recovered_sessions(_over("events", SESSIONS)(s, d)),
    "schema_changes": lambda s, d: x.schema_changes(_over("nation", CATALOG)(s, d), _over("nation", CATALOG2)(s, d)),
    "sync_plan": sync_plan,
    "pending_migrations": lambda s, d: x.pending(read(s, d, "nation").select(F.col("n_name").alias("name")), read(s, d, "nation").where("n_nationkey < 9").select(F.col("n_name").alias("name"))),
    "fixed_sample": lambda s, d: x.fixed_sample(read(s, d, "customer"), "c_custkey", 50, 7).select("c_custkey"),
    "shed_over_budget": lambda s, d: x.shed(_over("orders", LOAD)(s, d)),
    "conditional_get": lambda s, d: x.conditional(_over("orders", STORED)(s, d), if_none_match="e1", unmodified_since=50_000).select("id", "ok"),
    "range_get": lambda s, d: _over("orders", STORED)(s, d).select("id", x.byte_range(F.col("data"), offset=2, length=3).cast("string").alias("part"), x.byte_range(F.col("data"), suffix=4, offset=1).cast("string").alias("tail")),
    "delivery_batches": lambda s, d: x.delivery_batches(_over("events", MESSAGES)(s, d), size=10, wait_ms=300),
    "slow_members": lambda s, d: x.slow_members(_over("nation", MEDIANS)(s, d).withColumnRenamed("grp", "group"), factor=1.5),
    "commit_attribution": attribution,
}


def _t(select: str, table: str) -> str:
    return select.replace("FROM T", f"FROM {table}")


SQL = {
    "split_records": """
WITH RECURSIVE r AS (SELECT o_custkey, concat(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), ',', repeat(o_orderpriority, o_orderkey % 4)) AS t FROM orders),
n AS (SELECT *, strlen(t) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY t) AS k FROM r),
w AS (SELECT o_custkey, t, k, size AS used, 1 AS fragment FROM n WHERE k = 1
  UNION ALL SELECT n.o_custkey, n.t, n.k, CASE WHEN w.used + n.size > 50 THEN n.size ELSE w.used + n.size END, w.fragment + CASE WHEN w.used + n.size > 50 THEN 1 ELSE 0 END FROM w JOIN n ON n.o_custkey = w.o_custkey AND n.k = w.k + 1),
big AS (SELECT o_custkey, max(size) > 50 AS big FROM n GROUP BY 1)
SELECT o_custkey, fragment, max(fragment) OVER (PARTITION BY o_custkey) AS fragments, 'rows' AS kind, string_agg(t, ';' ORDER BY k) AS rows FROM w JOIN big USING (o_custkey) WHERE NOT big GROUP BY o_custkey, fragment
UNION ALL SELECT o_custkey, 1, 1, 'bulk', '' FROM big WHERE big""",
    "exported_tables": f"SELECT name FROM ({_t(NAMES, 'part')}) WHERE name IN ('_cf_KV', '__queue_main', '__kv_meta', 'users') OR regexp_full_match(name, 't[0-9]+')",
    "exported_classes": f"SELECT name FROM ({_t(CLASSES, 'part')}) WHERE name IN ('__D1Database', '__KvNamespace') OR starts_with(name, 'App')",
    "delivered_positions": f"WITH c AS ({_t(COMMITS, 'events')}), b AS (SELECT cell, min(commit) FILTER (NOT acked) AS stop FROM c GROUP BY cell) SELECT cell, max(commit) FILTER (stop IS NULL OR commit < stop) AS delivered, bool_or(stop IS NOT NULL) AS frozen FROM c JOIN b USING (cell) GROUP BY cell",
    "recovered_sessions": f"SELECT session, max(expected) AS expected, count(DISTINCT concat(cell, '|', facet, '|', epoch)) AS held, bool_or(loss) AS loss, count(DISTINCT concat(cell, '|', facet, '|', epoch)) < max(expected) AS short FROM ({_t(SESSIONS, 'events')}) GROUP BY ALL",
    "schema_changes": f"""
WITH b AS ({_t(CATALOG, 'nation')}), a AS ({_t(CATALOG2, 'nation')})
SELECT a.name, CASE WHEN a.root = b.root THEN 'kept' ELSE 'opened' END AS change, CASE WHEN a.root = b.root THEN b.generation ELSE b.generation + 1 END AS generation, CAST(NULL AS VARCHAR) AS renamed_from FROM a JOIN b USING (name)
UNION ALL SELECT a.name, CASE WHEN o.name IS NULL THEN 'opened' ELSE 'renamed' END, 1, o.name FROM a LEFT JOIN (SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)) o USING (root) WHERE a.name NOT IN (SELECT name FROM b)
UNION ALL SELECT name, 'vanished', generation, NULL FROM b WHERE name NOT IN (SELECT name FROM a) AND root NOT IN (SELECT root FROM a WHERE name NOT IN (SELECT name FROM b))""",
    "sync_plan": "SELECT DISTINCT p_brand AS name, CASE WHEN p_brand = 'Brand#1' THEN 'skipped' WHEN right(p_brand, 1) = '3' THEN 'created' WHEN length(p_brand) % 2 = 0 THEN 'unchanged' ELSE 'replaced' END AS action FROM part",
    "pending_migrations": "SELECT n_name AS name FROM nation WHERE n_nationkey >= 9",
    "fixed_sample": "SELECT c_custkey FROM customer ORDER BY md5(concat('7|', c_custkey)), c_custkey LIMIT 50",
    "shed_over_budget": f"SELECT *, least(greatest(buffered + waiting - budget, 0), buffered) AS shed_buffered, least(greatest(buffered + waiting - budget, 0) - least(greatest(buffered + waiting - budget, 0), buffered), waiting) AS shed_waiting FROM ({_t(LOAD, 'orders')})",
    "conditional_get": "SELECT o_orderkey AS id, o_orderkey % 3 <> 1 AND o_orderkey * 10 <= 50000 AS ok FROM orders",
    "range_get": "SELECT o_orderkey AS id, substr(o_orderpriority, 3, 3) AS part, right(o_orderpriority, 4) AS tail FROM orders",
    "delivery_batches": f"""
WITH RECURSIVE m AS (SELECT queue, ready_at, row_number() OVER (PARTITION BY queue ORDER BY ready_at) AS k FROM ({_t(MESSAGES, 'events')})),
w AS (SELECT queue, k, 0 AS batch, 1 AS n, ready_at AS first_at FROM m WHERE k = 1
  UNION ALL SELECT m.queue, m.k, w.batch + CASE WHEN w.n >= 10 OR m.ready_at >= w.first_at + 300 THEN 1 ELSE 0 END, CASE WHEN w.n >= 10 OR m.ready_at >= w.first_at + 300 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= 10 OR m.ready_at >= w.first_at + 300 THEN m.ready_at ELSE w.first_at END FROM w JOIN m ON m.queue = w.queue AND m.k = w.k + 1)
SELECT queue, batch, CAST(max(n) AS BIGINT) AS n, first_at FROM w GROUP BY queue, batch, first_at""",
    "slow_members": f"WITH m AS ({_t(MEDIANS, 'nation')}) SELECT grp AS \"group\", member, median FROM m a WHERE median > 1.5 * (SELECT min(median) FROM m b WHERE b.grp = a.grp AND b.member <> a.member)",
    "commit_attribution": f"""
WITH e AS ({_t(CAPTURES, "events")})
SELECT c.cell, c.commit, min(p.capture) AS capture FROM (SELECT cell, commit, CASE WHEN commit % 7 = 0 THEN -last_frame ELSE last_frame END AS f FROM e) c LEFT JOIN e p ON p.cell = c.cell AND c.f BETWEEN p.from_frame AND p.to_frame GROUP BY ALL""",
}
