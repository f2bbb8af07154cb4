"""Producing, landing and upkeep queries over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, cdc, producers, upkeep
from tidemark.operators.walks import dealt, tasks_for
from tidemark.plans import changes
from tidemark.plans.changes import RECORDS, TOMBSTONES, read
from tidemark.storage import store

_STREAM = ", ".join(cdc.STREAM)

#: Events as the row changes of transactions: five events a transaction, two tables.
CHANGES = """ch AS (SELECT 'app' AS script, 'User' AS class, concat('User:', user_id % 20) AS cell, '' AS facet, CAST(1 AS BIGINT) AS incarnation,
  CAST(floor(event_id / 2500) AS BIGINT) + 1 AS epoch, CAST(floor(event_id % 2500 / 5) AS BIGINT) + 1 AS txid, event_id AS seq,
  CASE WHEN event_id % 3 = 0 THEN 'profile' ELSE 'orders' END AS table_name, CAST(1 AS BIGINT) AS generation,
  concat('["', CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END, '",[', user_id, '],[', user_id, ',"', event_type, '"]]') AS change FROM EVENTS)"""
MESSAGES = "msg AS (SELECT user_id % 8 AS partition, event_id AS place, 40 + event_id % 50 AS bytes, event_id % 97 <> 1 AS sound, event_id % 97 = 1 AND event_id % 4 < 3 AS skip FROM EVENTS)"
FLUSHES = "buf AS (SELECT concat('n', user_id % 4) AS node, event_id * 100 AS at_ms, 100 + event_id % 300 AS bytes FROM EVENTS)"
CHAIN = """files AS (SELECT concat('Cell:', l_suppkey) AS scope, CAST(1 + l_linenumber % 5 AS BIGINT) AS epoch, (l_linenumber % 5) * 10 + 1 + CASE WHEN l_orderkey % 11 = 0 THEN 2 ELSE 0 END AS lo,
  (l_linenumber % 5) * 10 + 10 - CASE WHEN l_partkey % 9 < 6 THEN 1 WHEN l_partkey % 9 = 6 THEN -4 ELSE 0 END AS hi FROM LINES WHERE l_linenumber % 5 <> l_suppkey % 5 OR l_suppkey % 3 = 0)"""


def _made(s, d, cte: str, name: str):
    mark, table = ("LINES", "lineitem") if "LINES" in cte else ("EVENTS", "events")
    return s.sql(f"WITH {cte.replace(mark, '{t}')} SELECT * FROM {name}", t=read(s, d, table))


def _records(s, d):
    made = _made(s, d, CHANGES, "ch").withColumns({"columns": F.array(F.lit("id"), F.lit("kind")), "key_columns": F.array(F.lit("id"))})
    return producers.commit_records(made, max_bytes=120)


def commit_records(s, d):
    """What commits become, put together again from their fragments."""
    rows = _records(s, d)
    parts = rows.groupBy("cell", "epoch", "txid", "commit", "table_name").agg(F.sum(F.size("rows")).alias("n_rows"), F.array_sort(F.collect_list(F.struct("fragment", "rows"))).alias("p"))
    return parts.select("cell", "epoch", "txid", "commit", "table_name", "n_rows", F.array_join(F.flatten(F.transform("p", lambda x: x["rows"])), ",").alias("rows"))


def commit_fragments(s, d):
    return _records(s, d).groupBy("fragments", "kind").agg(F.count_distinct("cell", "epoch", "txid", "table_name").alias("records"), F.max(F.octet_length(F.array_join("rows", ""))).cast("bigint").alias("largest"))


def _acknowledged(s, d):
    return _records(s, d).where("fragment = 1").select(*cdc.STREAM, *cdc.POSITION)


def watermark_emission(s, d):
    return producers.watermarks(_acknowledged(s, d), every=40).drop("script", "class", "facet", "incarnation")


def produced_certified(s, d):
    """What was produced certifies itself, up to its last mark; where the third commit of an epoch was lost, up to no mark."""
    sent = store(_acknowledged(s, d), "acknowledged")
    tasks = tasks_for(sent)
    sent = dealt(sent, tasks, *cdc.STREAM, "epoch")
    lost = sent.where("NOT (commit = 3 AND epoch = 1)")
    return cdc.certified_heads(lost, producers.watermarks(sent, every=40), tasks=tasks).select("cell", "epoch", "txid", "commit")


def row_dedup(s, d):
    rows = cdc.row_changes(changes.records(s, d))
    return producers.first_rows(rows).groupBy("cell", "kind", "op").agg(F.count("*").alias("n"))


def _landing(s, d):
    return changes.records(s, d).select(*cdc.STREAM, "commit", (F.timestamp_seconds(F.lit(1704067200) + F.col("commit") * 60)).alias("landed_at"))


def erased_rows(s, d):
    gone = upkeep.erased(changes.records(s, d), s.sql(f"WITH {TOMBSTONES} SELECT * FROM tomb"))
    return gone.groupBy("cell", "facet", "incarnation").agg(F.count("*").alias("n"))


def tombstones_added(s, d):
    """Tombstones asked for twice, and beside active and cleared ones."""
    now = s.sql(f"WITH {TOMBSTONES} SELECT *, CAST('2024-01-01' AS STRING) AS erased_at, 'old' AS reason FROM tomb")
    asked = changes.records(s, d).where("kind = 'deleted' OR cell = 'User:4'").select("script", "class", "cell", "facet", F.when(F.col("commit") % 2 == 0, F.col("incarnation")).alias("incarnation"), F.lit("2024-02-01").alias("erased_at"), F.lit("asked").alias("reason"))
    return upkeep.with_tombstones(now, asked).select("cell", "facet", "incarnation", "erased_at", "reason", "cleared_at")


def incremental_current(s, d):
    """The newest row per key, kept over four batches cut without regard to order."""
    lines = read(s, d, "lineitem")
    keys, order = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    current = lines.limit(0)
    for k in range(4):
        current = upkeep.upkeep(current, lines.where(F.pmod(F.xxhash64(*order), F.lit(4)) == k), keys, order)
    return current.where("l_returnflag <> 'R'").select(*keys, *order)


#: Orders as the objects and streams of one cell per customer, of which some are facets, erased, of other classes, or have no stream.
SCOPES = """ord AS (SELECT o_custkey AS c, o_orderkey AS k, concat(CASE WHEN o_custkey % 29 = 0 THEN '__Queue' ELSE 'Cell' END, ':', o_custkey, CASE WHEN o_custkey % 7 = 3 THEN '/facets/f' ELSE '' END) AS scope,
  CASE WHEN o_custkey % 29 = 0 THEN '__Queue' ELSE 'Cell' END AS class, o_custkey % 7 = 3 AS facet FROM ORDERS),
files AS (SELECT scope, CAST(1 + k % 5 AS BIGINT) AS epoch, 1 + k % 40 AS lo, 1 + k % 40 + k % 9 AS hi, 1000 + k % 5000 AS modified_ms FROM ord WHERE c % 19 <> 2 AND (k % 5 <> 2 OR c % 3 = 0)),
heads AS (SELECT o.scope, class, facet, f.epoch, f.txid, f.modified_ms, f.first_ms FROM (SELECT DISTINCT scope, class, facet FROM ord) o
  JOIN (SELECT scope, max(epoch) AS epoch, max(epoch * 1000 + hi) % 1000 AS txid, max(modified_ms) AS modified_ms, min(modified_ms) AS first_ms FROM files GROUP BY scope) f ON f.scope = o.scope),
broken AS (SELECT DISTINCT concat('Broken:', c) AS scope, CASE WHEN c % 2 = 0 THEN 'Broken' ELSE 'Hidden' END AS class, c * 5 AS first_ms FROM ord WHERE c % 31 = 0),
streams AS (SELECT DISTINCT scope, CASE WHEN facet THEN concat('Cell:', c + 1) END AS root, class, CAST(1 + i AS BIGINT) AS incarnation, (c * 37 + i * 11) % 6000 AS last_ms, c % 17 = 0 AS deleted,
  CASE WHEN c % 6 = 0 THEN 2 END AS snapshot_epoch, CASE WHEN c % 6 = 0 THEN 30 END AS snapshot_txid FROM ord JOIN (SELECT 0 AS i UNION ALL SELECT 1) x ON i = 0 OR c % 8 = 0 WHERE c % 13 <> 5),
certified AS (SELECT s.scope, s.incarnation, CAST(e AS BIGINT) AS epoch, (s.last_ms * 7 + e * 11) % 60 AS txid FROM streams s JOIN (SELECT 1 AS e UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) x ON (s.last_ms + e) % 4 <> 0),
nodes AS (SELECT scope, incarnation, epoch, concat('n', (txid + epoch) % 5) AS node FROM certified),
losses AS (SELECT concat('n', i) AS node, 900 * i AS modified_ms FROM (SELECT 1 AS i UNION ALL SELECT 3) x),
erased AS (SELECT DISTINCT scope FROM ord WHERE c % 23 = 0),
classes AS (SELECT 'Cell' AS class UNION ALL SELECT 'Broken')"""
SETTLED = 4000


def scope_audit(s, d):
    made = lambda name: s.sql(f"WITH {SCOPES.replace('ORDERS', '{t}')} SELECT * FROM {name}", t=read(s, d, "orders"))
    return audit.audit_scopes(*map(made, ("heads", "files", "broken", "streams", "certified", "nodes", "losses", "erased", "classes")), now_ms=5000, settle_ms=5000 - SETTLED)


QUERIES = {
    "scope_audit": scope_audit,
    "commit_records": commit_records,
    "commit_fragments": commit_fragments,
    "watermark_emission": watermark_emission,
    "produced_certified": produced_certified,
    "row_dedup": row_dedup,
    "topic_batches": lambda s, d: producers.topic_batches(_made(s, d, MESSAGES, "msg"), records=20, size=1500),
    "sink_flushes": lambda s, d: producers.flushes(_made(s, d, FLUSHES, "buf"), flush_bytes=2500, interval_ms=4000),
    "erased_rows": erased_rows,
    "tombstones_added": tombstones_added,
    "landing_expired": lambda s, d: upkeep.expired(_landing(s, d), now="2024-01-12", days=7).groupBy("cell").agg(F.count("*").alias("n"), F.max("commit").alias("newest")),
    "incremental_current": incremental_current,
    "epoch_chain": lambda s, d: audit.epoch_chain(_made(s, d, CHAIN, "files")),
}


def _sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}".replace("EVENTS", "events").replace("LINES", "lineitem").replace("ORDERS", "orders")


_COMMITS = f"{CHANGES}, com AS (SELECT cell, epoch, txid, row_number() OVER (PARTITION BY cell, epoch ORDER BY txid) AS commit, n FROM (SELECT cell, epoch, txid, count(DISTINCT table_name) AS n FROM ch GROUP BY ALL))"
_MARKED = f"{_COMMITS}, blk AS (SELECT cell, epoch, (commit - 1) // 40 AS b, max(txid) AS txid, max(commit) AS commit, count(*) AS commits, CAST(sum(n) AS BIGINT) AS records FROM com GROUP BY ALL)"
_COVERED = "(snapshot_epoch IS NOT NULL AND row(snapshot_epoch, snapshot_txid) >= row({e}, {t}))"
SQL = {
    "scope_audit": _sql(f"""{SCOPES},
tag AS (SELECT scope, CASE WHEN class NOT IN (SELECT class FROM classes) THEN 'not_exported' WHEN scope IN (SELECT scope FROM erased) THEN 'tombstoned' END AS why FROM (SELECT scope, class FROM heads UNION SELECT scope, class FROM broken)),
live AS (SELECT * FROM heads WHERE scope IN (SELECT scope FROM tag WHERE why IS NULL)),
pick AS (SELECT l.scope, l.facet, l.epoch AS head_epoch, l.modified_ms, s.incarnation, s.deleted, s.snapshot_epoch, s.snapshot_txid FROM live l JOIN streams s ON s.scope = l.scope AND (l.facet OR s.incarnation <= l.epoch)
  QUALIFY row_number() OVER (PARTITION BY l.scope ORDER BY CASE WHEN l.facet THEN 0 ELSE s.incarnation END DESC, last_ms DESC, s.incarnation DESC) = 1),
chk AS (SELECT * FROM pick WHERE NOT deleted),
span AS (SELECT scope, epoch, min(lo) AS lo, max(hi) AS hi FROM files GROUP BY ALL),
nxt AS (SELECT a.scope, e AS epoch, min(row(a.epoch, a.lo)) AS n FROM span a JOIN (SELECT unnest(range(1, 6)) AS e) x ON a.epoch > e GROUP BY ALL),
sp AS (SELECT c.*, s.epoch, s.lo, s.hi, f.txid AS sure, s.epoch = (SELECT max(epoch) FROM span z WHERE z.scope = s.scope) AS newest FROM chk c JOIN span s ON s.scope = c.scope AND (c.facet OR s.epoch >= c.incarnation)
  LEFT JOIN certified f ON f.scope = c.scope AND f.incarnation = c.incarnation AND f.epoch = s.epoch),
moved AS (SELECT n.scope, n.epoch, min(f.modified_ms) AS ms FROM nxt n JOIN files f ON f.scope = n.scope AND f.epoch = n.n[1] AND n.n[2] BETWEEN f.lo AND f.hi GROUP BY ALL),
short AS (SELECT scope, epoch, modified_ms, CASE WHEN sure IS NULL THEN lo ELSE greatest(sure + 1, lo) END AS missing FROM sp WHERE coalesce(sure, 0) < hi AND NOT {_COVERED.format(e="epoch", t="hi")}),
ev AS (SELECT s.scope, 'gap' AS finding, s.epoch, coalesce(min(f.modified_ms), any_value(s.modified_ms)) AS ms FROM short s LEFT JOIN files f ON f.scope = s.scope AND f.epoch = s.epoch AND missing BETWEEN f.lo AND f.hi GROUP BY ALL
  UNION ALL SELECT p.scope, 'lost', p.epoch, coalesce(m.ms, p.modified_ms) FROM sp p LEFT JOIN moved m ON m.scope = p.scope AND m.epoch = p.epoch WHERE sure > hi AND NOT newest AND NOT {_COVERED.format(e="p.epoch", t="sure")}
  UNION ALL SELECT p.scope, 'lost', p.epoch, l.modified_ms FROM sp p JOIN nodes n ON n.scope = p.scope AND n.incarnation = p.incarnation AND n.epoch = p.epoch JOIN losses l ON l.node = n.node WHERE sure > hi AND newest AND NOT {_COVERED.format(e="p.epoch", t="sure")}
  UNION ALL SELECT c.scope, 'lost', f.epoch, coalesce(m.ms, c.modified_ms) FROM chk c JOIN certified f ON f.scope = c.scope AND f.incarnation = c.incarnation LEFT JOIN moved m ON m.scope = c.scope AND m.epoch = f.epoch
    WHERE f.epoch > (SELECT min(epoch) FROM span z WHERE z.scope = c.scope) AND f.epoch < (SELECT max(epoch) FROM span z WHERE z.scope = c.scope) AND NOT EXISTS (SELECT 1 FROM span z WHERE z.scope = c.scope AND z.epoch = f.epoch) AND NOT {_COVERED.format(e="f.epoch", t="f.txid")}),
present AS (SELECT scope FROM heads UNION SELECT scope FROM broken),
found AS (SELECT scope, finding, string_agg(DISTINCT epoch, ',' ORDER BY epoch) AS epochs, min(ms) AS evidence_ms FROM ev GROUP BY ALL
  UNION ALL SELECT scope, 'unknown_stream', NULL, first_ms FROM live WHERE scope NOT IN (SELECT scope FROM pick)
  UNION ALL SELECT scope, 'unrestorable', NULL, first_ms FROM broken WHERE scope IN (SELECT scope FROM tag WHERE why IS NULL)
  UNION ALL SELECT scope, 'missing_deleted', NULL, last_ms FROM streams WHERE root IN (SELECT scope FROM present) AND scope NOT IN (SELECT scope FROM present) AND scope NOT IN (SELECT scope FROM erased))""", f"""
SELECT scope, finding, epochs, evidence_ms, evidence_ms <= {SETTLED} AS settled FROM found
UNION ALL SELECT scope, why, NULL, NULL, NULL FROM tag WHERE why IS NOT NULL UNION ALL SELECT scope, 'checked', NULL, NULL, NULL FROM chk"""),
    "commit_records": _sql(_COMMITS, "SELECT cell, epoch, txid, commit, table_name, count(*) AS n_rows, string_agg(change, ',' ORDER BY seq) AS rows FROM ch JOIN com USING (cell, epoch, txid) GROUP BY ALL"),
    "commit_fragments": _sql(f"""{CHANGES}, r AS (SELECT cell, epoch, txid, table_name, strlen(change) AS size, row_number() OVER (PARTITION BY cell, epoch, txid, table_name ORDER BY seq) AS k FROM ch),
w AS (SELECT cell, epoch, txid, table_name, k, size AS used, 1 AS f FROM r WHERE k = 1
  UNION ALL SELECT r.cell, r.epoch, r.txid, r.table_name, r.k, CASE WHEN w.used + r.size > 120 THEN r.size ELSE w.used + r.size END, w.f + CASE WHEN w.used + r.size > 120 THEN 1 ELSE 0 END
    FROM w JOIN r ON r.cell = w.cell AND r.epoch = w.epoch AND r.txid = w.txid AND r.table_name = w.table_name AND r.k = w.k + 1),
m AS (SELECT cell, epoch, txid, table_name, CAST(max(f) AS INT) AS fragments, max(used) AS largest FROM w GROUP BY ALL)""", "SELECT fragments, 'rows' AS kind, count(*) AS records, max(largest) AS largest FROM m GROUP BY ALL"),
    "watermark_emission": _sql(_MARKED, "SELECT cell, epoch, lag(txid) OVER w AS from_txid, lag(commit) OVER w AS from_commit, txid, commit, commits, records FROM blk WINDOW w AS (PARTITION BY cell, epoch ORDER BY b)"),
    "produced_certified": _sql(_MARKED, "SELECT cell, epoch, max(txid) AS txid, max(commit) AS commit FROM blk WHERE epoch <> 1 OR cell NOT IN (SELECT cell FROM com WHERE epoch = 1 AND commit = 3) GROUP BY ALL"),
    "row_dedup": _sql(RECORDS, "SELECT cell, kind, op, count(*) AS n FROM (SELECT DISTINCT * FROM frag WHERE kind IN ('rows', 'snapshot')) GROUP BY ALL"),
    "topic_batches": _sql(f"""{MESSAGES}, stop AS (SELECT partition, min(place) FILTER (NOT sound AND NOT skip) AS stop FROM msg GROUP BY partition),
r AS (SELECT msg.*, CASE WHEN sound AND NOT skip THEN 1 ELSE 0 END AS lands, row_number() OVER (PARTITION BY partition ORDER BY place) AS k FROM msg JOIN stop USING (partition) WHERE stop IS NULL OR place < stop),
w AS (SELECT partition, k, place, 0 AS batch, lands AS n, lands * bytes AS held FROM r WHERE k = 1
  UNION ALL SELECT r.partition, r.k, r.place, CASE WHEN w.n >= 20 OR w.held >= 1500 THEN w.batch + 1 ELSE w.batch END,
    CASE WHEN w.n >= 20 OR w.held >= 1500 THEN 0 ELSE w.n END + r.lands, CASE WHEN w.n >= 20 OR w.held >= 1500 THEN 0 ELSE w.held END + r.lands * r.bytes FROM w JOIN r ON r.partition = w.partition AND r.k = w.k + 1)""", "SELECT partition, batch, max(place) AS last_place, CAST(max(n) AS BIGINT) AS n, max(held) AS bytes FROM w GROUP BY partition, batch"),
    "sink_flushes": _sql(f"""{FLUSHES}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY at_ms, bytes) AS k FROM buf),
w AS (SELECT node, k, 0 AS flush, 1 AS n, bytes AS held, at_ms AS first_ms FROM r WHERE k = 1
  UNION ALL SELECT r.node, r.k, CASE WHEN w.held >= 2500 OR r.at_ms >= w.first_ms + 4000 THEN w.flush + 1 ELSE w.flush END, CASE WHEN w.held >= 2500 OR r.at_ms >= w.first_ms + 4000 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.held >= 2500 OR r.at_ms >= w.first_ms + 4000 THEN r.bytes ELSE w.held + r.bytes END, CASE WHEN w.held >= 2500 OR r.at_ms >= w.first_ms + 4000 THEN r.at_ms ELSE w.first_ms END FROM w JOIN r ON r.node = w.node AND r.k = w.k + 1)""", "SELECT node, flush, CAST(max(n) AS BIGINT) AS n, max(held) AS bytes, first_ms, CASE WHEN max(held) >= 2500 THEN 'bytes' ELSE 'interval' END AS why FROM w GROUP BY node, flush, first_ms"),
    "erased_rows": _sql(f"{RECORDS}, {TOMBSTONES}", "SELECT cell, facet, incarnation, count(*) AS n FROM delivered d WHERE EXISTS (SELECT 1 FROM tomb t WHERE t.cleared_at IS NULL AND t.script = d.script AND t.class = d.class AND t.cell = d.cell AND t.facet = d.facet AND (t.incarnation IS NULL OR t.incarnation = d.incarnation)) GROUP BY ALL"),
    "tombstones_added": _sql(f"{RECORDS}, {TOMBSTONES}, asked AS (SELECT DISTINCT cell, facet, CASE WHEN commit % 2 = 0 THEN incarnation END AS incarnation FROM delivered WHERE kind = 'deleted' OR cell = 'User:4')", """
SELECT cell, facet, incarnation, '2024-01-01' AS erased_at, 'old' AS reason, cleared_at FROM tomb
UNION ALL SELECT cell, facet, incarnation, '2024-02-01', 'asked', NULL FROM asked a WHERE NOT EXISTS (SELECT 1 FROM tomb t WHERE t.cleared_at IS NULL AND t.cell = a.cell AND t.facet = a.facet AND t.incarnation IS NOT DISTINCT FROM a.incarnation)"""),
    "landing_expired": _sql(RECORDS, "SELECT cell, count(*) AS n, max(commit) AS newest FROM delivered WHERE 1704067200 + commit * 60 < epoch(TIMESTAMP '2024-01-05') GROUP BY cell"),
    "incremental_current": changes.SQL["latest_rows"],
    "epoch_chain": _sql(f"""{CHAIN}, walk AS (
  SELECT scope, epoch, lo FROM (SELECT scope, epoch, min(lo) AS lo, row_number() OVER (PARTITION BY scope ORDER BY epoch DESC) AS r FROM files GROUP BY scope, epoch) WHERE r = 1
  UNION ALL SELECT scope, epoch, lo FROM (
    SELECT w.scope, f.epoch, min(f.lo) AS lo, row_number() OVER (PARTITION BY w.scope ORDER BY f.epoch DESC) AS r
    FROM walk w JOIN files f ON f.scope = w.scope AND f.epoch < w.epoch AND f.hi < w.lo WHERE w.lo > 1 GROUP BY w.scope, w.lo, f.epoch HAVING max(f.hi) = w.lo - 1) WHERE r = 1)""", "SELECT scope, epoch, lo FROM walk"),
}
