"""Change-stream queries over records made of events and lineitem, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import cdc
from tidemark.operators.walks import dealt, tasks_for
from tidemark.storage import store


def _div(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


#: Events as change records: kinds by divisibility; rows in up to two fragments, of which some are lost and some joined by a third that
#: can't be; deletions of two facets in one commit; tables renamed; every seventh event delivered twice.
RECORDS = f"""
ev AS (
  SELECT event_id, user_id, event_type, value, 'app' AS script, 'User' AS class, concat('User:', user_id % 20) AS cell,
    CASE WHEN user_id % 5 = 3 AND event_id % 2 = 0 THEN 'a' WHEN user_id % 5 = 3 AND event_id % 3 = 0 THEN 'a/b' ELSE '' END AS facet,
    {_div("event_id", 2500)} + 1 AS epoch, {_div("event_id % 2500", 5)} + 1 AS txid, event_id AS commit,
    CASE WHEN event_id > 0 AND event_id % 149 = 0 THEN 'deleted' WHEN event_id % 79 = 0 THEN 'recovered' WHEN event_id % 97 = 0 THEN 'bulk' WHEN event_id % 89 = 0 THEN 'gap'
      WHEN event_id % 61 = 0 THEN 'snapshot' WHEN event_id % 83 = 0 THEN 'schema' WHEN event_id % 71 = 0 THEN 'link' ELSE 'rows' END AS kind,
    CASE WHEN event_id % 53 = 0 THEN 'repair' ELSE 'live' END AS origin, concat('node-', event_id % 4) AS node,
    1704067200000 + event_id * 1000 AS committed_at, CASE WHEN user_id % 2 = 0 THEN 'profile' ELSE 'orders' END AS tbl
  FROM EVENTS),
rec AS (
  SELECT *, CASE WHEN facet = '' THEN 1 ELSE {_div("event_id", 5000)} + 1 END AS incarnation,
    CASE WHEN kind IN ('rows', 'snapshot', 'schema', 'bulk') THEN tbl END AS table_name,
    CASE WHEN kind IN ('rows', 'snapshot', 'schema', 'bulk') THEN CASE WHEN tbl = 'profile' THEN {_div("event_id", 4000)} + 1 ELSE 1 END END AS generation,
    CASE WHEN kind = 'snapshot' THEN concat('s', event_id) END AS snapshot_id,
    CASE WHEN kind = 'rows' AND event_id % 11 = 0 THEN 2 ELSE 1 END AS fragments,
    CASE WHEN kind = 'schema' THEN event_id % 7 = 0 END AS dropped, CASE WHEN kind = 'schema' AND event_id % 5 = 1 THEN CASE WHEN tbl = 'profile' THEN 'orders' ELSE 'profile' END END AS renamed_from, CAST(NULL AS STRING) AS scope, CAST(NULL AS BIGINT) AS expected,
    CASE WHEN kind = 'deleted' AND event_id % 2 = 1 THEN 'a' END AS target_facet, CASE WHEN kind = 'deleted' AND event_id % 4 = 1 THEN 1 END AS target_incarnation,
    CASE WHEN kind = 'deleted' THEN event_id % 3 = 0 END AS subtree, CASE WHEN kind = 'deleted' AND event_id % 5 < 2 THEN 1 END AS through_incarnation,
    CASE WHEN kind = 'gap' THEN epoch END AS to_epoch, CASE WHEN kind = 'gap' THEN txid + event_id % 3 END AS to_txid,
    CASE WHEN kind = 'recovered' THEN epoch END AS head_epoch, CASE WHEN kind = 'recovered' THEN txid + event_id % 5 - 2 END AS head_txid, CASE WHEN kind = 'recovered' THEN event_id % 2 = 0 END AS loss,
    CASE WHEN kind = 'gap' THEN concat('r', event_id % 3) END AS reason, CASE WHEN kind = 'link' THEN epoch - 1 END AS prev_epoch, CASE WHEN kind = 'link' THEN txid END AS prev_txid
  FROM ev),
ends AS (SELECT * FROM rec UNION ALL
  SELECT event_id, user_id, event_type, value, script, class, cell, facet, epoch, txid, commit, 'snapshot_end', origin, node, committed_at, tbl, incarnation,
    CASE WHEN event_id % 2 = 1 THEN table_name END, CASE WHEN event_id % 2 = 1 THEN generation END, snapshot_id, 1, dropped, renamed_from,
    CASE WHEN event_id % 2 = 1 THEN 'tables' ELSE 'stream' END, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END, target_facet, target_incarnation, subtree, through_incarnation, to_epoch, to_txid, head_epoch, head_txid, loss, reason, prev_epoch, prev_txid
  FROM rec WHERE kind = 'snapshot' UNION ALL
  SELECT event_id, user_id, event_type, value, script, class, cell, facet, epoch, txid, commit, kind, origin, node, committed_at, tbl, incarnation,
    table_name, generation, snapshot_id, fragments, dropped, renamed_from, scope, expected, 'a/b', target_incarnation, subtree, through_incarnation, to_epoch, to_txid, head_epoch, head_txid, loss, reason, prev_epoch, prev_txid
  FROM rec WHERE kind = 'deleted' AND target_facet IS NOT NULL),
frag AS (
  SELECT ends.*, f.fragment, user_id + (f.fragment - 1) * 100000 AS row_key, CASE WHEN kind = 'snapshot' THEN 'I' WHEN event_type = 'error' THEN 'D' WHEN event_type = 'signup' THEN 'I' ELSE 'U' END AS op
  FROM ends JOIN (SELECT 1 AS fragment UNION ALL SELECT 2 AS fragment UNION ALL SELECT 3 AS fragment) f ON f.fragment <= fragments OR f.fragment = 3 AND fragments = 2 AND event_id % 33 = 0
  WHERE NOT (f.fragment = 2 AND event_id % 121 = 0)),
delivered AS (SELECT * FROM frag UNION ALL SELECT * FROM frag WHERE event_id % 7 = 0)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, what: str = "delivered") -> DataFrame:
    """Records as delivered, with the JSON body of row records."""
    rows = spark.sql(f"WITH {RECORDS.replace('EVENTS', '{events}')} SELECT * FROM {what}", events=read(spark, sf_dir, "events"))
    if what != "delivered":
        return rows
    row = F.concat(F.lit("["), F.col("row_key"), F.lit(',"'), "event_type", F.lit('",'), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit("]"))
    body = F.concat(F.lit('{"columns":["id","kind","value"],"key_columns":["id"],"rows":[["'), "op", F.lit('",['), "row_key", F.lit("],"), row, F.lit("]]}"))
    return rows.withColumn("body", F.when(F.col("kind").isin("rows", "snapshot"), body)).drop("event_type", "value", "user_id", "row_key", "op", "tbl")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.whole_records(records(spark, sf_dir))


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records as a table: what is derived from them reads them many times, each time other columns."""
    return store(_whole(spark, sf_dir), "records")


def _stream(c: str = "") -> str:
    return ", ".join(c + s for s in cdc.STREAM)


#: Whole records, as the SQL twins see them: of the fragments in range, those of which all came.
WHOLE = f"{RECORDS}, whole AS (SELECT DISTINCT * FROM frag WHERE fragment <= fragments AND NOT (fragments = 2 AND event_id % 121 = 0))"
POS = "(epoch, txid, commit)"
_P = "row(epoch, txid, commit)"


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each (l_orderkey, l_linenumber); a returned line deletes its key."""
    lines = read(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    newest = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max(order).alias("v"))
    return newest.where("v.l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "v.*")


def record_dedup(spark, sf_dir):
    return cdc.first_deliveries(records(spark, sf_dir)).groupBy("kind", "fragment").agg(F.count("*").alias("n"))


def fragment_whole(spark, sf_dir):
    return _whole(spark, sf_dir).groupBy("cell", "facet", "kind").agg(F.count("*").alias("n"), F.max(cdc.position_key()).alias("last_key"))


def stream_deletions(spark, sf_dir):
    whole = _landed(spark, sf_dir)
    return cdc.above_deletions(whole, whole).groupBy(*cdc.STREAM).agg(F.count("*").alias("n"), F.min("commit").alias("first_commit"))


def facet_deletions(spark, sf_dir):
    whole = _landed(spark, sf_dir)
    return cdc.facet_deletions(whole, whole)


TOMBSTONES = """tomb AS (SELECT 'app' AS script, 'User' AS class, concat('User:', k) AS cell, CASE WHEN k % 3 = 0 AND k > 0 THEN 'a' ELSE '' END AS facet,
  CASE WHEN k % 2 = 0 THEN CAST(1 AS BIGINT) END AS incarnation, CASE WHEN k = 4 THEN 'x' END AS cleared_at
  FROM (SELECT 0 AS k UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 8) t)"""


def tombstone_route(spark, sf_dir):
    landed = records(spark, sf_dir).withColumn("facet", F.nullif("facet", F.lit("")))
    changes, meta = cdc.route(landed, spark.sql(f"WITH {TOMBSTONES} SELECT * FROM tomb"))
    both = changes.withColumn("routed_to", F.lit("changes")).unionByName(meta.withColumn("routed_to", F.lit("meta")))
    return both.groupBy("routed_to", "cell", "facet").agg(F.count("*").alias("n"), F.max("committed_at").cast("timestamp_ntz").alias("last_at"))


def _cut(c: str) -> list:
    return [F.col(f"{c}.position.{p}").alias(f"cut_{p}") for p in cdc.POSITION] + [F.col(f"{c}.rank").alias("cut_rank"), F.col(f"{c}.id").alias("cut_id")]


def snapshot_winner(spark, sf_dir):
    cuts = cdc.winning_cuts(cdc.snapshot_cuts(_whole(spark, sf_dir)))
    return cuts.select(*cdc.STREAM, "scope", *cdc.TABLE, *_cut("cut"))


def _generations(whole):
    return cdc.generations(whole, cdc.snapshot_cuts(whole))


def generation_state(spark, sf_dir):
    gens = _generations(_landed(spark, sf_dir))
    return gens.select(*cdc.STREAM, *cdc.TABLE, F.col("opened.commit").alias("opened_commit"), "closed", F.col("cut.position.commit").alias("cut_commit"), "uncertain")


def uncertain_tables(spark, sf_dir):
    return _generations(_landed(spark, sf_dir)).where("uncertain").select(*cdc.STREAM, *cdc.TABLE)


def current_rows(spark, sf_dir):
    """Typed current rows of all streams: the whole way from deliveries to tables."""
    whole = _landed(spark, sf_dir)
    rows = cdc.latest_rows(whole, _generations(whole))
    columns = cdc.projection([("id", "INTEGER"), ("kind", "TEXT"), ("value", "REAL"), ("note", "")])
    return cdc.typed_rows(rows, columns).select(*cdc.STREAM, *cdc.TABLE, F.col("id").cast("bigint"), "kind", "value", "note", "commit")


def certified(spark, sf_dir):
    return _certified(spark, sf_dir)


def _sent(rec: DataFrame) -> DataFrame:
    return rec.where("origin <> 'repair' AND kind <> 'recovered'").select(*cdc.STREAM, *cdc.POSITION)


def _marks(sent: DataFrame) -> DataFrame:
    """A mark per 50 transactions, one in five of them with a record too few; besides, marks over two blocks, and every third mark twice."""
    block = F.floor((F.col("txid") - 1) / 50).cast("bigint")
    own = sent.groupBy(*cdc.STREAM, "epoch", block.alias("block")).agg(F.count("*").alias("n"), F.max(F.struct("txid", "commit")).alias("last"))
    order = Window.partitionBy(*cdc.STREAM, "epoch").orderBy("block")
    marked = own.withColumns({"from1": F.lag("last").over(order), "from2": F.lag("last", 2).over(order), "n2": F.col("n") + F.lag("n").over(order)})
    columns = [*cdc.STREAM, "epoch", F.col("from.txid").alias("from_txid"), F.col("from.commit").alias("from_commit"), "last.txid", "last.commit", F.col("n").alias("commits"), (F.col("n") - F.col("short")).alias("records")]
    one = marked.withColumns({"from": F.col("from1"), "short": (F.col("block") % 5 == 4).cast("bigint")}).select(*columns, "block")
    two = marked.where("n2 IS NOT NULL").withColumns({"from": F.col("from2"), "n": F.col("n2"), "short": (F.col("block") % 3 == 1).cast("bigint")}).select(*columns, "block")
    return one.unionByName(two).unionByName(one.where("block % 3 = 0")).drop("block")


MARKS = f"""
sent AS (SELECT {_stream()}, epoch, txid, commit, {_div("(txid - 1)", 50)} AS block FROM rec WHERE origin <> 'repair' AND kind <> 'recovered'),
blocks AS (SELECT {_stream()}, epoch, block, count(*) AS n, max(txid) AS txid, max(commit) AS commit FROM sent GROUP BY ALL),
prior AS (SELECT *, lag(txid) OVER w AS t1, lag(commit) OVER w AS c1, lag(txid, 2) OVER w AS t2, lag(commit, 2) OVER w AS c2, n + lag(n) OVER w AS n2 FROM blocks WINDOW w AS (PARTITION BY {_stream()}, epoch ORDER BY block)),
marks AS (SELECT {_stream()}, epoch, t1 AS ft, c1 AS fc, txid, commit, n AS commits, n - CASE WHEN block % 5 = 4 THEN 1 ELSE 0 END AS records FROM prior
  UNION ALL SELECT {_stream()}, epoch, t2, c2, txid, commit, n2, n2 - CASE WHEN block % 3 = 1 THEN 1 ELSE 0 END FROM prior WHERE n2 IS NOT NULL),
held AS (SELECT m.* FROM marks m JOIN sent s ON {" AND ".join(f"m.{x} = s.{x}" for x in (*cdc.STREAM, "epoch"))} AND (s.txid, s.commit) <= (m.txid, m.commit) AND (ft IS NULL OR (s.txid, s.commit) > (ft, fc))
  GROUP BY ALL HAVING count(*) = records AND count(DISTINCT s.commit) = commits),
onward AS (SELECT {_stream()}, epoch, ft, fc, min(row(txid, commit)) AS upto FROM held GROUP BY ALL),
walk AS (SELECT {_stream()}, epoch, upto FROM onward WHERE ft IS NULL
  UNION ALL SELECT o.script, o.class, o.cell, o.facet, o.incarnation, o.epoch, o.upto FROM walk w JOIN onward o ON {" AND ".join(f"o.{x} = w.{x}" for x in (*cdc.STREAM, "epoch"))} AND o.ft = w.upto[1] AND o.fc = w.upto[2]),
certified AS (SELECT {_stream()}, epoch, max(upto)[1] AS txid, max(upto)[2] AS commit FROM walk GROUP BY ALL)
"""


def _certified(spark, sf_dir):
    sent = _sent(records(spark, sf_dir, "rec"))
    tasks = tasks_for(sent)
    sent = dealt(sent, tasks, *cdc.STREAM, "epoch")
    return cdc.certified_heads(sent, _marks(sent), tasks=tasks)


def stream_summary(spark, sf_dir):
    delivered = records(spark, sf_dir)
    out = cdc.stream_summary(cdc.first_deliveries(delivered), _landed(spark, sf_dir), _certified(spark, sf_dir))
    nodes = F.array_join(F.transform("nodes", lambda x: F.concat_ws(":", x["epoch"].cast("string"), F.array_join(x["sent"], "+"))), ",")
    ends = F.array_join(F.transform("certified", lambda x: F.concat_ws(":", x["epoch"].cast("string"), x["txid"].cast("string"), x["commit"].cast("string"))), ",")
    return out.withColumns({"nodes": nodes, "certified": ends})


def state_at(spark, sf_dir):
    whole = cdc.state_at(_landed(spark, sf_dir), 2, 250, 2**40)
    return cdc.latest_rows(whole, _generations(whole)).groupBy(*cdc.STREAM, *cdc.TABLE).agg(F.count("*").alias("live_rows"), F.max("commit").alias("newest"))


#: Open findings of a reconciler, as it leaves them for the derived tables.
FINDINGS = "finds AS (SELECT script, class, cell, facet, incarnation, epoch AS head_epoch, txid AS head_txid, CASE WHEN event_id % 2 = 0 THEN 'lost' ELSE 'gap' END AS finding FROM rec WHERE event_id % 613 = 5)"


def export_gaps(spark, sf_dir):
    whole = _landed(spark, sf_dir)
    cuts = cdc.snapshot_cuts(whole)
    found = spark.sql(f"WITH {RECORDS.replace('EVENTS', '{events}')}, {FINDINGS} SELECT * FROM finds", events=read(spark, sf_dir, "events"))
    return cdc.export_gaps(whole, cuts, _certified(spark, sf_dir), cdc.generations(whole, cuts).where("uncertain"), found)


def quarantine(spark, sf_dir):
    return cdc.quarantined(records(spark, sf_dir)).groupBy("fault", "kind", "fragment").agg(F.count("*").alias("n"), F.min("commit").alias("first_commit"))


def reassembly(spark, sf_dir):
    """Records put together from their fragments: how many rows each then holds."""
    one = cdc.reassembled(cdc.whole_records(records(spark, sf_dir)).where("kind = 'rows'"))
    return one.select("cell", "facet", "commit", "fragments", F.size(F.from_json(F.get_json_object("body", "$.rows"), "array<string>")).cast("bigint").alias("n_rows"), F.md5(F.get_json_object("body", "$.rows")).alias("rows_md5"))


RECOVERED = "recov AS (SELECT 'User' AS class, cell, epoch, concat('r', event_id) AS session, event_id % 2 = 0 AS loss FROM ev WHERE event_id % 401 = 0 UNION ALL SELECT 'Room', 'Room:1', 1, 'r0', TRUE)"


def recovered_adoption(spark, sf_dir):
    rec = spark.sql(f"WITH {RECORDS.replace('EVENTS', '{events}')}, {RECOVERED} SELECT * FROM recov", events=read(spark, sf_dir, "events"))
    return cdc.recovered_applied(rec, records(spark, sf_dir, "rec"))


QUERIES = {
    "latest_rows": latest_lines,
    "record_dedup": record_dedup,
    "fragment_whole": fragment_whole,
    "stream_deletions": stream_deletions,
    "facet_deletions": facet_deletions,
    "tombstone_route": tombstone_route,
    "snapshot_winner": snapshot_winner,
    "generation_state": generation_state,
    "uncertain_tables": uncertain_tables,
    "current_rows": current_rows,
    "certified_heads": certified,
    "stream_summary": stream_summary,
    "state_at": state_at,
    "export_gaps": export_gaps,
    "fragment_quarantine": quarantine,
    "record_reassembly": reassembly,
    "recovered_adoption": recovered_adoption,
}

_KEY = "concat_ws('.', lpad(epoch::VARCHAR, 20, '0'), lpad(txid::VARCHAR, 20, '0'), lpad(commit::VARCHAR, 20, '0'))"


def _cuts(source: str) -> str:
    return f"""
cuts AS (SELECT e.*, CASE origin WHEN 'repair' THEN 2 WHEN 'snapshot' THEN 1 ELSE 0 END AS rank FROM {source} e WHERE kind = 'snapshot_end'
  AND expected = (SELECT count(*) FROM {source} p WHERE p.kind = 'snapshot' AND p.snapshot_id = e.snapshot_id AND p.cell = e.cell AND p.facet = e.facet AND p.incarnation = e.incarnation AND p.commit = e.commit)),
won AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY {_stream()}, scope, table_name, generation ORDER BY epoch DESC, txid DESC, commit DESC, rank DESC, snapshot_id DESC) = 1),
opened AS (SELECT {_stream()}, table_name, generation, min({_P}) AS opened, bool_or(kind = 'schema' AND coalesce(dropped, FALSE)) AS dropped, max(CASE WHEN kind = 'bulk' THEN {_P} END) AS bulk
  FROM {source} WHERE table_name IS NOT NULL AND kind IN ('rows', 'snapshot', 'schema', 'bulk') GROUP BY ALL),
best AS (SELECT o.*, (SELECT max(row(w.epoch, w.txid, w.commit, w.rank, w.snapshot_id)) FROM won w WHERE w.cell = o.cell AND w.facet = o.facet AND w.incarnation = o.incarnation
    AND (w.scope = 'stream' OR w.table_name = o.table_name AND w.generation = o.generation)) AS cut,
  dropped OR generation < max(generation) OVER (PARTITION BY {_stream()}, table_name)
    OR EXISTS (SELECT 1 FROM {source} n WHERE n.renamed_from = o.table_name AND n.cell = o.cell AND n.facet = o.facet AND n.incarnation = o.incarnation AND row(n.epoch, n.txid, n.commit) >= o.opened) AS closed FROM opened o),
gens AS (SELECT *, NOT closed AND bulk IS NOT NULL AND (cut IS NULL OR bulk > row(cut[1], cut[2], cut[3])) AS uncertain FROM best),
live AS (SELECT r.*, g.cut FROM {source} r JOIN gens g ON g.cell = r.cell AND g.facet = r.facet AND g.incarnation = r.incarnation AND g.table_name = r.table_name AND g.generation = r.generation
  WHERE NOT g.closed AND (r.kind = 'snapshot' AND g.cut IS NOT NULL AND r.snapshot_id = g.cut[5] AND r.commit = g.cut[3] OR r.kind = 'rows' AND (g.cut IS NULL OR row(r.epoch, r.txid, r.commit) > row(g.cut[1], g.cut[2], g.cut[3])))),
current AS (SELECT * FROM (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY {_stream()}, table_name, generation, row_key ORDER BY epoch DESC, txid DESC, commit DESC, origin DESC, fragment DESC) = 1) WHERE op <> 'D')
"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}".replace("EVENTS", "events")


SQL = {
    "latest_rows": """
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
  l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1
  AND l_returnflag <> 'R'
""",
    "record_dedup": _with(RECORDS, "SELECT kind, fragment, count(*) AS n FROM (SELECT DISTINCT event_id, kind, fragment, target_facet FROM delivered) GROUP BY ALL"),
    "fragment_whole": _with(WHOLE, f"SELECT cell, facet, kind, count(*) AS n, max({_KEY}) AS last_key FROM whole GROUP BY ALL"),
    "stream_deletions": _with(WHOLE, f"""
SELECT {_stream("w.")}, count(*) AS n, min(w.commit) AS first_commit FROM whole w
LEFT JOIN (SELECT {_stream()}, max(commit) AS cut FROM whole WHERE kind = 'deleted' AND target_facet IS NULL GROUP BY ALL) c USING ({_stream()})
WHERE cut IS NULL OR w.commit > cut GROUP BY ALL"""),
    "facet_deletions": _with(WHOLE, f"""
SELECT DISTINCT {_stream("s.")} FROM whole s JOIN (SELECT * FROM whole WHERE kind = 'deleted' AND target_facet IS NOT NULL) d ON s.script = d.script AND s.class = d.class AND s.cell = d.cell AND s.facet <> ''
WHERE CASE WHEN d.through_incarnation IS NOT NULL THEN s.incarnation <= d.through_incarnation AND (s.facet = d.target_facet OR d.subtree AND starts_with(s.facet, d.target_facet || '/'))
  ELSE s.facet = d.target_facet AND (d.target_incarnation IS NULL OR s.incarnation = d.target_incarnation) OR d.subtree AND starts_with(s.facet, d.target_facet || '/') END"""),
    "tombstone_route": _with(f"{RECORDS}, {TOMBSTONES}", """
SELECT CASE WHEN kind IN ('rows', 'snapshot') THEN 'changes' ELSE 'meta' END AS routed_to, cell, facet, count(*) AS n, make_timestamp(max(committed_at) * 1000) AS last_at FROM delivered d
WHERE NOT EXISTS (SELECT 1 FROM tomb t WHERE t.cleared_at IS NULL AND t.script = d.script AND t.class = d.class AND t.cell = d.cell AND t.facet = d.facet AND (t.incarnation IS NULL OR t.incarnation = d.incarnation))
GROUP BY ALL"""),
    "snapshot_winner": _with(f"{WHOLE}, {_cuts('whole')}", f"SELECT {_stream()}, scope, table_name, generation, epoch AS cut_epoch, txid AS cut_txid, commit AS cut_commit, rank AS cut_rank, snapshot_id AS cut_id FROM won"),
    "generation_state": _with(f"{WHOLE}, {_cuts('whole')}", f"SELECT {_stream()}, table_name, generation, opened[3] AS opened_commit, closed, cut[3] AS cut_commit, uncertain FROM gens"),
    "uncertain_tables": _with(f"{WHOLE}, {_cuts('whole')}", f"SELECT {_stream()}, table_name, generation FROM gens WHERE uncertain"),
    "current_rows": _with(f"{WHOLE}, {_cuts('whole')}", f"SELECT {_stream()}, table_name, generation, row_key AS id, event_type AS kind, value, CAST(NULL AS VARCHAR) AS note, commit FROM current"),
    "certified_heads": _with(f"{RECORDS}, {MARKS}", "SELECT * FROM certified"),
    "stream_summary": _with(f"{WHOLE}, {MARKS}, gone AS (SELECT {_stream()}, max({_P}) AS gone_at, max({_KEY}) AS deleted_at FROM whole WHERE kind = 'deleted' AND target_facet IS NULL GROUP BY ALL), above AS (SELECT w.* FROM whole w LEFT JOIN gone g USING ({_stream()}) WHERE gone_at IS NULL OR row(w.epoch, w.txid, w.commit) > gone_at), {_cuts('above')}", f"""
SELECT {_stream()}, records, nodes, first_key, last_key, last_committed_at, certified, snapshot_at, deleted_at
FROM (SELECT {_stream()}, count(*) AS records, min({_KEY}) AS first_key, max({_KEY}) AS last_key, max(committed_at) AS last_committed_at FROM (SELECT DISTINCT * FROM frag) GROUP BY ALL)
LEFT JOIN (SELECT {_stream()}, string_agg(epoch || ':' || sent, ',' ORDER BY epoch) AS nodes FROM (SELECT {_stream()}, epoch, string_agg(DISTINCT node, '+' ORDER BY node) AS sent FROM frag WHERE origin = 'live' AND kind <> 'recovered' GROUP BY ALL) GROUP BY ALL) USING ({_stream()})
LEFT JOIN (SELECT {_stream()}, string_agg(concat_ws(':', epoch, txid, commit), ',' ORDER BY epoch) AS certified FROM certified GROUP BY ALL) USING ({_stream()})
LEFT JOIN (SELECT {_stream()}, {_KEY} AS snapshot_at FROM won WHERE scope = 'stream') USING ({_stream()}) LEFT JOIN gone USING ({_stream()})"""),
    "fragment_quarantine": _with(RECORDS, "SELECT 'out_of_range' AS fault, kind, fragment, count(*) AS n, min(commit) AS first_commit FROM (SELECT DISTINCT * FROM frag) WHERE fragment > fragments GROUP BY ALL"),
    "record_reassembly": _with(WHOLE, """
SELECT cell, facet, commit, 1 AS fragments, count(*) AS n_rows, md5('[' || string_agg('["' || op || '",[' || row_key || '],[' || row_key || ',"' || event_type || '",' || VALUE_TEXT || ']]', ',' ORDER BY fragment) || ']') AS rows_md5
FROM whole WHERE kind = 'rows' GROUP BY cell, facet, incarnation, commit""".replace("VALUE_TEXT", "coalesce(CAST(value AS VARCHAR), 'null')")),
    "state_at": _with(f"{WHOLE}, upto AS (SELECT * FROM whole WHERE {POS} <= (2, 250, {2**40})), {_cuts('upto')}", f"SELECT {_stream()}, table_name, generation, count(*) AS live_rows, max(commit) AS newest FROM current GROUP BY ALL"),
    "export_gaps": _with(f"{WHOLE}, {_cuts('whole')}, {MARKS}, {FINDINGS}, said AS (SELECT DISTINCT {_stream()}, kind, epoch, txid, commit, reason, coalesce(loss, FALSE) AS loss, coalesce(to_epoch, prev_epoch, head_epoch) AS be, coalesce(to_txid, prev_txid, head_txid) AS bt FROM whole WHERE kind IN ('gap', 'link', 'recovered'))", f"""
SELECT {_stream("w.")}, w.kind AS gap_kind, w.epoch, w.txid, w.commit, be AS bound_epoch, CASE WHEN w.loss THEN greatest(bt, coalesce(h.txid, bt)) ELSE bt END AS bound_txid, h.txid AS certified_txid, NULL::VARCHAR AS table_name, NULL::BIGINT AS generation, w.reason
FROM said w LEFT JOIN certified h ON {" AND ".join(f"h.{x} = w.{x}" for x in cdc.STREAM)} AND h.epoch = be LEFT JOIN (SELECT * FROM won WHERE scope = 'stream') c ON {" AND ".join(f"c.{x} = w.{x}" for x in cdc.STREAM)}
WHERE (w.kind = 'gap' OR bt > coalesce(h.txid, 0) OR w.loss AND h.txid > bt) AND (c.epoch IS NULL OR row(be, CASE WHEN w.loss THEN greatest(bt, coalesce(h.txid, bt)) ELSE bt END) > row(c.epoch, c.txid))
UNION ALL SELECT {_stream()}, 'bulk', NULL, NULL, NULL, NULL, NULL, NULL, table_name, generation, 'bulk' FROM gens WHERE uncertain
UNION ALL SELECT DISTINCT {_stream()}, 'reconciler', NULL, NULL, NULL, head_epoch, head_txid, NULL, NULL, NULL, finding FROM finds"""),
    "recovered_adoption": _with(f"{RECORDS}, {RECOVERED}", """
SELECT recov.class, recov.cell, recov.epoch, session, loss, coalesce(s.script, '') AS script, max(s.incarnation) AS incarnation FROM recov
LEFT JOIN (SELECT DISTINCT script, class, cell, incarnation FROM rec WHERE facet = '') s ON s.class = recov.class AND s.cell = recov.cell AND s.incarnation <= recov.epoch GROUP BY ALL"""),
}
