"""Queries that apply the scalar functions to events, orders, pages, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar, time
from tidemark.operators.vectors import nearest
from tidemark.plans.changes import read

CRON = "*/15 8-18 1,15,L * MON-FRI"
#: A week of a month, a day that most years lack, a step (which is a restriction) beside a weekday.
NEXT = {"second_monday": "30 6,18 * * 2#2", "leap_day": "0 0 29 2 *", "step_or_monday": "0 0 */2 * MON"}


def cron_matches(s, d):
    ev = read(s, d, "events").select("event_id", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("at"))
    return ev.where(time.cron_matches(CRON, F.col("at"))).select("event_id", time.minute_bucket(F.col("at")).alias("minute"))


def cron_next(s, d):
    at = F.col("ts").cast("timestamp")
    return read(s, d, "events").select("event_id", *(time.cron_next(x, at).cast("timestamp_ntz").alias(name) for name, x in NEXT.items()), time.cron_next_across(list(NEXT.values()), at).cast("timestamp_ntz").alias("next_across"))


def cron_fanout(s, d):
    """Which of several expressions a minute belongs to, and when to run again after it failed."""
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    again = time.cron_rearm(time.cron_next("0 * * * *", minute), minute + F.expr("make_dt_interval(0, 0, event_id % 90)"))
    return read(s, d, "events").select("event_id", F.array_join(time.cron_matching(["*/2 * * * *", "* 0-11 * * *", "* * * * MON-FRI"], minute), ",").alias("matching"), again.cast("timestamp_ntz").alias("rearm_at"))


def minute_buckets(s, d):
    return read(s, d, "events").groupBy(time.minute_bucket(F.col("ts")).alias("minute")).agg(F.count("*").alias("n"))


def page_urls(s, d):
    url = F.col("url")
    return read(s, d, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"), F.parse_url(url, F.lit("REF")).alias("fragment"), F.get(scalar.query_values(url, "utm_source"), F.lit(0)).alias("utm_source"), F.get(scalar.query_values(url, "page"), F.lit(0)).alias("page"))


RULES = [("/en/:id", "/articles/:id"), ("/fr/*", "/francais/:splat"), ("/*", "/other/:splat")]
HTML = [{"select": "script", "do": "remove"}, {"select": "style", "do": "remove"}, {"select": "a[href]", "do": "set", "name": "rel", "value": "nofollow"}, {"select": ".ad", "do": "remove"}, {"select": "b", "do": "unwrap"}, {"select": "!comment", "do": "remove"}, {"select": "title", "do": "inner", "value": "page"}]


def html_rewrite(s, d):
    out = read(s, d, "pages").select("page_id", scalar.rewrite_html(F.col("html"), HTML).alias("html"))
    return out.select("page_id", F.length("html").alias("chars"), F.contains("html", F.lit("<script")).alias("has_script"), F.contains("html", F.lit('rel="nofollow"')).alias("has_rel"), F.contains("html", F.lit("<title>page</title>")).alias("retitled"))


def trace_headers(s, d):
    ev = read(s, d, "events")
    header = F.concat(F.when(F.col("event_id") % 9 == 0, "01").otherwise("00"), F.lit("-"), F.when(F.col("event_id") % 7 == 0, "0" * 32).otherwise(F.md5(F.col("user_id").cast("string"))), F.lit("-"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 16), F.lit("-0"), F.col("event_id") % 2)
    return ev.select("event_id", scalar.traceparent(header).alias("t")).where("t IS NOT NULL").select("event_id", "t.*")


def knn_topk(s, d):
    """The five nearest vectors, by Euclidean distance to five digits, of every vector whose id is divisible by 50."""
    v = read(s, d, "embeddings").select("vec_id", "embedding")
    return nearest(v, v.where("vec_id % 50 = 0"), 5, digits=5)


def digests(s, d):
    o = read(s, d, "orders")
    text = F.concat_ws("|", F.col("o_orderkey"), "o_orderpriority")
    return o.select("o_orderkey", F.md5(text).alias("md5"), F.sha1(text).alias("sha1"), F.sha2(text, 256).alias("sha256"), F.base64(text.cast("binary")).alias("base64"), F.hex(text).alias("hex"), F.url_encode(text).alias("url"))


def json_values(s, d):
    ev = read(s, d, "events")
    k = F.get_json_object("props", "$.k")
    token = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"$number":"'), k, F.lit('"}'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"$date":'), k, F.lit("}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.col("props"))
    return ev.select("event_id", scalar.tagged_value(token).alias("value"))


def attribute_lists(s, d):
    ev = read(s, d, "events")
    text = F.concat(F.lit("type="), "event_type", F.lit(",user="), "user_id", F.lit(", ,eq=a=b+c,note=a%20b,type=x"), F.col("event_id") % 3)
    m = scalar.attributes(text)
    return ev.select("event_id", m["type"].alias("type"), m["user"].alias("user"), m["note"].alias("note"), m["eq"].alias("eq"), F.size(m).alias("n"))


def blob_references(s, d):
    """References of every kind, sound and not, made of order keys."""
    k, digest = F.col("o_orderkey"), F.sha2(F.col("o_orderkey").cast("string"), 256)
    text = F.when(k % 7 == 0, digest).when(k % 7 == 1, F.concat(F.lit("v2:e"), k, F.lit(":"), digest)).when(k % 7 == 2, F.concat(F.lit("v1:e1:"), digest)).when(k % 7 == 3, F.concat(F.lit("v2:e0:"), digest)).when(k % 7 == 4, F.concat(F.lit("v2:e1:"), F.upper(digest))).when(k % 7 == 5, "v2:e1").otherwise(F.concat(F.lit("v2:e1:"), digest, F.lit(":")))
    return read(s, d, "orders").select("o_orderkey", scalar.blob_reference(text).alias("r")).select("o_orderkey", F.col("r.epoch").cast("bigint").alias("epoch"), "r.digest", "r.error")


def edited_urls(s, d):
    url = F.concat(F.lit("http://h/p"), F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("?a="), F.col("user_id"), F.lit("&b%20c=1&a=2"))).otherwise(""), F.when(F.col("event_id") % 3 == 0, "#f?a=1").otherwise(""))
    return read(s, d, "events").select("event_id", scalar.edit_query(url, [("set", "a", "x y"), ("delete", "b c", None), ("append", "d", "é&")]).alias("url"))


QUERIES = {
    "blob_references": blob_references,
    "edited_urls": edited_urls,
    "crc64": lambda s, d: read(s, d, "customer").select("c_custkey", scalar.crc64(F.col("c_name")).alias("crc")),
    "cron_matches": cron_matches,
    "cron_next": cron_next,
    "cron_fanout": cron_fanout,
    "minute_buckets": minute_buckets,
    "page_urls": page_urls,
    "page_redirects": lambda s, d: page_urls(s, d).select("page_id", scalar.redirect(F.col("path"), RULES).alias("target")),
    "html_rewrite": html_rewrite,
    "trace_headers": trace_headers,
    "knn_topk": knn_topk,
    "digests": digests,
    "fnv_shards": lambda s, d: read(s, d, "customer").select("c_custkey", scalar.fnv1a64(F.col("c_name")).alias("fnv")),
    "json_values": json_values,
    "attribute_lists": attribute_lists,
    "truncated_texts": lambda s, d: read(s, d, "documents").select("doc_id", scalar.truncate_utf8(F.col("text"), 8192).alias("t")).select("doc_id", F.octet_length("t").alias("n_bytes"), F.length("t").alias("n_chars")),
}

_URL = r"'^[a-z]+://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
SQL = {
    "cron_matches": """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS minute FROM events
WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 18 AND (day(ts) IN (1, 15) OR day(ts) = day(last_day(ts)) OR dayofweek(ts) BETWEEN 1 AND 5)""",
    "cron_next": """
WITH a AS (SELECT t FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-06-01', INTERVAL 30 MINUTE) r(t) WHERE minute(t) = 30 AND hour(t) IN (6, 18) AND dayofweek(t) = 1 AND day(t) BETWEEN 8 AND 14),
b AS (SELECT t FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2040-01-01', INTERVAL 1 DAY) r(t) WHERE month(t) = 2 AND day(t) = 29),
c AS (SELECT t FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-06-01', INTERVAL 1 DAY) r(t) WHERE day(t) % 2 = 1 OR dayofweek(t) = 1)
SELECT event_id, a.t AS second_monday, b.t AS leap_day, c.t AS step_or_monday, least(a.t, b.t, c.t) AS next_across
FROM events ASOF LEFT JOIN a ON a.t > ts ASOF LEFT JOIN b ON b.t > ts ASOF LEFT JOIN c ON c.t > ts""",
    "cron_fanout": """
SELECT event_id, array_to_string(list_filter([CASE WHEN minute(ts) % 2 = 0 THEN 0 END, CASE WHEN hour(ts) < 12 THEN 1 END, CASE WHEN dayofweek(ts) BETWEEN 1 AND 5 THEN 2 END], lambda x: x IS NOT NULL), ',') AS matching,
  least(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('minute', ts) + to_minutes(CAST(event_id % 90 AS BIGINT))) AS rearm_at FROM events""",
    "minute_buckets": "SELECT strftime(ts, '%Y-%m-%dT%H:%M') AS minute, count(*) AS n FROM events GROUP BY 1",
    "page_urls": f"""
SELECT page_id, regexp_extract(url, {_URL}, 1) AS host, regexp_extract(url, {_URL}, 2) AS path, nullif(regexp_extract(url, {_URL}, 4), '') AS fragment,
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""",
    "page_redirects": f"""
SELECT page_id, CASE WHEN regexp_full_match(p, '/en/[^/]+') THEN '/articles/' || p[5:] WHEN starts_with(p, '/fr/') THEN '/francais/' || p[5:] ELSE '/other/' || p[2:] END AS target
FROM (SELECT page_id, regexp_extract(url, {_URL}, 2) AS p FROM pages)""",
    "trace_headers": """
SELECT event_id, md5(CAST(user_id AS VARCHAR)) AS trace_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS span_id, event_id % 2 = 1 AS sampled FROM events WHERE event_id % 9 <> 0 AND event_id % 7 <> 0""",
    "knn_topk": """
SELECT q.vec_id AS query_id, v.vec_id, round(sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda x: pow(x[1] - x[2], 2)))), 5) AS distance
FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, v.vec_id) <= 5""",
    "digests": """
SELECT o_orderkey, md5(t) AS md5, sha1(t) AS sha1, sha256(t) AS sha256, to_base64(encode(t)) AS base64, hex(encode(t)) AS hex, replace(url_encode(t), '%20', '+') AS url
FROM (SELECT o_orderkey, concat(o_orderkey, '|', o_orderpriority) AS t FROM orders)""",
    "blob_references": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN o_orderkey END AS epoch, CASE WHEN o_orderkey % 7 < 2 THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS digest,
  CASE o_orderkey % 7 WHEN 2 THEN 'version' WHEN 3 THEN 'epoch' WHEN 4 THEN 'digest' WHEN 5 THEN 'shape' WHEN 6 THEN 'shape' END AS error FROM orders""",
    "edited_urls": "SELECT event_id, concat('http://h/p?a=x+y&d=%C3%A9%26', CASE WHEN event_id % 3 = 0 THEN '#f?a=1' ELSE '' END) AS url FROM events",
    "crc64": f"""
SELECT c_custkey, printf('%016x', CAST(18446744073709551615::HUGEINT - list_reduce(list_prepend(18446744073709551615::HUGEINT, list_transform(range(1, strlen(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT)),
  lambda h, b: xor(list_extract({[str(v) for v in scalar.crc_table()]}::HUGEINT[], CAST(xor(h, b) % 256 AS BIGINT) + 1), h // 256)) AS UBIGINT)) AS crc FROM customer""",
    "fnv_shards": """
SELECT c_custkey, printf('%016x', CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT)),
  lambda h, b: (xor(h, b) * 435::HUGEINT + ((xor(h, b) % 16777216::HUGEINT) * 1099511627776::HUGEINT)) % 18446744073709551616::HUGEINT) AS UBIGINT)) AS fnv FROM customer""",
    "json_values": "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN props ELSE props->>'$.k' END AS value FROM events",
    "attribute_lists": "SELECT event_id, concat('x', event_id % 3) AS type, CAST(user_id AS VARCHAR) AS user, 'a b' AS note, 'a=b+c' AS eq, 4 AS n FROM events",
    "truncated_texts": """
SELECT doc_id, CAST(strlen(t) AS INT) AS n_bytes, CAST(length(t) AS INT) AS n_chars FROM (
  SELECT doc_id, CASE WHEN strlen(text) <= 8192 THEN text ELSE left(text, CAST(list_max(list_filter(range(2040, 8193), lambda n: n <= length(text) AND strlen(left(text, CAST(n AS BIGINT))) <= 8192)) AS BIGINT)) END AS t FROM documents)""",
}
