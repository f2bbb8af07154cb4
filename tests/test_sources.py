"""Change files, JSON lines, listings, names and the routing stream."""

import json

from pyspark.sql import functions as F

from tidemark.functions import scalar, time
from tidemark.operators import exports, producers, upkeep
from tidemark.sources import changefiles as c
from tidemark.streaming import pipelines


def record(kind="rows", cell="x", fragment=1, fragments=1, **more):
    return {"kind": kind, "script": "a", "class": "C", "cell": cell, "facet": None, "incarnation": 1, "epoch": 1, "txid": 1, "commit": 18446744073709551615, "committed_at": 1790000000000, "node": "n", "origin": "live", "fragment": fragment, "fragments": fragments, **more}


def test_json_lines(spark, tmp_path):
    lines = [record(object="export/1.parquet"), record(), record("odd"), record(cell=None), record(fragment=3, fragments=2)]
    (tmp_path / "in.jsonl").write_text("\n".join([*map(json.dumps, lines), "no json"]))
    rows = c.read_json_lines(spark, str(tmp_path / "in.jsonl"))
    good, bad = c.split_valid(rows)
    found = good.orderBy("source").collect()
    assert [r.source.rsplit("/", 1)[-1] for r in found] == ["1.parquet", "in.jsonl"]
    assert int(found[0].commit) == 2**64 - 1 and bad.count() == 4
    assert "no json" in {r.body for r in bad.collect()}


def test_listings(spark):
    listed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "key string, version int")
    known = spark.createDataFrame([("a", 1)], "key string, version int")
    assert sorted(map(tuple, c.newer_objects(listed, known).collect())) == [("a", 2), ("b", 1)]
    spans = spark.createDataFrame([("p/n1/2024/05/06/07/x.parquet",)], "path string")
    assert c.with_layout(spans).select("node", "dt", "hh").first() == ("n1", "2024-05-06", "07")


def test_names(spark):
    assert scalar.table_name("e", "a-b", "C", "t") != scalar.table_name("e", "a_b", "C", "t")
    assert scalar.table_name("e", "a", "C", "t").startswith("E_A_C_T_") and len(scalar.table_name("e", "a" * 99, "C", "t")) < 70
    rows = spark.createDataFrame([("Chat:a:b",), ("__Kv:x",), ("Chat",)], "s string").select(scalar.scope_parts(F.col("s")).alias("p")).collect()
    assert [tuple(r.p) for r in rows] == [("Chat", "a:b", False), ("__Kv", "x", True), ("Chat", None, False)]
    assert [r[0] for r in spark.createDataFrame([("2024-05-06T07:08",), ("2024-05-06",), ("2024-13-06T07:08",)], "m string").select(time.minute_start(F.col("m")).cast("string")).collect()] == ["2024-05-06 07:08:00", None, None]
    kv = spark.createDataFrame([("s", "k", "v"), ("t", "k", "w")], "scope string, k string, v string")
    assert list(map(tuple, exports.kv_rows(kv, "s").collect())) == [("k", "v")]


def test_cron_without_an_end(spark):
    at = spark.sql("SELECT TIMESTAMP '2096-03-01 00:00:30' AS t")
    got = at.select(time.cron_next("0 0 29 2 *", F.col("t")).cast("string").alias("a"), time.cron_next("0 0 30 2 *", F.col("t")).alias("b"), time.cron_next("* * * * *", F.col("t")).cast("string").alias("c"), time.cron_next("0 12 LW * *", F.col("t")).cast("string").alias("d")).first()
    assert (got.a, got.b, got.c, got.d) == ("2104-02-29 00:00:00", None, "2096-03-01 00:01:00", "2096-03-30 12:00:00")
    step = spark.sql("SELECT TIMESTAMP '2024-01-03 00:00:00' AS t")
    assert step.select(time.cron_matches("0 0 */2 * MON", F.col("t"))).first()[0]


def test_attribute_lists_are_whole_or_an_error(spark):
    import pytest

    rows = spark.createDataFrame([("a=b=c, ,d=%20x",), (None,), ("",)], "t string")
    assert [r.m for r in rows.select(scalar.attributes(F.col("t")).alias("m")).collect()] == [{"a": "b=c", "d": " x"}, None, {}]
    for bad in ("a", "=b", "a=1,b"):
        with pytest.raises(Exception, match="not a list of attributes"):
            spark.createDataFrame([(bad,)], "t string").select(scalar.attributes(F.col("t"))).collect()
    url = spark.createDataFrame([("http://h/?a=b=c&%61=2&x",)], "u string")
    assert url.select(scalar.query_values(F.col("u"), "a").alias("v"), scalar.query_values(F.col("u"), "x").alias("w")).first() == (["b=c", "2"], [""])


def test_html_leaves_as_it_came_where_no_rule_fits():
    text = '<!DOCTYPE html><P Title="say &quot;hi&quot;" x=\'1\'>a &amp b<br/><?pi x?><![CDATA[y]]><!-- c --></P ><svg><path d="1"/></svg>'
    assert scalar._Rewriter([]).run(text) == text
    rules = [{"select": "p", "do": "set", "name": "rel", "value": 'q"'}, {"select": "p", "do": "prepend", "value": "^"}, {"select": "p", "do": "append", "value": "$"}, {"select": "svg", "do": "replace", "value": "S"}, {"select": "!doctype", "do": "remove"}, {"select": "!end", "do": "append", "value": "E"}]
    assert scalar._Rewriter(rules).run(text) == '<P title="say &quot;hi&quot;" x="1" rel="q&quot;">^a &amp b<br/><?pi x?><![CDATA[y]]><!-- c -->$</P >SE'


def test_landed_records_are_routed(spark, tmp_path):
    rows = [("rows", "a", "C", "x", None, 1, 5), ("gap", "a", "C", "x", None, 1, 6), ("rows", "a", "C", "y", "f", 2, 7), ("rows", "a", "C", "y", "f", 3, 8)]
    schema = "kind string, script string, class string, cell string, facet string, incarnation bigint, committed_at bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    gone = spark.createDataFrame([("a", "C", "y", "f", 2, None)], "script string, class string, cell string, facet string, incarnation bigint, cleared_at string")
    query = pipelines.landed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), gone)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/changes")).count() == 2 and spark.read.parquet(str(tmp_path / "out/meta")).count() == 1


def test_upkeep_depends_on_the_rows_alone(spark):
    schema = "k int, at int, v string"
    batches = [[(1, 5, "e"), (2, 1, "a")], [(1, 3, "c"), (3, 1, "z")], [(2, 2, "b")], []]
    current = spark.createDataFrame([], schema)
    for rows in batches:
        current = upkeep.upkeep(current, spark.createDataFrame(rows, schema), ["k"], ["at"])
    assert sorted(map(tuple, current.collect())) == [(1, 5, "e"), (2, 2, "b"), (3, 1, "z")]


def test_a_poison_message_stops_its_partition_until_it_is_skipped(spark):
    schema = "partition bigint, place bigint, bytes bigint, sound boolean, skip boolean"
    rows = [(0, 1, 10, True, False), (0, 1, 10, True, False), (0, 2, 10, False, True), (0, 3, 10, True, False), (0, 4, 10, False, False), (0, 5, 10, True, False), (1, 9, 99, False, False)]
    out = producers.topic_batches(spark.createDataFrame(rows, schema), records=10, size=1000).collect()
    assert list(map(tuple, out)) == [(0, 0, 3, 2, 20)]
