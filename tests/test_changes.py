"""Change-record derivations against a plain consumer, under duplicated, shuffled and fragmented delivery."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import cdc
from tidemark.operators.kv import clamp_limit, prefix_upper

SCHEMA = "script string, class string, cell string, facet string, incarnation bigint, epoch bigint, txid bigint, commit bigint, kind string, origin string, table_name string, generation bigint, snapshot_id string, fragment int, fragments int, body string, dropped boolean, renamed_from string, scope string, expected bigint, target_facet string"


def rec(commit, kind="rows", **more):
    base = dict.fromkeys((c.split()[0] for c in SCHEMA.split(", ")))
    base |= {"script": "a", "class": "C", "cell": "x", "facet": "", "incarnation": 1, "epoch": 1, "txid": commit, "commit": commit, "kind": kind, "origin": "live", "fragment": 1, "fragments": 1}
    return base | more


def row(commit, key, value, op="U", table="t", generation=1, **more):
    body = f'{{"columns":["id","v"],"key_columns":["id"],"rows":[["{op}",[{key}],[{key},{value}]]]}}'
    return rec(commit, table_name=table, generation=generation, body=body, **more)


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def current(spark, rows):
    whole = cdc.whole_records(frame(spark, rows))
    gens = cdc.generations(whole, cdc.snapshot_cuts(whole))
    return {(r.table_name, r.key): r.row for r in cdc.latest_rows(whole, gens).collect()}


def slow_current(writes):
    state = {}
    for commit, key, value, op in sorted(writes):
        state.pop(("t", f"[{key}]"), None)
        if op != "D":
            state["t", f"[{key}]"] = f"[{key},{value}]"
    return state


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 99), st.sampled_from("UUUD")), min_size=1, max_size=20), st.randoms(use_true_random=False))
def test_state_ignores_order_and_duplicates(spark, writes, rng):
    numbered = [(i + 1, *w) for i, w in enumerate(writes)]
    delivered = [row(i, k, v, op) for i, k, v, op in numbered]
    delivered += rng.sample(delivered, len(delivered) // 3)
    rng.shuffle(delivered)
    assert current(spark, delivered) == slow_current(numbered)


def test_incomplete_fragments_wait(spark):
    parts = [row(1, 1, 1, fragment=1, fragments=2), row(2, 2, 2, fragment=1, fragments=2), row(2, 3, 3, fragment=2, fragments=2)]
    assert set(current(spark, parts)) == {("t", "[2]"), ("t", "[3]")}


def test_integer_and_real_keys_differ(spark):
    assert set(current(spark, [row(1, 1, 5), row(2, "1.0", 6)])) == {("t", "[1]"), ("t", "[1.0]")}


def test_a_complete_snapshot_cuts_and_an_incomplete_one_does_not(spark):
    snap = row(5, 9, 9, op="I", kind="snapshot", snapshot_id="s")
    before, after = row(1, 1, 1), row(6, 2, 2)
    end = lambda n: rec(5, "snapshot_end", snapshot_id="s", scope="stream", expected=n)
    assert set(current(spark, [before, snap, end(1), after])) == {("t", "[9]"), ("t", "[2]")}
    assert set(current(spark, [before, snap, end(2), after])) == {("t", "[1]"), ("t", "[2]")}
    assert set(current(spark, [before, rec(5, "snapshot_end", snapshot_id="e", scope="stream", expected=0), after])) == {("t", "[2]")}


def test_generations_close(spark):
    drop = rec(4, "schema", table_name="t", generation=1, dropped=True)
    assert current(spark, [row(1, 1, 1), drop]) == {}
    assert set(current(spark, [row(1, 1, 1), row(2, 2, 2, generation=2)])) == {("t", "[2]")}
    renamed = rec(4, "schema", table_name="u", generation=1, renamed_from="t", dropped=False)
    assert current(spark, [row(1, 1, 1), renamed]) == {}


def test_bulk_makes_a_table_uncertain(spark):
    def uncertain(rows):
        whole = cdc.whole_records(frame(spark, rows))
        return cdc.generations(whole, cdc.snapshot_cuts(whole)).where("uncertain").count()

    bulk = rec(3, "bulk", table_name="t", generation=1)
    later = [row(5, 9, 9, op="I", kind="snapshot", snapshot_id="s"), rec(5, "snapshot_end", snapshot_id="s", scope="stream", expected=1)]
    assert uncertain([row(1, 1, 1), bulk]) == 1
    assert uncertain([row(1, 1, 1), bulk, *later]) == 0


def test_certified_heads_stop_at_the_first_false_mark(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for cell in ("x", "y"):
        for t in range(1, 41):
            rows.append(("a", "C", cell, "", 1, 1, t, t))
        at = None
        for k, upto in enumerate((8, 15, 27, 40)):
            n = upto - (at or 0)
            wrong = cell == "y" and k == 2
            marks.append(("a", "C", cell, "", 1, 1, at, at, upto, upto, n, n - wrong))
            at = upto
    rng.shuffle(rows)
    sent = spark.createDataFrame(rows, "script string, class string, cell string, facet string, incarnation bigint, epoch bigint, txid bigint, commit bigint")
    held = spark.createDataFrame(marks, "script string, class string, cell string, facet string, incarnation bigint, epoch bigint, from_txid bigint, from_commit bigint, txid bigint, commit bigint, commits bigint, records bigint")
    assert {r.cell: r.txid for r in cdc.certified_heads(sent, held).collect()} == {"x": 40, "y": 15}


def test_projection():
    assert [cdc.affinity(x) for x in ("INTEGER", "POINT", "varchar(9)", "BLOB", "double", "", None, "CHARINT")] == ["integer", "integer", "text", "blob", "real", "variant", "variant", "integer"]
    assert cdc.projection([("a", "INT"), ("b", "TEXT"), ("a", "REAL")]) == {"a": "variant", "b": "text"}
    with pytest.raises(ValueError):
        cdc.projection([])


def test_typed_values(spark):
    from pyspark.sql import functions as F

    tokens = ["1.5", '{"$real":"inf"}', '{"$blob":"aGk="}', "text", "null", '{"$blob":"?"}']
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = df.select(*(cdc.typed(F.col("t"), k).alias(k) for k in ("integer", "real", "blob", "text", "variant"))).collect()
    assert [int(r.integer) if r.integer is not None else None for r in got] == [2, None, None, None, None, None]
    assert [r.real for r in got][:2] == [1.5, float("inf")] and got[2].blob == b"hi" and got[5].blob is None
    assert [r.text for r in got] == ["1.5", None, None, "text", None, None]


def test_prefix_bounds_and_limits():
    assert prefix_upper("ab") == "ac" and prefix_upper("a\U0010ffff") == "b" and prefix_upper("\ud7ff") == "\ue000" and prefix_upper("") is None
    assert [clamp_limit(x) for x in (None, -1, 5, 9999)] == [1000, 1000, 5, 1000]


def test_change_files_round_trip(spark, tmp_path):
    from tidemark.sources import changefiles as c

    rows = frame(spark, [row(1, 1, 1), row(2, 2, 2, kind="odd")]).selectExpr("*", "CAST(NULL AS STRING) AS cell_name", "timestamp_millis(5) AS committed_at", "'n' AS node")
    typed = rows.select(*(rows[f.name].cast(f.dataType) for f in c.RECORD.fields))
    c.write_changes(typed, str(tmp_path / "out"))
    good, bad = c.read_changes(spark, str(tmp_path / "out"))
    assert (good.count(), bad.count()) == (1, 1)
    assert c.as_messages(good).first().key == "a\0C\0x\0\x001"


def test_user_sql_guards(spark):
    from tidemark.operators.relational import one, user_sql

    t = spark.range(3)
    t.limit(0).createOrReplaceTempView("tm_t")
    assert user_sql(spark, "SELECT id FROM tm_t WHERE id > ? ORDER BY id -- all", [0], tm_t=t).count() == 2
    assert user_sql(spark, "WITH x AS (SELECT id FROM tm_t) SELECT max(id) AS m FROM x", tm_t=t).first().m == 2
    assert spark.table("tm_t").count() == 0  # views of the session stay
    spark.range(0).write.mode("overwrite").saveAsTable("tm_kept")
    writes = ["DROP TABLE tm_kept", "WITH x AS (SELECT 1 AS id) INSERT INTO tm_kept SELECT id FROM x", "FROM range(3) INSERT INTO tm_kept SELECT id", "SET a = 1", "INSERT INTO tm_kept VALUES (1)", "CREATE TABLE tm_made AS SELECT 1", "EXPLAIN SELECT 1"]
    for text in writes:
        with pytest.raises(PermissionError):
            user_sql(spark, text, tm_t=t)
    assert spark.table("tm_kept").count() == 0
    with pytest.raises(TypeError):
        user_sql(spark, "SELECT ?", [object()])
    with pytest.raises(ValueError):
        one(t)


def test_user_sql_never_cuts_a_result(spark):
    from tidemark.operators.relational import user_sql

    t = spark.range(50)
    assert user_sql(spark, "SELECT * FROM t", limit=50, t=t).count() == 50
    for bounds in ({"limit": 49}, {"size": 100}):
        with pytest.raises(Exception, match="more than"):
            user_sql(spark, "SELECT * FROM t", t=t, **bounds).collect()


def test_cron_rejects_bad_fields():
    from tidemark.functions.time import parse_cron

    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "* * * * 0", "* * * * 2#6"):
        with pytest.raises(ValueError):
            parse_cron(bad)


def test_range_counts_equal_the_join_and_never_pair_points_with_ranges(spark):
    from tidemark.operators.relational import range_counts, range_join

    rng = random.Random(3)
    points = [(k, rng.choice([rng.uniform(-60, 60), float(rng.randrange(-5, 5)), None, float("inf"), float("nan")])) for k in "ab" for _ in range(300)]
    ranges = [(i, rng.choice("abc"), lo, lo + rng.choice([0.0, 0.5, 40.0, -1.0])) for i, lo in enumerate([*(rng.uniform(-70, 70) for _ in range(60)), *map(float, range(-6, 6)), float("inf")])]
    p, r = spark.createDataFrame(points, "k string, x double"), spark.createDataFrame(ranges, "i int, k string, lo double, hi double")
    for by in (["k"], []):
        left = p if by else p.drop("k")
        want = {w.i: w["count"] for w in range_join(left, r, at="x", low="lo", high="hi", width=7.0, by=by).groupBy("i").count().collect()}
        assert {g.i: g.n for g in range_counts(left, r, at="x", low="lo", high="hi", width=7.0, by=by).collect()} == want
    # 2,000,000 points in each of 2,000,000 ranges: as pairs they would never end.
    many = spark.range(2_000_000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    got = range_counts(many.select("x"), many.select("id", F.col("x").alias("lo"), (F.col("x") + 5).alias("hi")), at="x", low="lo", high="hi", width=25.0)
    assert got.agg(F.sum("n")).first()[0] == 200_000**2 * sum(min(5, 10 - x) for x in range(10))


def test_nearest_over_many_blocks_and_of_distances_that_round_alike(spark):
    import numpy as np

    from tidemark.operators.vectors import nearest

    draw = np.random.default_rng(5)
    points = draw.normal(size=(120, 3)).round(1)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>").repartition(7)
    # Each partition stays its own, as those of a large table do.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = sorted((r.query_id, r.vec_id, r.distance) for r in nearest(rows, rows.where("vec_id % 3 = 0"), 4, digits=1, block=16, group=8).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    exact = np.float32(points).astype(float)
    far = np.floor(np.sqrt(((exact[:, None] - exact[None]) ** 2).sum(axis=2)) * 10 + 0.5) / 10
    want = sorted((q, i, far[q, i]) for q in range(0, 120, 3) for i in sorted((i for i in range(120) if i != q), key=lambda i: (far[q, i], i))[:4])
    assert got == want


def test_tasks_grow_in_number_with_records(spark, monkeypatch):
    from tidemark.operators import walks

    monkeypatch.setattr(walks, "TASK_ROWS", 20)
    whole = cdc.whole_records(frame(spark, [row(i, i, i) for i in range(1, 401)]))
    first = cdc.first_deliveries(frame(spark, [row(i, i, i) for i in range(1, 401)]))
    assert whole.count() == first.count() == 400
    assert whole.rdd.getNumPartitions() >= 20 and first.rdd.getNumPartitions() >= 20


def test_tasks_of_restore_plans_grow_in_number_with_files(spark, monkeypatch):
    from tidemark.operators import audit, walks

    monkeypatch.setattr(walks, "TASK_ROWS", 20)
    files = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 40).alias("scope"), F.lit(1).cast("bigint").alias("epoch"), F.lit(0).alias("level"), (F.floor(F.col("id") / 40) + 1).alias("lo"), (F.floor(F.col("id") / 40) + 1).alias("hi"))
    plan = audit.restore_plan(files, files.groupBy("scope", "epoch").agg(F.max("hi").alias("target")))
    assert plan.count() == 400 and plan.rdd.getNumPartitions() >= 20
