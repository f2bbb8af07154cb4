"""Operators on pages, conversations and vectors, and the registered queries."""

import json
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.llm import toolcalls, urlrules, vectors

ENTRY = entry


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "c-d", "www"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(label() for _ in range(rng.randint(0, 3)))
    rules = sorted({(host(), path()): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q=/x', '#f'])}" for _ in range(300)] + [None, "", "no-scheme", "HTTP://A.B/x", "x://", "http://a.b:80/p", "http://u@a/"]
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate(urls)], "page_id bigint, url string, shard int, key string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules] + [(None, "/", "block")], "host string, path string, verdict string")
    out = {r.page_id: r for r in urlrules.apply_rules(pages, table).collect()}
    for i, u in enumerate(urls):
        h, p = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            h, p = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = [(len(rh) + len(rp), len(rh), rh + rp, v) for (rh, rp), v in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        want = max(fits)[2:] if fits else (None, "allow")
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (h, p, *want), u
    assert urlrules.apply_rules(pages.limit(0), table).count() == 0
    assert {r.verdict for r in urlrules.apply_rules(pages, table.limit(0)).collect()} == {"allow"}


def test_a_hot_host_is_dealt_over_shards(spark):
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://hot.example/', id) AS url")
    rules = spark.createDataFrame([("example", "/1", "block")], "host string, path string, verdict string")
    out = urlrules.apply_rules(pages, rules)
    assert out.where("verdict = 'block'").count() == 1111
    assert len({len(p) for p in out.rdd.glom().collect()}) >= 1


def call(i, turn, refs=(), name="t", arguments='{"x": 1}', conv=1):
    return (conv, i, turn, name, arguments, list(refs))


CALLS = "conv_id bigint, call_id string, turn int, name string, arguments string, refs array<string>"
RESULTS = "conv_id bigint, call_id string, turn int, content string"


def test_tool_calls(spark):
    schema = '{"type":"object","required":["x"],"properties":{"x":{"type":"integer","maximum":5}},"additionalProperties":false}'
    calls = [call("a", 1), call("b", 2, ["a"]), call("c", 3, ["b", "a", "gone"]), call("d", 4, ["e"]), call("e", 5, ["d"]), call("f", 6, ["d"]), call("g", 7, [], "t", '{"x":9,"y":1.0}'), call("h", 8, [], "u"), call("i", 9, [], "t", "{bad"), call("a", 9, [], "t", "{}"), (None, "z", 1, "t", "{}", []), (1, "n", 1, "t", None, None)]
    results = [(1, "a", 2, "ok"), (1, "a", 3, "later"), (1, "b", 1, "early"), (1, "q", 4, "lost"), (1, "c", 3, None)]
    out = toolcalls.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame([("t", schema)], "name string, schema string"))
    got = {(r.call_id, r.status): r for r in out.collect()}
    assert {k[0]: got[k].level for k in got if k[1] != "orphan_result"} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "g": 0, "h": 0, "i": 0, "n": 0}
    assert json.loads(got["a", "linked"].json) == {"id": "a", "name": "t", "arguments": {"x": 1}, "result": "ok"}
    assert ("b", "no_result") in got and ("b", "orphan_result") in got and ("q", "orphan_result") in got and ("c", "linked") in got
    assert got["g", "no_result"].errors == "$.x: out of bounds; $.y: unexpected" and got["g", "no_result"].json.startswith('{"arguments":{"x":9,"y":1},')
    assert got["h", "no_result"].errors == "unknown tool" and got["i", "no_result"].errors == "$: not JSON" and got["n", "no_result"].errors == "$: not JSON"
    assert len(got) == 12


def test_tool_calls_of_empty_tables(spark):
    empty = toolcalls.link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([], "name string, schema string"))
    assert empty.count() == 0


def brute(ids, rows):
    sound = [i for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {}
    for i in sound:
        for j in sound:
            if i < j and len(rows[i]) == len(rows[j]):
                x, y = np.array(rows[i], float), np.array(rows[j], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    links.setdefault(i, set()).add(j)
                    links.setdefault(j, set()).add(i)
    low = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low[ids[i]] = (len(links.get(i, ())), min(ids[j] for j in seen))
    return low


@pytest.mark.parametrize(("leaf", "spill"), [(4096, 0.03), (60, 0.1)])
def test_vectors_equal_brute_force(spark, leaf, spill):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    rows = [x.tolist() for x in base]
    rows += [(base[k] + rng.normal(scale=s, size=16)).tolist() for k in range(60) for s in (0.1, 0.3)]
    rows += [base[0].tolist()] * 5 + [(base[1] * 7).tolist(), [0.0] * 16, None, [], [1.0, None] + [0.0] * 14, [float("nan")] * 16, [1.0, 2.0], [2.0, 4.0], [1e30] * 16]
    frame = spark.createDataFrame([(i, v, 1, "n", "r") for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, label int, n string, rep string")
    out = vectors.similar_vectors(frame, leaf=leaf, spill=spill, trees=8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    want = brute(list(range(len(rows))), rows)
    if leaf > len(rows):
        assert got == want
    else:  # an approximate index: recall of links, and none that isn't one
        assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())
    assert vectors.similar_vectors(frame.limit(0)).count() == 0


def test_all_operators_are_registered():
    found = ENTRY.queries()
    assert "pipeline" in found
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in found) == 1
    assert set(ENTRY.oracle_sql()) <= set(found)


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0 and docs.columns == ["doc_id", "ids"]
