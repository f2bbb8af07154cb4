"""Whole operators and the pipeline against brute force, and on inputs that have broken such operators before."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from test_documents import ODD, SCHEMA, components_of, exact_components, frame, slow_fingerprint, slow_lines, slow_windows

from tidemark.llm import linededup, mixing, nearcopies, passages, quality, simhash, tokens, toolcalls, urlrules, vectors
from tidemark.llm.textstats import FIELDS, text_stats


def documents(n, seed, words=(25, 120)):
    """Documents of several languages and sources with junk, copies, near copies and shared lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(*words))]
        text = " ".join(x + rng.choice(["", "", "", "", "", "", "", ".", "\n"]) for x in w)
        kind = rng.random()
        if kind < 0.05:
            text = " ".join(x + "***" for x in w)
        elif kind < 0.1:
            text = " ".join(w[:5] * 12)
        elif kind < 0.2 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.3 and rows:
            own = (rng.choice(rows)[1] or "").split(" ")
            own[rng.randrange(len(own))] = word()
            text = " ".join(own)
        elif kind < 0.4:
            text += "\na line that many documents share\n" + word()
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 4}"))
    return rows


def features(text):
    s = dict(zip(FIELDS, text_stats(text), strict=True))
    words = s["n_words"] + quality.PRIOR_WORDS
    return [math.log((s["word_chars"] + quality.PRIOR_WORDS * quality.PRIOR_LENGTH) / words), *(math.sqrt(s[c] / words) for c in ("n_symbols", "n_dup_lines", "n_repeat_words", "n_echo_words"))]


def plain_fit(x, floors, covered=quality.COVERED):
    """Minimum covariance determinant by concentration steps from the same kinds of starts."""
    p, n = x.shape[1], len(x)
    scale = covered / quality.chi2_cdf(quality.chi2_quantile(covered, p), p + 2)
    low = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    middle = low(x)
    width = np.maximum(low(np.abs(x - middle)) * 1.4826, floors)

    def fit(rows, part, factor):
        mean = (rows * part[:, None]).sum(0) / part.sum()
        second = np.einsum("i,ij,ik->jk", part, rows, rows) / part.sum()
        return mean, (second - np.outer(mean, mean)) * factor + np.diag(np.square(floors))

    best = None
    for box in quality.STARTS:
        within = np.ones(n, bool) if box is None else (np.abs(x - middle) / width).max(axis=1) <= box
        if not within.any():
            continue
        mean, cov = fit(x, within.astype(float), 1.0)
        for _ in range(quality.MOST_STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(np.log2(d + 1e-9) * quality.BINS)
            names, at, counts = np.unique(bins, return_inverse=True, return_counts=True)
            part = np.clip((n * covered - (np.cumsum(counts) - counts)) / counts, 0, 1)[at]
            before = np.linalg.slogdet(cov)[1]
            mean, cov = fit(x, part, scale)
            if abs(before - np.linalg.slogdet(cov)[1]) <= quality.SETTLED / 10:
                break
        if best is None or np.linalg.slogdet(cov)[1] < best[2]:
            best = mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
    return best[:2]


def plain_kept(rows):
    """(kept, distance) of each row of (doc_id, text, lang, source)."""
    stats = [dict(zip(FIELDS, text_stats(t), strict=True)) for _, t, _, _ in rows]
    base = [s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"] for s in stats]
    x = np.array([features(t) for _, t, _, _ in rows])
    floors = list(quality.FLOORS.values())
    keys = [[("s", lang, source), ("l", lang), ("all",)] for _, _, lang, source in rows]
    fits = {}
    for key in {k for own in keys for k in own}:
        own = [i for i in range(len(rows)) if not base[i] and key in keys[i]]
        if own:
            fits[key] = (len(own), *plain_fit(x[own], floors))
    out = []
    for i, own in enumerate(keys):
        left, total = 1.0, 0.0
        for key in own:
            if key in fits:
                n, mean, inverse = fits[key]
                weight = n / (n + quality.PRIOR_DOCS)
                total += left * weight * float((x[i] - mean) @ inverse @ (x[i] - mean))
                left *= 1 - weight
        out.append((not base[i] and total <= quality.chi2_quantile(1 - quality.TAIL, 5), total))
    return out


def write(spark, rows, path):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_quality_equals_a_plain_fit(spark, tmp_path):
    rows = documents(600, 21)
    out = {r.doc_id: r for r in quality.quality_rules(write(spark, rows, tmp_path / "q")).collect()}
    want = plain_kept(rows)
    assert [out[i].kept for i in range(len(rows))] == [k for k, _ in want]
    assert 20 < sum(not k for k, _ in want) < 200
    near = [abs(math.log((out[i].distance + 1) / (d + 1))) for i, (_, d) in enumerate(want)]
    assert np.median(near) < 0.05 and max(near) < 0.5  # starts from approximate medians may settle a little elsewhere


def test_the_fit_has_a_small_determinant(spark):
    """Two clouds, the lesser one tighter than the whole: the classical start alone would cover both."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (700, 2)), rng.normal(12, 0.5, (300, 2))])
    rows = spark.createDataFrame([("g", [float(v) for v in p]) for p in x], "fit_key string, features array<double>")
    fit = quality.fit_outliers(rows, {"x": 0.01, "y": 0.01}, covered=0.6).first()
    assert fit.n == 1000 and fit.centre == pytest.approx([0, 0], abs=0.2)
    brute = min((plain_fit(x, [0.01, 0.01], 0.6) for _ in range(1)), key=lambda f: -np.linalg.slogdet(f[1])[1])
    assert np.linalg.slogdet(np.array(fit.precision).reshape(2, 2))[1] == pytest.approx(np.linalg.slogdet(brute[1])[1], abs=0.1)


def test_quality_keeps_other_columns_and_any_rows(spark, tmp_path):
    docs = frame(spark, ODD, tmp_path / "o").withColumnRenamed("rank", "kept").withColumnRenamed("n", "n_words")
    row = docs.selectExpr("doc_id", "text", "lang", "source", "struct(*) AS row")
    out = quality.quality_rules(row, keep=("row",)).select("row.*")
    assert out.columns == docs.columns and out.count() == len(ODD)


def test_simhash_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 7)))
    texts = []
    for _ in range(250):
        w = [word() for _ in range(rng.randint(0, 400))]
        texts.append(" ".join(w))
        if rng.random() < 0.5 and w:
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    docs = frame(spark, [*enumerate(texts), (len(texts), None), (len(texts) + 1, " ")], tmp_path / "s")
    fps = [slow_fingerprint(t, 3) for t in [*texts, None, " "]]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components_of(len(fps), links)
    for shard in (50, simhash.SHARD):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, shard=shard).collect()}
        assert got == {i: (f"{f:016x}", want[i]) for i, f in enumerate(fps)}
    assert len(set(want)) < len(fps) - 30


def test_a_tree_goes_on_beyond_its_sample():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    tree = simhash.Tree(points[:50], len(points), 200, 2)
    _, shards, home = tree.place(points)
    assert home.sum() == len(points) and np.bincount(shards[home]).max() < 2000
    unit = vectors.unit_rows(rng.normal(size=(20_000, 16)))
    forest = vectors.Forest(unit[:50], len(unit), trees=1, leaf=200)
    assert np.bincount([c[0] for c in forest.place(unit)]).max() < 3000


def test_recall_of_vector_links_at_the_defaults(spark):
    """20,000 vectors in clusters, with many links just above 0.9; recall against all pairs."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(2000, 64))
    x = (centres[rng.integers(0, 2000, 20_000)] + rng.normal(scale=0.33, size=(20_000, 64))).astype(np.float32)
    unit = vectors.unit_rows(x)
    links = np.zeros(len(x), np.int64)
    for s in range(0, len(x), 1000):
        links[s : s + 1000] = (unit[s : s + 1000] @ unit.T >= 0.9).sum(axis=1) - 1
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x.tolist())}), "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.similar_vectors(rows).collect()}
    recall = sum(got.values()) / links.sum()
    print(f"recall {recall:.4f} of {links.sum() // 2} links")
    assert links.sum() > 20_000 and recall >= 0.9
    assert all(got[i] <= links[i] for i in got)


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (2, [0.0, 1.0])]
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert out == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 1, 2)]  # rows of one vec_id share their links


def plain_passages(docs, min_words):
    """The words of each document in runs of repeated units, or in windows of 50 words that come earlier."""
    cut = slow_windows(docs, passages.PASSAGE)
    seen = {}
    for i, t in docs:
        for k, (_, _, _, _, digest) in enumerate(passages.units(t)):
            seen.setdefault(digest, (i, k))
    for i, t in docs:
        run, runs = [], []
        for k, (_, _, word, n, digest) in enumerate(passages.units(t)):
            if seen[digest] < (i, k):
                run.append((word, n))
            else:
                runs.append(run)
                run = []
        for own in [*runs, run]:
            if sum(n for _, n in own) >= min_words:
                for word, n in own:
                    cut[i].update(range(word, word + n))
    return cut


@pytest.mark.parametrize("min_words", [1, 30])
def test_passages_equal_brute_force(spark, tmp_path, min_words):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 20))) + rng.choice([". ", "! ", "\n", "? "])
    pool = [sentence() for _ in range(30)]
    docs = [(i, "".join(rng.choice(pool) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(1, 25)))) for i in range(40)]
    docs += [(40 + k, rng.choice(docs)[1]) for k in range(5)]
    texts, got = dict(docs), {i: set() for i, _ in docs}
    rows = frame(spark, docs, tmp_path / "p")
    for r in passages.repeated_passages(rows.unionByName(rows.where("doc_id = 7")), min_words=min_words).collect():
        before = len(texts[r.doc_id][: r.start].split())
        got[r.doc_id].update(range(before, before + r.n_words))
        assert len(texts[r.doc_id][r.start : r.end].split()) == r.n_words
    assert got == plain_passages(docs, min_words)
    cut = {r.doc_id: r.text for r in passages.remove_passages(rows, min_words=min_words, removed="places").collect()}
    for i, t in docs:
        assert cut[i].split() == [w for k, w in enumerate(t.split()) if k not in got[i]]


def test_a_document_that_comes_twice_repeats_no_more_than_once(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(20)) + ". " + " ".join(f"v{k}" for k in range(40)) + ". " + " ".join(f"w{k}" for k in range(20)) + "."
    once, twice = frame(spark, [(1, text)], tmp_path / "a"), frame(spark, [(1, text), (1, text)], tmp_path / "b")
    for rows in (once, twice):
        assert passages.repeated_passages(rows, min_words=30).count() == 0
        assert [(r.n_units, r.n_words) for r in passages.repeated_passages(rows).collect()] == [(1, 20)]


CLASHES = ["_doc", "_hash", "_gone", "_parts", "_h", "_d", "_t", "_id", "_again", "_text", "row", "kept", "n_words", "key", "rank", "line_no", "text_hash", "component_id", "fp", "digest", "unit", "mix_n", "block", "ids"]


def test_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rows = documents(60, 51)
    docs = write(spark, rows, tmp_path / "c").selectExpr("*", *(f"doc_id AS `{c}`" for c in CLASHES))
    for out in (linededup.dedup_lines(docs), corpus_pipeline.quality(spark, docs, ""), corpus_pipeline.near(spark, docs, ""), mixing.poisson_mix(docs).drop("mix_copy", "mix_key")):
        assert out.columns == docs.columns
        assert all(r[c] == r.doc_id for r in out.collect() for c in CLASHES)
    found = passages.remove_passages(docs)
    assert found.columns == [*docs.columns, "removed"] and found.count() == len(rows)
    with pytest.raises(ValueError, match="removed"):
        passages.remove_passages(docs.withColumnRenamed("_h", "removed"))


def test_mixing_of_documents_without_id(spark):
    rows = [(None, f"text {i}", "en", "a" if i % 2 else "b", 1, 1, 1, "k", "d", "c") for i in range(1000)]
    out = mixing.poisson_mix(spark.createDataFrame(rows, SCHEMA), epochs=2.0).collect()
    assert 1800 < len(out) < 2200 and len({r.mix_key for r in out}) == len(out)


CALLS = "conv_id bigint, call_id string, turn int, name string, arguments string, refs array<string>"
RESULTS = "conv_id bigint, call_id string, turn int, content string"


def linked(spark, calls, schemas, results=()):
    return toolcalls.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), RESULTS), spark.createDataFrame(schemas, "name string, schema string"))


def test_bad_schemas_and_arguments_are_errors_of_their_rows(spark):
    schemas = [("text", "no json"), ("yes", "true"), ("no", "false"), ("list", "[]"), ("kind", '{"type":"odd"}'), ("kinds", '{"type":[1]}'), ("pattern", '{"properties":{"q":{"pattern":"("}}}'), ("bound", '{"properties":{"q":{"minLength":null}}}'), ("enum", '{"properties":{"q":{"enum":[1]}}}'), ("deep", '{"items":' * 2000 + "true" + "}" * 2000), ("null", None)]
    deep = "[" * 3000 + "]" * 3000
    cases = [("text", '{"q":"x"}'), ("yes", '{"q":"\\ud83d"}'), ("no", "{}"), ("list", "{}"), ("kind", "{}"), ("kinds", "{}"), ("pattern", '{"q":"x"}'), ("bound", '{"q":"x"}'), ("enum", '{"q":true}'), ("enum", '{"q":1.0}'), ("deep", "[1]"), ("yes", deep), ("null", "{}"), ("yes", "NaN"), ("yes", None), (None, "{}"), ("yes", '{"\\udc00":1}'), ("yes", json.dumps({"q": "x" * 1_000_000}))]
    out = {r.call_id: r for r in linked(spark, [(1, f"c{i:02}", i, name, a, None) for i, (name, a) in enumerate(cases)], schemas).collect()}
    errors = [out[f"c{i:02}"].errors for i in range(len(cases))]
    bad, none = "schema: not usable", "$: not JSON"
    assert errors == [bad, None, "$: not allowed", bad, bad, bad, bad, bad, "$.q: not in enum", None, None, none, "unknown tool", none, none, "unknown tool", None, None]
    assert json.loads(out["c01"].json)["arguments"] == {"q": "\ud83d"} and len(out["c17"].json) > 1_000_000
    assert all(r.json == toolcalls.canonical(json.loads(r.json)) for r in out.values())


def test_schema_equality():
    assert toolcalls.same(1, 1.0) and not toolcalls.same(1, True) and not toolcalls.same([True], [1]) and toolcalls.same({"a": [1]}, {"a": [1.0]})
    assert toolcalls.check_schema(True, {"const": 1}) and not toolcalls.check_schema(False, {"enum": [0, False]})


def test_long_conversations_and_chains(spark):
    """Chains of one reference after the other, ordered at once and round by round alike."""
    calls = [(conv, f"c{k:03}", k, "t", "{}", [f"c{k - 1:03}"] if k else []) for conv, n in ((1, 300), (2, 12)) for k in range(n)] + [(3, "a", 1, "t", "{}", ["b"]), (3, "b", 1, "t", "{}", ["a"]), (3, "c", 1, "t", "{}", ["a", None])]
    one = spark.createDataFrame(calls, CALLS).select("conv_id", "call_id", "refs")
    want = {(c, i): k if c < 3 else None for c, i, k, *_ in calls}
    assert {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(one).collect()} == want
    few = one.where("conv_id > 1")
    assert {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(few, most=2).collect()} == {k: v for k, v in want.items() if k[0] > 1}


def test_tool_calls_with_other_columns(spark):
    calls = spark.createDataFrame([(1, "a", 1, "t", "{}", ["b"])] * 2 + [(1, "b", None, None, None, None)], CALLS).selectExpr("*", "1 AS level", "2 AS status", "3 AS c", "4 AS content")
    results = spark.createDataFrame([(1, "a", 2, None), (1, "b", None, "x"), (None, "a", 1, "x"), (1, None, 1, "x")], RESULTS).selectExpr("*", "1 AS late", "2 AS r")
    out = toolcalls.link_tool_calls(calls, results, spark.createDataFrame([("t", "{}"), (None, "{}")], "name string, schema string"))
    got = {(r.call_id, r.status): (r.level, r.errors) for r in out.collect()}
    assert got == {("a", "linked"): (1, None), ("b", "no_result"): (0, "$: not JSON"), ("b", "orphan_result"): (None, None)}


@pytest.mark.parametrize("char", [" ", "a", "7", "-"])
def test_token_counts_of_millions_of_equal_characters(char):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in (char * 5_000_000, char * 60_000 + "b c" + char * 49_999 + " x"):
        assert tokens.counter(path)(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_rule_hosts_are_lowered_as_url_hosts_are(spark):
    pages = spark.createDataFrame([(1, "http://É.com/x"), (1, "http://É.com/x"), (2, "http://é.COM/x"), (3, "http://a.com/" + "y" * 200_000), (None, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("É.Com", "/", "block"), ("a.com", "/yy", "allow"), ("a.com", "/yy", "block")], "host string, path string, verdict string")
    out = sorted(((r.page_id or 0, r.rule, r.verdict) for r in urlrules.apply_rules(pages, rules).collect()), key=repr)
    assert out == sorted([(1, "É.Com/", "block"), (1, "É.Com/", "block"), (2, None, "allow"), (3, "a.com/yy", "block"), (0, None, "allow")], key=repr)


def test_many_bounds():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    bounds = sorted(["b", "b", "d", "f.x.", "f.x.", "f.x."] + [f"k{i:03}" for i in range(100)])
    keys = ["a", "b", "c", "f.x.", "g", "k050", "k0505", "z"]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", urlrules._below(bounds, F.col("key"), False).alias("low"), urlrules._below(bounds, F.col("key"), True).alias("high")).collect()
    assert [(r.low, r.high) for r in rows] == [(sum(b < k for b in bounds), sum(b <= k for b in bounds)) for k in keys]


def plain_copies(doc_id, rate):
    u = int(hashlib.md5(f"{mixing.SEED}|{doc_id}|1".encode()).hexdigest()[:13], 16) / 16**13
    n, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_pipeline_equals_a_plain_one(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    rows = documents(300, 61)
    write(spark, rows, tmp_path / "documents.parquet")
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = [r for r, (kept, _) in zip(rows, plain_kept(rows), strict=True) if kept]
    least = linededup.MIN_CHARS
    gone = {(i, k) for i, k, *_ in slow_lines([(i, "\n".join(x if len(x.strip(" \t\r")) >= least else "" for x in t.split("\n"))) for i, t, _, _ in docs], least)}
    docs = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), lang, source) for i, t, lang, source in docs]
    worded = [(i, t) for i, t, _, _ in docs if t.split()]
    group = exact_words(worded)
    empty = min((i for i, t, _, _ in docs if not t.split()), default=None)
    docs = [r for r in docs if group.get(r[0], empty) == r[0]]
    sizes = {s: sum(r[3] == s for r in docs) for s in {r[3] for r in docs}}
    weights = {s: n**mixing.ALPHA for s, n in sizes.items()}
    rate = {s: weights[s] / sum(weights.values()) * len(docs) / n for s, n in sizes.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, tuple(library.encode(t))) for i, t, _, s in docs for _ in range(plain_copies(i, rate[s])))
    assert got == want and len(got) > 100


def exact_words(docs, k=nearcopies.SHINGLE):
    """As exact_components, with texts of fewer words than a shingle as one shingle, and A-Z lower-cased."""
    sets = [{tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for w in (t.lower().split() for _, t in docs)]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return {docs[a][0]: docs[c][0] for a, c in enumerate(components_of(len(docs), links))}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    words = " ".join(f"word{k}" for k in range(30))
    other = " ".join(f"thing{k}" for k in range(30))
    rows = [(1, words, "en", "a"), (1, words, "en", "a"), (None, words + " more", None, None), (None, other, "en", None), (None, other, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "five words are too few", "en", "a")]
    docs = write(spark, rows, tmp_path / "documents.parquet")
    judged = corpus_pipeline.quality(spark, docs, "")
    assert sorted(r.text for r in judged.collect()) == sorted([words, words, words + " more", other, other])
    near = corpus_pipeline.near(spark, docs.where("doc_id IS NULL OR doc_id < 2"), "").collect()
    assert sorted((r.doc_id, r.text) for r in near if r.doc_id) == [(1, words)]
    assert sorted(r.text for r in near if r.doc_id is None) == ["five words are too few", other]
    write(spark, [], tmp_path / "none" / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert exact_components([(0, "a b c d e f"), (1, "a b c d e f")]) == {0: 0, 1: 0}
