"""Operators on documents: each against a plain version, and on nulls, empty and odd texts, repeats and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import linededup, mixing, nearcopies, passages, pieces, quality, simhash, tokens
from tidemark.llm.textstats import text_stats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, n int, key string, digest string, component string"


def frame(spark, texts, path):
    """Documents with columns whose names clash with the operators' own, read from files as in production."""
    rows = [(i, t, None if i == 1 else "en", None if i == 2 else "s", len(t or ""), 1, 1, "k", "d", "c") for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (None, "no id here at all"), (4, "x" * 5000 + " end"), (5, "é中 😀 \u00a0 b"), (6, "a b c d e f g h " * 300)]


@pytest.fixture
def odd(spark, tmp_path):
    return frame(spark, ODD, tmp_path / "odd")


@pytest.fixture
def none(spark, tmp_path):
    return frame(spark, [], tmp_path / "none")


def test_empty_tables(spark, none, tmp_path):
    import public_tokenizers

    model = pieces.Model(pieces.BPE, [("<unk>", 0.0, 2), ("a", -1.0, 1)], 0, [])
    for rows in (
        linededup.repeated_lines(none),
        linededup.dedup_lines(none),
        passages.repeated_passages(none),
        quality.quality_rules(none),
        mixing.poisson_mix(none),
        simhash.near_duplicates(none),
        nearcopies.near_copies(none),
        tokens.token_counts(none, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")),
        pieces.encode(none, model),
    ):
        assert rows.count() == 0


def slow_words(text, window=8):
    w = (text or "").split(" ")
    w = [x for part in w for x in part.split()]
    w = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = {}
    for i in range(len(w) - window + 1):
        runs.setdefault(tuple(w[i : i + window]), []).append(i)
    hit = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + window)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_text_stats_equal_a_plain_count():
    rng = random.Random(1)
    texts = [t for _, t in ODD] + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "é\u00a0", "\x0b", "\x1c"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        got = text_stats(t)[:5]
        want = slow_words(t)
        assert got == want if (t or "").strip(" \t\n\x0b\x0c\r") else got == (0,) * 5, t


def test_quality_keeps_plain_and_rejects_junk(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(25, 300)))) for i in range(400)]
    junk = [(1000 + i, " ".join(word() + "***" for _ in range(80))) for i in range(20)]
    out = {r.doc_id: r for r in quality.quality_rules(frame(spark, clean + junk, tmp_path / "q")).collect()}
    assert all(out[i].kept for i, _ in clean)
    assert not any(out[i].kept for i, _ in junk)
    assert all(out[i].n_symbols == 240 and not out[i].base_failed for i, _ in junk)


def test_quality_on_odd_rows(odd):
    out = quality.quality_rules(odd).collect()
    assert len(out) == len(ODD)
    assert not [r for r in out if r.kept]  # all are short or repeat themselves
    assert all(r.distance is None for r in out)  # too few for a fit


def test_chi_square():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality.chi2_cdf(9.2364, 5) == pytest.approx(0.9, abs=1e-4)


def test_mcd_ignores_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 1]], 800)
    bad = rng.normal(30, 1, (200, 2))
    rows = spark.createDataFrame([("g", [float(v) for v in x]) for x in np.vstack([good, bad])], "fit_key string, features array<double>")
    fit = quality.fit_outliers(rows, {"x": 0.01, "y": 0.01}).first()
    assert fit.centre == pytest.approx([1, 2], abs=0.2)
    cov = np.linalg.inv(np.array(fit.precision).reshape(2, 2))
    assert cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]) == pytest.approx(0.6, abs=0.1)
    # The consistency factor takes the quarter left out for tails of the good ones: too wide by at most that factor.
    assert all(0.7 < v < 1.8 for v in np.diag(cov))


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def slow_lines(docs, least):
    occ = [(i, k, line.strip(" \t\r").lower()) for i, t in docs if t is not None for k, line in enumerate(t.split("\n"))]
    occ = sorted(x for x in occ if x[2])
    out = set()
    for i, k, s in occ:
        before = [(j, m, int(s != u)) for j, m, u in occ if (j, m) < (i, k) and (s == u or min(len(s), len(u)) >= least and one_edit(s, u))]
        if before:
            j, m, _ = min(before)
            equal = any(e == 0 for _, _, e in before)
            out.add((i, k, j, m, 0 if equal else 1))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_line_dedup_equals_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(2, 24))) for _ in range(12)]

    def change(s):
        k = rng.randint(0, len(s))
        return rng.choice([s, s[:k] + "z" + s[k:], s[:k] + s[k + 1 :], s[:k] + "y" + s[k + 1 :], s[:k] + "zz" + s[k:], s.upper()])

    docs = [(i, "\n".join(change(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    got = linededup.repeated_lines(frame(spark, docs, tmp_path / "l"), min_chars=4)
    assert {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.edits) for r in got.collect()} == slow_lines(docs, 4)


def test_line_dedup_text_and_odd_rows(spark, odd, tmp_path):
    docs = frame(spark, [(0, "keep this line\nshort\nand another line"), (1, "AND ANOTHER LINE \nshort\nnew text is here"), (2, None), (3, "keep thiz line")], tmp_path / "d")
    out = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert out[0].text == "keep this line\nshort\nand another line"
    assert out[1].text == "new text is here" and out[1].n_chars == 16 and out[1].rank == 1
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(docs, min_exact=12).collect()}
    assert kept[1] == "short\nnew text is here"
    assert out[2].text is None and out[3].text == ""
    rows = linededup.dedup_lines(odd)
    assert rows.columns == odd.columns and rows.count() == len(ODD)
    assert {r.text for r in rows.collect()} == {t for _, t in ODD}  # rows that share a doc_id don't precede each other


def test_line_dedup_of_a_very_long_line(spark, tmp_path):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    docs = frame(spark, [(0, long), (1, long[:17_000] + "X" + long[17_000:]), (2, long[:9] + long[11:])], tmp_path / "long")
    assert [(r.doc_id, r.edits) for r in linededup.repeated_lines(docs).collect()] == [(1, 1)]


def test_passages(spark, odd, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(6))
    sentence = lambda: " ".join(word() for _ in range(12)).capitalize() + ". "
    shared = "".join(sentence() for _ in range(5))
    a, b = (" ".join(word() for _ in range(40)) + ". " for _ in range(2))
    docs = frame(spark, [(0, a + shared + "Tail one here."), (1, b + shared.upper() + "Other tail."), (2, sentence() * 1 + sentence()), (3, None)], tmp_path / "p")
    found = passages.repeated_passages(docs).collect()
    assert [(r.doc_id, r.first_doc_id, r.n_units, r.n_words) for r in found] == [(1, 0, 5, 60)]
    assert (b + shared)[found[0].start : found[0].end] == shared.rstrip()
    cut = {r.doc_id: r for r in passages.remove_passages(docs).collect()}
    assert cut[1].text == b + " Other tail." and [tuple(x) for x in cut[1].removed] == [(found[0].start, found[0].end)]
    assert cut[0].text == a + shared + "Tail one here." and cut[0].removed is None
    assert passages.remove_passages(odd).count() == len(ODD)


def slow_windows(docs, size):
    """The words of each document within a run of ``size`` words that comes earlier."""
    seen, out = set(), {i: set() for i, _ in docs}
    for i, t in docs:
        w = t.lower().split()
        for k in range(len(w) - size + 1):
            run = tuple(w[k : k + size])
            if run in seen:
                out[i].update(range(k, k + size))
            seen.add(run)
    return out


def test_passages_that_start_and_end_inside_sentences(spark, tmp_path):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(6)) + rng.choice(["", "", "", "", "", "", "", "", "", "", "", "", ".", "\n"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(30, 300)))) for i in range(10)]
    for i in range(10, 60):  # parts of earlier documents, also of those that are parts themselves, between new words
        text = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(docs)[1].split(" ")
            at = rng.randrange(len(w))
            text += [x.upper() for x in w[at : at + rng.choice([20, 49, 50, 51, 75, 120])]] + [word() for _ in range(rng.randint(1, 30))]
        docs.append((i, " ".join(text)))
    docs.append((60, "a b c d e f g h " * 20))
    want, texts, got = slow_windows(docs, 50), dict(docs), {i: set() for i, _ in docs}
    for r in passages.repeated_passages(frame(spark, docs, tmp_path / "w"), min_words=10**6).collect():
        before = len(texts[r.doc_id][: r.start].split())
        assert len(texts[r.doc_id][r.start : r.end].split()) == r.n_words and r.first_doc_id <= r.doc_id
        got[r.doc_id].update(range(before, before + r.n_words))
    assert sum(map(bool, want.values())) > 30 and got == want


def test_mixing_counts_follow_the_rates(spark, tmp_path):
    rows = [(i, f"t{i}", "en", "big" if i % 4 else "small", 1, 1, 1, "k", "d", "c") for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("big", 0.5), ("small", 0.5), ("gone", 1.0), (None, 3.0)], "source string, weight double")
    out = mixing.poisson_mix(docs, weights.where("source <> 'gone' AND source IS NOT NULL"))
    assert set(docs.columns) < set(out.columns)
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts["big"] == pytest.approx(2000, rel=0.1) and counts["small"] == pytest.approx(2000, rel=0.1)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.poisson_mix(docs.repartition(7), weights.where("source in ('big', 'small')")).collect()))
    large = mixing.poisson_mix(docs.where("doc_id < 20"), epochs=1000.0).count()  # means over 500 are drawn in parts
    assert large == pytest.approx(20_000, rel=0.05)


def test_mixing_on_odd_rows(odd):
    out = mixing.poisson_mix(odd, epochs=50.0)
    assert {r.source for r in out.collect()} == {"s", None}


def slow_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_a_plain_version():
    rng = random.Random(6)
    texts = [t for _, t in ODD] + [" ".join("".join(rng.choice("abÉ") for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    assert simhash.fingerprints(texts) == [slow_fingerprint(t, 3) for t in texts]


def components_of(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("shard", [40, 300, 8192])
def test_near_links_equal_brute_force(spark, shard):
    rng = np.random.default_rng(7)
    points = list(rng.integers(0, 2**63, 150, dtype=np.uint64))
    for p in points[:60]:
        for _ in range(8):
            q = int(p)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                q ^= 1 << int(b)
            points.append(np.uint64(q))
    points = np.unique(np.array(points, np.uint64))
    near = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    want = components_of(len(points), near)
    rows = spark.createDataFrame([(int(p), i) for i, p in enumerate(points.view(np.int64))], "fp bigint, rep bigint")
    from tidemark.llm.common import components

    found = {r.node: r.component for r in components(simhash.near_links(rows, shard=shard)).collect()}
    assert [found.get(i, i) for i in range(len(points))] == want


def test_near_duplicates_on_odd_rows(odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    zero = {r.doc_id for r in out if r.fingerprint == "0" * 16}
    assert zero == {0, 1, 2} and {r.component_id for r in out if r.doc_id in zero} == {0}
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert [r.component_id for r in out if r.doc_id == 3] == [3, 3]


def test_components_of_long_chains(spark):
    from tidemark.llm.common import components

    rows = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(200, 200)]
    out = {r.node: r.component for r in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert {out[i] for i in range(1, 61)} == {0} and {out[i] for i in range(101, 140)} == {100} and 200 not in out


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    from tidemark.llm import common

    rng = random.Random(6)
    chain = rng.sample(range(1000), 300)
    rows = [*zip(chain, chain[1:], strict=False), *((2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(150)), *((3000, 3000 + i) for i in range(50)), (4000, 4000)]
    want = {a: c for a, c in enumerate(components_of(4001, rows)) if a != c}
    edges = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5).cache()
    edges.count()
    jobs = {}
    for most in (common.MANY_EDGES, 20):  # in one task, and by contractions
        monkeypatch.setattr(common, "MANY_EDGES", most)
        spark.sparkContext.setJobGroup(f"components-{most}", "")
        found = common.components(edges)
        spark.sparkContext.setJobGroup("other", "")
        assert {r.node: r.component for r in found.collect() if r.node != r.component} == want
        jobs[most] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{most}"))
    few, many = jobs.values()
    assert few <= 6 < many


def test_near_copies_link_at_the_stated_similarity(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(20)]
    docs = []
    for k, words in enumerate(base):
        for c in range(4):
            own = list(words)
            for _ in range(2 * c):
                own[rng.randrange(len(own))] = word()
            docs.append((10 * k + c, " ".join(own)))
    out = {r.doc_id: r.component_id for r in nearcopies.near_copies(frame(spark, docs, tmp_path / "n")).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in docs}
    assert all(out[i] // 10 == i // 10 for i in out)  # nothing else is linked
    for i in out:  # a signature tells 0.8 to 0.037: pairs two deviations above it are certain enough to demand
        for j in out:
            if i // 10 == j // 10 and len(sets[i] & sets[j]) >= 0.875 * len(sets[i] | sets[j]):
                assert out[i] == out[j], (i, j)


def exact_components(docs, k=5):
    w = {i: t.split() for i, t in docs}
    sets = [{tuple(x[j : j + k]) for j in range(len(x) - k + 1)} for x in w.values()]
    n = len(sets)
    links = [(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    ids = list(w)
    return {ids[i]: ids[c] for i, c in enumerate(components_of(n, links))}


def test_near_copies_are_decided_by_their_shingle_sets(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(5))
    docs = []
    for k in range(60):  # pairs 0.79 to 0.66 alike: a signature takes some for 0.74 and more
        own = [word() for _ in range(300)]
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: 265 - k // 2] + [word() for _ in range(35 + k // 2)]))]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(frame(spark, docs, tmp_path / "j")).collect()}
    assert got == exact_components(docs)


def test_near_copies_that_are_alike_no_leader(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(5))
    shared, docs = [word() for _ in range(300)], []
    for k in range(150):  # twins 0.9 alike, all others 0.6
        own = shared + [word() for _ in range(100)]
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:-10] + [word() for _ in range(10)]))]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(frame(spark, docs, tmp_path / "k")).collect()}
    assert got == exact_components(docs)


def test_token_counts_and_cache(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [t for _, t in ODD] + ["a <|endoftext|> b", "it's  \u3000 x\u200b 12½ ٣ \r\n\t", "ǅ ʼn 𝒳 ꙮ"]
    docs = frame(spark, [*ODD, *((100 + i, t) for i, t in enumerate(texts[-3:]))], tmp_path / "t")
    cache = str(tmp_path / "cache")
    out = tokens.token_counts(docs, path, cache, limit=100)
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in out.collect()) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts})
    again = tokens.token_counts(docs.where("doc_id < 100 OR doc_id IS NULL").unionByName(docs.where("doc_id = 3")), path, cache)
    assert again.count() == len(ODD) + 2 and spark.read.parquet(cache).count() == stored  # only hits
    assert tokens.counter(public_tokenizers.path("piece_bpe_32k.model"))("ab c") > 0


def test_pieces_equal_the_library(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    model = pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for _, t in ODD] + ["  lead  trail  ", "x▁▁y ▁", "tab\tand\nline\x00", "Ab9/+" * 300, "aaaa" * 200, "<s> <0x41>", "a ", " "]
    docs = frame(spark, list(enumerate(texts)), tmp_path / "s")
    out = {r.doc_id: r for r in pieces.encoded(docs, model).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert out[i].ids == ids, t
        assert out[i].decoded == library.decode(ids)
        assert out[i].decoded == (t or "").replace("▁", " ")


def test_pieces_of_rows_that_share_an_id(odd):
    model = pieces.default_model()
    out = sorted(((r.doc_id, r.ids) for r in pieces.encode(odd, model).collect()), key=repr)
    whole = lambda t: [i for a in pieces.Cutter(model.bridges, 3).cut(pa.array([t], pa.string()))[0].to_pylist() for i in pieces.fold_text(model, a)]
    assert out == sorted(((i, whole(t)) for i, t in ODD), key=repr)


@pytest.mark.parametrize("char", [" ", "a", "7", "-"])
def test_a_word_of_a_million_characters(char):
    import public_tokenizers
    import sentencepiece

    model, text = pieces.default_model(), char * 1_000_000
    atoms = pieces.Cutter(model.bridges, 3).cut(pa.array([text]))[0].to_pylist()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [i for a in atoms for i in pieces.fold_text(model, a)] == library.encode(text)


def test_atoms_whose_neighbours_share_a_place():
    """Pairs that share a place in a small table make atoms longer, but never join texts or the character that parts lists."""

    class Small(pieces.Cutter):
        PLACES = 7

    model = pieces.default_model()
    texts = ["a\0b c\0\0d", "end", "", None, " lead"]
    atoms, counts = Small(model.bridges, 3).cut(pa.array(texts))
    assert counts.sum() == len(atoms) and counts.tolist()[2:4] == [0, 0]
    assert all(a == "\0" or "\0" not in a for a in atoms.to_pylist())
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert "".join(atoms.to_pylist()[at : at + n]) == (" " + text if text else "")
        at += n


def test_native_and_python_folds_agree(spark):
    """Random words over few letters hold many ties and overlaps; the native fold must give what merging gives."""
    model, rng = pieces.default_model(), random.Random(13)
    words = list({"".join(rng.choice(rng.choice(["etaonx", "ab", " e", "éß中a"])) for _ in range(rng.randint(1, 47))) for _ in range(1500)})
    got = {r.word: r.ids for r in pieces.word_ids(model, spark.createDataFrame([(w,) for w in words], "word string"), []).collect()}
    assert got == {w: pieces.fold_text(model, w) for w in words}


def test_viterbi_finds_the_best_path(spark):
    model = pieces.Model(pieces.UNIGRAM, [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -2.2, 1), ("bab", -3.3, 1), ("aa", -4.0, 1)], 0, [])
    rng = random.Random(9)
    words = {" " + "".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(40)} | {" aaaaaa"}
    score = {t.replace("▁", " "): s for t, s, kind in model.pieces if kind == 1}
    unknown = model.worst - pieces.UNKNOWN_PENALTY

    def best(chars):
        if not chars:
            return 0.0
        ways = [score[chars[:n]] + best(chars[n:]) for n in range(1, len(chars) + 1) if chars[:n] in score]
        return max(ways, default=None) if ways else unknown + best(chars[1:])

    got = {r.word: r.ids for r in pieces.word_ids(model, spark.createDataFrame([(w,) for w in words], "word string"), []).collect()}
    for w in words:
        total = sum(model.pieces[i][1] if i else unknown for i in got[w])
        assert total == pytest.approx(best(w)), w
        assert got[w] == pieces.fold_text(model, w)  # also where scores tie: aa = a a


def test_the_code_of_the_verdicts_is_short(spark, odd):
    def code(rows):
        return spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(rows._jdf.queryExecution().executedPlan())

    rows = quality.quality_rules(odd, keep=("text",)).where("kept").select("text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = code(rows.where("true"))
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 30_000  # bytes of a method, of which the driver holds all while it compiles
