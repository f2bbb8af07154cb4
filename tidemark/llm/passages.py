"""Substring dedup: hashed units of text, the earliest occurrence kept, later repeats returned with their offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import own_name, release, store, table

#: Least words of a run of whole repeated units that is removed: 1 removes every repeated unit.
MIN_WORDS = 1
#: What the query asks for. Shorter runs of whole sentences (a greeting, a licence line, "Read more.") repeat in clean documents too.
QUERY_MIN_WORDS = 30
#: Every passage of so many words that comes earlier is removed, wherever in its sentences it starts and ends.
PASSAGE = 50
#: Words of an anchor: of the runs of so many words in a passage, the one with the least hash.
ANCHOR = 20
_BREAK = re.compile(r"[.!?]+\s+|\n+")
_UNITS = 2**32
_LAST_DOC = 2**63 - 1
RANK = "decimal(38,0)"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Characters (about) whose words are hashed together.
_SEGMENT = 1 << 17


def with_units(docs: DataFrame) -> DataFrame:
    """One row per unit: doc_id, text_hash, unit, start, end, word, words, digest."""
    schema = docs.select("doc_id").schema.add("text_hash", "long").add("unit", "integer").add("start", "integer").add("end", "integer").add("word", "integer").add("words", "integer").add("digest", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text, unit, start, end, word, words, digest = _units(part.column(2).to_pylist())
                places = pa.array(text)
                numbers = [pa.array(x.astype(np.int32)) for x in (unit, start, end, word, words)]
                digests = pa.Array.from_buffers(pa.binary(16), len(text), [None, pa.py_buffer(np.ascontiguousarray(digest))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(places), part.column(1).take(places), *numbers, digests], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


@lru_cache(8)
def _powers(size: int, base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base)]))


def _rolling(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each run of ``size`` words, by differences of one running sum."""
    room = max(1 << 16, 1 << len(words).bit_length())
    back = np.uint64(pow(int(base), -1, 2**64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(room, base)[: len(words)])])
    return _mixed((total[size:] - total[:-size]) * _powers(room, back)[: len(words) - size + 1])


@lru_cache(1)
def _spaces() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x3100)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _edges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end: as str.split() has them."""
    space = np.ones(len(points) + 2, np.bool_)
    np.take(_spaces(), points, out=space[1:-1], mode="clip")
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def _joined_words(texts: list[str], joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of texts joined by line feeds, and where each text begins; offsets count code points.

    A hash is a polynomial over the lower-cased word's characters, a difference
    of running sums over all texts together, mixed with its length.
    """
    starts, ends = _edges(_points(joined))
    low = _points(joined.lower())
    begin, stop = (starts, ends) if len(low) == len(joined) else _edges(low)  # a few letters have longer lower cases
    hashes = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(stop, begin[at] + _SEGMENT, "right")))
        first, last = begin[at], stop[to - 1]
        room = max(1 << 16, 1 << int(last - first).bit_length())
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(low[first:last].astype(np.uint64) * _powers(room, _BASES[0])[: last - first], out=total[1:])
        back = _powers(room, np.uint64(pow(int(_BASES[0]), -1, 2**64)))
        own, end = begin[at:to] - first, stop[at:to] - first
        hashes[at:to] = _mixed((total[end] - total[own]) * back[own] + (end - own).astype(np.uint64) * _BASES[1])
        at = to
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return starts, ends, hashes, offsets


def _words(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, starts, ends) of the words of each text."""
    texts = [t or "" for t in texts]
    starts, ends, hashes, offsets = _joined_words(texts, "\n".join(texts))
    bounds = np.searchsorted(starts, offsets)
    return [(hashes[i:j], starts[i:j] - offset, ends[i:j] - offset) for i, j, offset in zip(bounds[:-1], bounds[1:], offsets[:-1], strict=True)]


def _units(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(text, unit, start, end, word, words, digest) of each sentence of each text; lines end sentences too.

    Offsets count code points, ``word`` the words before it, units those with
    words. A digest is two polynomials over the hashes of the lower-cased words.
    """
    texts = [t or "" for t in texts]
    joined = "\n".join(texts)
    starts, _, hashes, offsets = _joined_words(texts, joined)
    cuts = np.array([(m.start() + len(m[0].rstrip()), m.end()) for m in _BREAK.finditer(joined)], np.int64).reshape(-1, 2)
    begin, stop = np.append(0, cuts[:, 1]), np.append(cuts[:, 0], len(joined))
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    some = last > first
    begin, stop, first, last = begin[some], stop[some], first[some], last[some]
    text = np.searchsorted(offsets, starts[first], "right") - 1
    opening = np.flatnonzero(np.diff(text, prepend=-1))
    begin[opening] = offsets[text[opening]]  # white space before the first unit belongs to it
    unit = np.arange(len(text)) - np.repeat(opening, np.diff(opening, append=len(text)))
    halves = []
    for words, base in ((hashes, _BASES[0]), (_mixed(hashes), _BASES[1])):
        sums = np.empty(len(first), np.uint64)
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(last, first[at] + _SEGMENT, "right")))
            low, high = first[at], last[to - 1]
            room = max(1 << 16, 1 << int(high - low).bit_length())
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(words[low:high] * _powers(room, base)[: high - low], out=total[1:])
            i, j = first[at:to] - low, last[at:to] - low
            sums[at:to] = _mixed((total[j] - total[i]) * _powers(room, np.uint64(pow(int(base), -1, 2**64)))[i] + (j - i).astype(np.uint64))
            at = to
        halves.append(sums)
    before = first - np.searchsorted(starts, offsets)[text]
    return text, unit, begin - offsets[text], stop - offsets[text], before, last - first, np.stack(halves, axis=1)


def units(text: str) -> list[tuple[int, int, int, int, bytes]]:
    """(start, end, word, words, digest) of each unit of one text."""
    _, _, start, end, word, words, digest = _units([text])
    return [(*row, d.tobytes()) for *row, d in zip(start.tolist(), end.tolist(), word.tolist(), words.tolist(), digest, strict=True)]


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, context, word, n) of each anchor: it is the one of n passages, the first of which starts at ``word``.

    Equal passages have equal anchors at equal places, so a passage whose anchor
    comes once in all documents is repeated nowhere. ``context`` hashes all words
    that passages with this anchor can hold: where it is equal, all n passages are.
    """
    hashes = _rolling(words, ANCHOR, _BASES[0])
    # The least upper half counts, the first of equal ones; doubling spans give the minimum of each PASSAGE - ANCHOR + 1.
    least = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    left, span = PASSAGE - ANCHOR, 1
    while left:
        step = min(span, left)
        least = np.minimum(least[:-step], least[step:])
        left, span = left - step, span + step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    word = np.flatnonzero(np.diff(at, prepend=-1))
    at, n = at[word], np.diff(word, append=len(at))
    # Zeros stand for what lies beyond the text.
    padding = np.zeros(PASSAGE - ANCHOR, np.uint64)
    context = _rolling(np.concatenate([padding, words, padding]), 2 * PASSAGE - ANCHOR, _BASES[1])[at]
    return hashes[at], context, word, n


def with_anchors(docs: DataFrame) -> DataFrame:
    """One row per anchor: doc_id, text_hash, anchor, context, word, n, start, end (of its n passages together)."""
    schema = docs.select("doc_id").schema.add("text_hash", "long").add("anchor", "long").add("context", "long").add("word", "integer").add("n", "integer").add("start", "integer").add("end", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, found = [], []
                for i, (words, starts, ends) in enumerate(_words(part.column(2).to_pylist())):
                    if len(words) >= PASSAGE:
                        anchor, context, word, n = _anchors(words)
                        numbers = (word, n, starts[word], ends[word + n + PASSAGE - 2])
                        found.append((anchor.view(np.int64), context.view(np.int64), *(x.astype(np.int32) for x in numbers)))
                        row.append(np.full(len(anchor), i))
                if row:
                    places = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(places), part.column(1).take(places), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def with_windows(docs: DataFrame) -> DataFrame:
    """One row per passage of PASSAGE words in ``ranges``, (word, n) each: doc_id, text_hash, word, start, end, h1, h2.

    docs: doc_id, text_hash, text, ranges.
    """
    schema = docs.select("doc_id", "text_hash").schema.add("word", "integer").add("start", "integer").add("end", "integer").add("h1", "long").add("h2", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, starts, ends = _words([batch.column(2)[i].as_py()])[0]
                first, n = (batch.column(3)[i].values.field(k).to_numpy() for k in (0, 1))
                own = np.unique(np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                both = [_rolling(w, PASSAGE, b)[own].view(np.int64) for w, b in ((words, _BASES[0]), (_mixed(words), _BASES[1]))]
                numbers = [x.astype(np.int32) for x in (own, starts[own], ends[own + PASSAGE - 1])]
                at = pa.array(np.full(len(own), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, (*numbers, *both))], names=schema.names)

    return docs.select("doc_id", "text_hash", "text", "ranges").mapInArrow(run, schema)


def _rank(place: str) -> Column:
    return (F.coalesce("doc_id", F.lit(_LAST_DOC)).cast(RANK) * F.lit(_UNITS).cast("decimal(11,0)") + F.col(place)).cast(RANK)


def _with_first(rows: DataFrame, key: list[str], place: str) -> DataFrame:
    """The rows whose key comes at several ranks, and ``first``, the least of them."""
    firsts = rows.groupBy(*key).agg(F.min(_rank(place)).alias("first"), F.max(_rank(place)).alias("last")).where("first < last").drop("last")
    return rows.join(store(firsts, "firsts"), key)  # joined from files, both sides are exchanged, and a frequent key's partition can be split


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Runs of passages of PASSAGE words that each equal an earlier one: doc_id, text_hash, word, stop, start, end, first.

    Anchors whose context came before are settled by one row each; the passages
    of the first of each context are hashed one by one, where their anchor has
    several contexts.
    """
    anchors = store(with_anchors(docs), "anchors")
    often = anchors.groupBy("anchor").agg(F.count("*").alias("_n"), (F.min("context") < F.max("context")).alias("several")).where("_n > 1").drop("_n")
    shared = store(anchors.join(store(often, "often"), "anchor"), "shared")
    release(anchors)
    firsts = store(shared.groupBy("anchor", "context").agg(F.min(_rank("word")).alias("first")), "firsts")
    met = store(shared.join(firsts, ["anchor", "context"]).drop("anchor", "context"), "met")
    release(shared)
    release(firsts)
    place = ["doc_id", "text_hash", "word"]
    later = met.where(_rank("word") > F.col("first")).select(*place, (F.col("word") + F.col("n") + PASSAGE - 1).alias("stop"), "start", "end", "first")
    ranges = met.where(F.col("several") & (_rank("word") == F.col("first"))).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.collect_set(F.struct("word", "n")).alias("ranges"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(store(ranges, "ranges"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")))
    single = _with_first(store(with_windows(texts), "windows"), ["h1", "h2"], "word").where(_rank("word") > F.col("first"))
    return later.unionByName(single.select(*place, (F.col("word") + PASSAGE).alias("stop"), "start", "end", "first"))


def _joined(hits: list[np.ndarray], min_words: int) -> tuple[np.ndarray, ...]:
    """(start, end, n_units, n_words, first) of each passage to remove from one text; ``first`` is a place in hits.

    hits: word, stop, start, end, unit; unit is -1 for runs of windows.
    """
    word, stop, start, end, unit = hits
    units = np.argsort(unit, kind="stable")
    units = units[np.searchsorted(unit[units], 0) :]
    cut = np.flatnonzero(unit < 0)
    if len(units):
        runs = np.flatnonzero(np.diff(unit[units], prepend=-9) != 1)
        words = np.add.reduceat((stop - word)[units], runs)
        cut = np.concatenate([cut, units[np.repeat(words >= min_words, np.diff(runs, append=len(units)))]])
    cut = cut[np.lexsort((unit[cut], word[cut]))]
    reached = np.maximum.accumulate(stop[cut])
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(cut)), np.bool_), word[cut][1:] > reached[:-1]]))
    last = np.append(at[1:], len(cut))[: len(at)] - 1
    first = cut[at]
    within = np.searchsorted(word[first], word[units], side="right") - 1
    within = within[(within >= 0) & (stop[units] <= np.append(reached[last], -1)[within])]
    return start[first], np.maximum.accumulate(end[cut])[last], np.bincount(within, minlength=len(at)), reached[last] - word[first], first


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage to remove: doc_id, text_hash, start, end, n_units, n_words, first_doc_id.

    docs: doc_id, text (more columns are ignored). Words are compared lower-cased
    with white space collapsed. Two things are removed, joined where they touch:
    each run of PASSAGE words that equals an earlier run by (doc_id, position),
    whether or not it starts or ends a sentence, and runs of adjacent repeated
    units (sentences and lines) with ``min_words`` words or more (by default every repeated unit). Offsets are in
    code points of the original text; n_units counts the repeated units wholly
    within; first_doc_id holds the earliest occurrence of what the passage
    starts with.

    A null text has no units. Documents without doc_id come last; units of
    equal rank (repeated rows) do not precede each other. Digests are counted
    with map-side combine, and a digest's occurrences are joined back, which
    splits where one is frequent. An empty table gives an empty result.
    """
    rows = store(with_units(docs), "units")
    hits = _with_first(rows, ["digest"], "unit").where(_rank("unit") > F.col("first"))
    hits = store(hits.select("doc_id", "text_hash", "word", (F.col("word") + F.col("words")).alias("stop"), "start", "end", "first", "unit"), "hits")
    release(rows)
    hits = hits.unionByName(repeated_windows(docs).withColumn("unit", F.lit(-1)))
    doc = F.floor(F.col("first") / F.lit(_UNITS).cast("decimal(11,0)"))
    hit = F.struct("word", "stop", "start", "end", "unit", F.when(doc < _LAST_DOC, doc.cast("bigint")).alias("first_doc_id"))
    of_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(hit).alias("hits"))
    schema = docs.select("doc_id").schema.add("text_hash", "long").add("start", "integer").add("end", "integer").add("n_units", "long").add("n_words", "long").add("first_doc_id", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rest, firsts = [], [], []
            for i in range(batch.num_rows):
                own = batch.column(2)[i].values
                found = _joined([own.field(k).to_numpy() for k in range(5)], min_words)
                if len(found[0]):
                    row.append(np.full(len(found[0]), i))
                    rest.append(found[:4])
                    firsts.append(own.field(5).take(pa.array(found[4])))
            if rest:
                places = pa.array(np.concatenate(row))
                columns = [pa.array(np.concatenate(x).astype(kind)) for x, kind in zip(zip(*rest, strict=True), (np.int32, np.int32, np.int64, np.int64), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), *columns, pa.concat_arrays(firsts)], names=schema.names)

    return of_doc.mapInArrow(run, schema)


def remove_passages(docs: DataFrame, *, min_words: int = MIN_WORDS, removed: str = "removed") -> DataFrame:
    """docs with repeated passages cut out of text; the column ``removed``, which docs mustn't have, holds their (start, end) in the original.

    Other columns may have any names. Rows that share doc_id and text are cut alike.
    """
    if removed in docs.columns:
        raise ValueError(f"docs has a column {removed}; name another for the places cut out")
    key, own = own_name(docs, "_doc"), own_name(docs, "_hash")
    spans = repeated_passages(docs, min_words=min_words).groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(f"{own}_")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(removed))
    joined = docs.withColumn(own, F.xxhash64("text")).join(spans, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(f"{own}_")), "left")
    state = F.aggregate(
        removed,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept")),
        lambda s, r: F.struct(r["end"].alias("at"), F.array_append(s["kept"], F.substring(F.col("text"), s["at"] + 1, r["start"] - s["at"])).alias("kept")),
        lambda s: F.concat(F.array_join(s["kept"], ""), F.substring(F.col("text"), s["at"] + 1, F.char_length("text"))),
    )
    return joined.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(state)).select(*docs.columns, removed)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Runs of whole repeated sentences and lines of QUERY_MIN_WORDS words or more, and every repeated run of PASSAGE words."""
    return repeated_passages(table(spark, sf_dir, "documents"), min_words=QUERY_MIN_WORDS).drop("text_hash")
