"""Near copies at a stated similarity: candidates by SimHash trees and MinHash bands, each decided on the shingle sets.

Two texts whose word-shingle sets are 0.8 alike differ in about ten of 64
SimHash bits, where unrelated texts differ in 32 give or take 4: no tree prunes at
such a radius. The tree finds pairs within a few bits; below that, the shingles'
MinHash signatures are banded. Neither accepts a pair: the exact Jaccard
similarity of the two shingle sets does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, release, store
from tidemark.llm.simhash import RADIUS, shingle_hashes, majority, near_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
#: Pairs whose signatures are so much less alike than asked aren't compared: four standard deviations (0.037 each) at 0.8, which
#: 2 in 100,000 of the pairs sought exceed, where 2 in 1,000 share no band.
SLACK = 0.15
#: Members of a band group that those are compared with that its first didn't settle: the first in as many orders by hash.
ORDERS = 4
#: Members of a band group in one block, of which two meet in a task.
BLOCK = 2048
SEED = 5


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(hashes: np.ndarray) -> bytes:
    """The least of the hashes under each of BANDS * ROWS permutations."""
    times, plus = _multipliers()
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 2048):
            low = np.minimum(low, (short[at : at + 2048, None] * times + plus).min(axis=0))
    return low.tobytes()


def with_sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, sketch, digest, size): SimHash fingerprint, MinHash signature, and digest and size of the shingle set; sketch and digest are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32)
            sketches, digests = [None] * batch.num_rows, [None] * batch.num_rows
            for i, hashes in shingle_hashes(batch.column(1).to_pylist(), shingle):
                fps[i] = majority(hashes)
                sketches[i] = signature(hashes)
                own = np.unique(hashes)
                sizes[i], digests[i] = len(own), xxhash.xxh128_digest(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), pa.array(sketches, pa.binary()), pa.array(digests, pa.binary()), pa.array(sizes)], names=["doc_id", "fp", "sketch", "digest", "size"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fp", "long").add("sketch", "binary").add("digest", "binary").add("size", "integer"))


def with_shingles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(unit, digest, shingles): the sorted shingle set of each text with words. docs: unit, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, sets = [], []
                for i, hashes in shingle_hashes(part.column(1).to_pylist(), shingle):
                    row.append(i)
                    sets.append(np.unique(hashes).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array([xxhash.xxh128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["unit", "digest", "shingles"])

    return docs.select("unit", "text").mapInArrow(run, "unit bigint, digest binary, shingles binary")


def shingle_sets(docs: DataFrame, units: DataFrame, asked: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(unit, shingles), stored: the shingle set of each unit of ``asked``. docs: doc_id, text; units: unit, digest."""
    wanted = store(asked.select("unit").distinct().join(units.select("unit", "digest"), "unit"), "asked")
    texts = docs.select(F.col("doc_id").alias("unit"), "text").join(wanted.select("unit").distinct(), "unit", "left_semi")
    return store(with_shingles(texts, shingle).join(wanted, ["unit", "digest"]).dropDuplicates(["unit", "digest"]).drop("digest"), "shingles")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of units whose shingle sets have a Jaccard similarity of ``similarity`` or more, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, np.bool_)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit[i] = both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(hit)) for c in (0, 1)], names=["a", "b"])

    pairs = store(pairs, "pairs")
    both = pairs.join(sets.select(F.col("unit").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("unit").alias("b"), F.col("shingles").alias("y")), "b")
    links = store(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "links")
    release(pairs)
    return links


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in (2, 3))
            hit = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    return run


def band_rows(units: DataFrame) -> DataFrame:
    """(rep, size, band, key): one row per band of each unit with words."""
    width = 4 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", width * i + 1, width)) for i in range(BANDS)))
    return store(units.where("sketch <> X''").select(F.col("unit").alias("rep"), "size", F.posexplode(keys).alias("band", "key")), "bands")


def _candidates(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(units.select(F.col("unit").alias("a"), F.col("sketch").alias("x")), "a").join(units.select(F.col("unit").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_alike(similarity - SLACK), "a bigint, b bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("rep <> leader").select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).distinct()


def leader_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a band group with its first, so that a group of copies makes no more pairs than members."""
    first = store(rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    return _ordered(rows.join(first, "key"))


def _open_groups(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(band, key, rep, size, part) of the members of band groups that are not all of one component, stored."""
    labels = components(links).withColumnRenamed("node", "rep")
    placed = store(rows.join(labels, "rep", "left").select("band", "key", "rep", "size", F.coalesce("component", "rep").alias("part")), "placed")
    mixed = store(placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key"), "mixed")
    return store(placed.join(mixed, "key"), "open")


def more_leader_pairs(open_: DataFrame) -> DataFrame:
    """Pairs of the members of open groups with a few more leaders that aren't of their component yet."""
    leaders = [F.min_by(F.struct("rep", "part"), F.xxhash64(F.lit(k), "rep")).alias(f"l{k}") for k in range(1, ORDERS + 1)]
    groups = store(open_.groupBy("key").agg(*leaders), "leaders")
    met = open_.join(groups, "key").select("rep", "part", F.explode(F.array(*(f"l{k}" for k in range(1, ORDERS + 1)))).alias("l"))
    return _ordered(met.where("l.part <> part").select("rep", F.col("l.rep").alias("leader")))


def remaining_pairs(open_: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a band group's members of different components whose sizes and signatures allow the similarity.

    A group is cut into blocks that meet pairwise in a task of their own; pairs
    are looked at as arrays there, and only those that may be near copies leave it,
    each from the first band that its members share.
    """
    least = similarity - SLACK
    sized = open_.join(store(open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks"), "key")
    placed = sized.join(units.select(F.col("unit").alias("rep"), "sketch"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    dealt = placed.withColumn("pair", F.explode(met)).select("key", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "band", "block", "rep", "size", "part", "sketch")

    def compare(group: pa.Table) -> pa.Table:
        rep, size, part, block = (group.column(c).to_numpy() for c in ("rep", "size", "part", "block"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(len(rep), -1)
        low, high, band = (group.column(c)[0].as_py() for c in ("low", "high", "band"))
        i, j = np.flatnonzero(block == low), np.flatnonzero(block == high)
        left, right = [], []
        for at in range(0, len(i), 64):
            rows = i[at : at + 64]
            fits = (part[rows][:, None] != part[j]) & (np.minimum(size[rows][:, None], size[j]) >= similarity * np.maximum(size[rows][:, None], size[j]))
            if low == high:
                fits &= rep[rows][:, None] > rep[j]
            x, y = np.nonzero(fits)
            x, y = rows[x], j[y]
            for k in range(0, len(x), 4096):
                same = sketch[x[k : k + 4096]] == sketch[y[k : k + 4096]]
                here = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band  # of the bands that a pair shares the first counts
                kept = here & (same.mean(axis=1) >= least)
                left.append(x[k : k + 4096][kept])
                right.append(y[k : k + 4096][kept])
        a, b = (np.concatenate([rep[v] for v in side]) if side else np.zeros(0, np.int64) for side in (left, right))
        return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})

    return dealt.groupBy("key", "low", "high").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id): groups of documents whose texts are near copies, by the smallest doc_id.

    docs: doc_id, text (more columns are ignored); texts may have any length.
    Texts without words form one group; a null doc_id has a null component.
    Repeated rows each return. Empty table: empty result.

    Equal shingle sets are one unit. Members of a band meet its first, then, where
    the band's members aren't one component, a few more of it, then each other;
    every pair is decided on the two sets, which are computed once.
    """
    marked = with_sketches(docs, shingle).withColumns({c: F.coalesce(c, F.lit(b"")) for c in ("sketch", "digest")})
    marked = store(marked, "sketches")
    units = store(marked.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("unit"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("size").alias("size")), "units")  # equal sets are one
    worded = units.where("sketch <> X''")
    by_fp = store(worded.groupBy("fp").agg(F.min("unit").alias("rep")), "distinct")
    same_fp = worded.join(by_fp, "fp").where("unit <> rep").select(F.col("unit").alias("a"), F.col("rep").alias("b"))
    rows = band_rows(units)
    exact = store(near_links(by_fp, radius=radius).unionByName(same_fp), "near")
    met = rows.join(store(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often"), "key")
    asked = met.select(F.col("rep").alias("unit")).union(exact.select("a")).union(exact.select("b"))
    sets = shingle_sets(docs, units, asked, shingle)
    links = verified(exact.unionByName(_candidates(leader_pairs(rows), units, similarity)).distinct(), sets, similarity)
    open_ = _open_groups(rows, links)
    links = links.unionByName(verified(_candidates(more_leader_pairs(open_), units, similarity), sets, similarity))
    # Pairs of a band group that aren't of one component yet are all decided; sets whose sizes differ more can't be so alike.
    open_ = _open_groups(open_.select("band", "key", "rep", "size"), links)
    rest = remaining_pairs(open_, units, similarity)
    groups = components(links.unionByName(verified(rest, sets, similarity)))
    labels = units.join(groups, F.col("unit") == F.col("node"), "left").select("digest", F.coalesce("component", "unit").alias("component_id"))
    return marked.join(store(labels, "labels"), "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
