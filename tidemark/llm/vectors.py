"""Embedding near-dedup: a forest of random-projection trees, exact cosines within leaves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, hash_bucket, store, table
from tidemark.llm.simhash import stars

COSINE = 0.9
TREES = 6
#: Vectors that a leaf is meant to hold.
LEAF = 4096
#: Unit vectors whose projection lies within this of a split go to both sides.
SPILL = 0.03
#: About so many distinct vectors, at most twice as many, shape the trees; fewer if they are long.
SAMPLE = 20_000
#: Numbers in all vectors of the sample, about.
SAMPLE_NUMBERS = 4_000_000
#: A node with fewer vectors of the sample is parted blindly, at their mean.
LEAST = 16
SEED = 10
_TREE = 2**32


@lru_cache(1 << 14)
def _direction(seed: int, dim: int) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal(dim)
    return x / np.linalg.norm(x)


class Forest:
    """Trees over unit vectors of one dimension.

    A node splits at a gap near the median of the sample's projections on a
    random direction; of a few directions the one with the fewest points near
    its gap is taken. Projections of a point to within SPILL of the gap put it
    on both sides. Where the sample gives out before a leaf is small enough,
    further splits are blind, so that leaves don't grow with the input. Nodes hold
    their directions' seeds, so a tree's size depends on its leaves alone.
    """

    def __init__(self, sample: np.ndarray, total: int, *, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = SEED) -> None:
        self.spill, self.leaf, self.dim = spill, leaf, sample.shape[1]
        self.trees: list[tuple[list, int]] = []
        for t in range(trees):
            rng = np.random.default_rng([seed, t, self.dim])
            nodes: list = []
            self.leaves = 0
            root = self._grow(sample, float(total), rng, nodes, 0)
            self.trees.append((nodes, root))
            if root < 0:  # everything is one leaf: more trees would repeat it
                break

    def _grow(self, points: np.ndarray, total: float, rng: np.random.Generator, nodes: list, depth: int) -> int:
        best = None
        if total > self.leaf and depth < 60:
            for _ in range(4 if len(points) >= LEAST else 1):
                seed = int(rng.integers(2**62))
                p = np.sort(points @ _direction(seed, self.dim))
                if len(points) < LEAST:
                    best = (0, seed, float(p.mean()) if len(p) else 0.0)
                    break
                cuts = p[int(0.35 * len(p)) : int(0.65 * len(p)) + 1]
                near = np.searchsorted(p, cuts + self.spill, "right") - np.searchsorted(p, cuts - self.spill)
                at = int(np.argmin(near))
                if best is None or near[at] < best[0]:
                    best = (near[at], seed, float(cuts[at]))
        if best is None or best[0] > 0.9 * len(points):  # a ball that splits don't part: its leaf is cut into blocks
            self.leaves += 1
            return -self.leaves
        _, seed, cut = best
        p = points @ _direction(seed, self.dim)
        share = float((p <= cut).mean()) if len(points) >= LEAST else 0.5
        place = len(nodes)
        nodes.append(None)
        left = self._grow(points[p <= cut], total * share, rng, nodes, depth + 1)
        right = self._grow(points[p > cut], total * (1 - share), rng, nodes, depth + 1)
        nodes[place] = (seed, cut, left, right)
        return place

    def place(self, points: np.ndarray) -> list[list[int]]:
        """The codes, ascending, of all leaves of each unit vector: the tree's number times 2^32 plus the leaf's."""
        codes: list[list[int]] = [[] for _ in range(len(points))]
        for t, (nodes, root) in enumerate(self.trees):
            todo = [(root, np.arange(len(points)))]
            found: list[tuple[np.ndarray, int]] = []
            while todo:
                at, rows = todo.pop()
                if not len(rows):
                    continue
                if at < 0:
                    found.append((rows, t * _TREE - at))
                    continue
                seed, cut, left, right = nodes[at]
                p = points[rows] @ _direction(seed, self.dim)
                todo.append((left, rows[p <= cut + self.spill]))
                todo.append((right, rows[p >= cut - self.spill]))
            for rows, code in sorted(found, key=lambda x: x[1]):
                for r in rows.tolist():
                    codes[r].append(code)
        return codes


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _earlier_bits(codes: list[list[int]], code: int) -> np.ndarray:
    """Each row's leaves before ``code`` as bits: two rows met before if they share one."""
    known: dict[int, int] = {}
    for own in codes:
        for c in own:
            if c < code:
                known.setdefault(c, len(known))
    bits = np.zeros((len(codes), max(1, -(-len(known) // 64))), np.uint64)
    for i, own in enumerate(codes):
        for c in own:
            if c < code:
                k = known[c]
                bits[i, k // 64] |= np.uint64(1 << (k % 64))
    return bits


def _compare(group: pa.Table, cosine: float) -> pa.Table:
    """Per vector of one leaf (or one pair of its blocks): rows linked that no earlier leaf counts, and a star edge."""
    code, low, high = (group.column(x)[0].as_py() for x in ("code", "low", "high"))
    rep, n, block = (group.column(x).to_numpy() for x in ("rep", "n", "block"))
    flat = group.column("embedding").combine_chunks()
    x = unit_rows(np.asarray(flat.flatten()).reshape(len(rep), -1))
    bits = _earlier_bits(group.column("codes").to_pylist(), code)
    a, b = (np.arange(len(rep)),) * 2 if low == high else (np.nonzero(block == low)[0], np.nonzero(block == high)[0])
    links = np.zeros(len(rep), np.int64)
    left, right = [], []
    for s in range(0, len(a), 512):
        part = a[s : s + 512]
        i, j = np.nonzero(x[part] @ x[b].T >= cosine)
        i, j = part[i], b[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        fresh = ~((bits[i] & bits[j]) != 0).any(axis=1)
        np.add.at(links, i[fresh], n[j[fresh]])
        np.add.at(links, j[fresh], n[i[fresh]])
        left.append(i)
        right.append(j)
    left, right = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    star = rep.copy()
    moved, top = stars(len(rep), left, right, rep)
    star[moved] = rep[top]
    out = (links > 0) | (star != rep)
    return pa.table({"rep": rep[out], "star": star[out], "links": links[out]})


def similar_vectors(vectors: DataFrame, *, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding (array of float or double; more columns are
    ignored). Links are pairs of cosine >= ``cosine`` in double precision that
    share a leaf of some tree; n_links counts the other vectors linked directly,
    component_id is the smallest vec_id reachable, kept says that it is the row's own.

    The trees are fitted on a bounded hash sample; all vectors are placed (those
    of lengths that the sample lacks in one leaf, which is cut into blocks). Equal
    vectors are compared once, with their number of rows. A pair that shares
    several leaves is counted in the first only, so counts and components leave
    each leaf as one row per vector, never as pairs. A leaf that turns out
    larger than meant is cut into blocks that meet pairwise.

    Null or zero vectors and those with null or non-finite components link with
    nothing; so do rows without vec_id (component_id null, kept false).
    Vectors of different lengths never link. Repeated rows count as other
    vectors; rows that share a vec_id and differ are one node, with the links of all. An empty table gives an empty result.
    """
    value = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(value, lambda v: v != 0.0)
    marked = vectors.select("vec_id", "embedding", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False)).alias("sound"))
    distinct = store(marked.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    lengths = distinct.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    step = max(1, lengths[0] // sample, (lengths[1] or 0) // SAMPLE_NUMBERS)
    picked = distinct.where(hash_bucket(step, "rep") == 0).select("embedding").toArrow().column(0).combine_chunks()
    dims = np.asarray(pc.list_value_length(picked))
    asked = sorted(set(dims.tolist()))
    sizes = dict(distinct.groupBy(F.size("embedding").alias("dim")).count().where(F.col("dim").isin(asked)).collect()) if asked else {}  # one row per length in the sample
    of_dim = lambda d: np.asarray(picked.filter(pa.array(dims == d)).flatten()).reshape(-1, d)
    forests = {d: Forest(unit_rows(of_dim(d)), sizes[d], trees=trees, leaf=leaf, spill=spill) for d in asked}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            codes: list[list[int]] = [[1]] * len(rows)
            for d in {len(v) for v in rows} & forests.keys():
                at = [i for i, v in enumerate(rows) if len(v) == d]
                for i, own in zip(at, forests[d].place(unit_rows(np.array([rows[i] for i in at]))), strict=True):
                    codes[i] = own
            dims = pa.array([len(v) for v in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64())), dims], names=["embedding", "rep", "n", "codes", "dim"])

    kind = marked.schema["embedding"].dataType.simpleString()
    placed = store(distinct.mapInArrow(place, f"embedding {kind}, rep bigint, n bigint, codes array<bigint>, dim int"), "leaves")
    rows = placed.select("embedding", "rep", "n", "codes", "dim", F.explode("codes").alias("code"))
    width = 2 * leaf
    blocks = placed.select("dim", F.explode("codes").alias("code")).groupBy("dim", "code").agg(F.ceil(F.count("*") / width).cast("int").alias("blocks"))
    sized = rows.join(blocks, ["dim", "code"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    dealt = sized.withColumn("pair", F.explode(met)).select("dim", "code", "embedding", "rep", "n", "codes", "block", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"))
    found = store(dealt.groupBy("dim", "code", "low", "high").applyInArrow(lambda g: _compare(g, cosine), "rep bigint, star bigint, links bigint"), "links")
    groups = components(found.select(F.col("rep").alias("a"), F.col("star").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    resolved = distinct.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    resolved = resolved.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    key = F.when(F.col("sound"), F.col("embedding"))
    out = marked.withColumn("_key", key).join(resolved.withColumnRenamed("embedding", "_key"), "_key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
