"""What the operators share: tables, column names of their own, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import forget_later, release, shared_dir, store

__all__ = ["components", "forget_later", "hash_bucket", "own_name", "release", "shared_dir", "store", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def hash_bucket(n: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n))


#: Edges that one task takes at most (16 bytes each): so many or fewer are grouped in one, more are contracted by all.
MANY_EDGES = 1_000_000


def least_nodes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least): of the edges left-right, each node and the smallest one that it is connected with.

    Nodes point to smaller ones; each step points a node and what it points to
    at what lies two pointers behind a neighbour, so long chains take few steps.
    """
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = np.split(at, 2)
    to = np.arange(len(nodes))
    while True:
        second = to[to]
        following = second.copy()
        for x, y in ((u, v), (v, u)):
            low = second[y]
            np.minimum.at(following, to[x], low)
            np.minimum.at(following, x, low)
        if (following == to).all():
            return nodes, nodes[to]
        to = following


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not edges:
        return
    nodes, least = least_nodes(*(np.concatenate(x) for x in zip(*edges, strict=True)))
    moved = nodes != least
    out = pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(least[moved])], names=["node", "component"])
    for at in range(0, out.num_rows, 1 << 16):
        yield out.slice(at, 1 << 16)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a BIGINT, b BIGINT): (node, component), component the smallest node.

    Up to MANY_EDGES edges are grouped in one task, in two jobs. More go through
    alternating large-star and small-star contractions (Kiveris et al., 2014):
    each round is two aggregations with map-side combine and two joins, and the
    edge count never grows, so a hub costs no more than its own edges. Rounds are
    logarithmic in the longest chain, and end where few enough edges are left;
    ``max_rounds`` only guards against a fault. The smallest node of a component
    and nodes without an edge to another node do not appear.
    """

    def stored(e: DataFrame) -> tuple[DataFrame, tuple]:
        kept = store(e.where("a <> b").distinct(), "edges")
        seen = kept.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        return kept, tuple(seen)

    current, mark = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds):
        if mark[0] <= MANY_EDGES:
            found = store(current.coalesce(1).mapInArrow(_grouped, "node bigint, component bigint"), "components")
            release(current)
            return found
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Joined from files, both sides are exchanged, and a hub's partition can be split.
        low = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        following, new_mark = stored(small)
        release(current)
        release(low)
        current = following
        if new_mark == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new_mark
    raise RuntimeError("connected components did not settle")
