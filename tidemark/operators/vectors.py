"""Exact nearest neighbours of a stated set of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block, and queries of one group: each block meets each group in a task of its own.
BLOCK, GROUP = 8192, 4096


def _matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x, np.float64) for x in column.to_pylist()]


def _rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Values not below 0 to so many digits, halves up; NumPy's own rounds them to even."""
    if digits is None:
        return values
    scaled = values * 10.0**digits
    whole = np.floor(scaled)
    return np.where(np.isfinite(scaled), (whole + (scaled - whole >= 0.5)) / 10.0**digits, values)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, digits: int | None = None, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest other vectors of each query by Euclidean distance; of equals the smaller id.

    With ``digits``, distances are rounded to so many before they are compared,
    so those that look alike are equals. vectors, queries: vec_id, embedding. Vectors that are null, hold a null or
    have another length than the query are near nothing. Vectors are dealt into
    blocks and queries into groups; a task holds one of each, and k rows per
    query leave it, of which a second top-k keeps the best. So no task holds
    all distances of a query, and no side is broadcast.
    """
    whole = "embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)"
    vectors, queries = vectors.where(whole).select("vec_id", "embedding"), queries.where(whole).select("vec_id", "embedding")
    blocks, groups = -(-max(vectors.count(), 1) // block), -(-max(queries.count(), 1) // group)
    # Both sides' keys are of one type: a cogroup doesn't cast, and an int and a bigint of one value are dealt to different partitions.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    drawn = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = vectors.withColumn("b", drawn(blocks)).withColumn("g", every(groups))
    right = queries.withColumn("g", drawn(groups)).withColumn("b", every(blocks))

    def best(vs: pa.Table, qs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, rows = np.array(vs.column("vec_id").to_pylist()), _matrix(vs.column("embedding"))
        lengths = np.array([len(x) for x in rows])
        stacked = {n: (ids[lengths == n], np.stack([x for x in rows if len(x) == n], axis=1)) for n in set(lengths.tolist())}
        for own, q in zip(qs.column("vec_id").to_pylist(), _matrix(qs.column("embedding")), strict=True):
            if len(q) not in stacked:
                continue
            others, matrix = stacked[len(q)]
            # A vector is a column, so its squares are added in their order, as SQL's sum adds them.
            distance = _rounded(np.sqrt(((matrix - q[:, None]) ** 2).sum(axis=0)), digits)
            keep = others != own
            order = np.lexsort((others[keep], distance[keep]))[:k]
            out += [(own, int(others[keep][i]), float(distance[keep][i])) for i in order]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "distance": pa.array(columns[2], pa.float64())})

    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(best, "query_id bigint, vec_id bigint, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
