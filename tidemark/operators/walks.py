"""Steps that depend on their own earlier choices, walked in order over streams of sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that leave a task together.
BATCH = 8192
#: Rows of a task of a large table, and those below which a task isn't worth its start.
TASK_ROWS, LEAST_ROWS = 100_000, 10_000


def tasks_for(rows: DataFrame) -> int:
    """How many tasks ``rows`` are dealt to, so that a task's share is the same whatever their number.

    Partitions whose number isn't stated are merged by compressed bytes, into one
    per core while they are small; records compress so well that a task then
    sorts millions. ``rows`` are counted, so they should be close to their source.
    """
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    return max(1, -(-n // TASK_ROWS), min(cores, -(-n // LEAST_ROWS)))


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """``rows`` with those of a key of ``by`` together, in so many tasks; without ``tasks`` Spark chooses. Rows that lie so already stay."""
    return rows.repartition(tasks, *by) if tasks else rows.repartition(*by)


def walk(rows: DataFrame, *, by: list[str], order: list[Column | str], take: list[str], visit: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str, tasks: int | None = None) -> DataFrame:
    """visit(key, rows of the key in ``order``, as tuples of ``take``) for each key of ``by``; what it yields are rows of ``schema``.

    A task sorts its partition (which spills) and reads it as a stream, so a key
    may have any number of rows: what is held is what ``visit`` holds. A key is
    walked by one task, as each step needs the one before it. ``tasks``: see ``tasks_for``.
    """
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for key, group in groupby(stream, key=lambda r: r[: len(by)]):
            for row in visit(key, (r[len(by) :] for r in group)):
                out.append(row)
                if len(out) == BATCH:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return dealt(rows, tasks, *by).sortWithinPartitions(*by, *order).select(*by, *take).mapInArrow(run, kind)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
