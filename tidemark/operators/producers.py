"""From commits to the records that carry them, the marks that certify them, and the batches that land them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cdc import POSITION, STREAM, TABLE
from tidemark.operators.exports import split_records
from tidemark.operators.walks import dealt, tasks_for, walk


def commit_records(changes: DataFrame, *, max_bytes: int, overhead: int = 0) -> DataFrame:
    """Row records of commits: STREAM, POSITION, kind, TABLE, fragment, fragments, rows, body.

    changes: STREAM, epoch, txid, seq, TABLE, columns and key_columns (arrays of
    text), change (the JSON text of one [op, key, row]). A transaction with rows
    takes the next commit number of its stream's epoch; its rows go, in order of
    seq, into one record per table, cut into fragments of at most ``max_bytes``. A
    record with a row that can't fit is a bulk record without rows.
    """
    own = [*STREAM, "epoch"]
    tasks = tasks_for(changes)
    changes = dealt(changes, tasks, *own, "txid")
    numbered = dealt(changes.select(*own, "txid").distinct(), tasks, *own).withColumn("commit", F.row_number().over(Window.partitionBy(*own).orderBy("txid")).cast("bigint"))
    placed = changes.join(numbered, [*own, "txid"])
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", "change"))), lambda r: r["change"])
    whole = placed.groupBy(*STREAM, *POSITION, *TABLE, "columns", "key_columns").agg(rows.alias("rows"))
    names = lambda c: F.to_json(c)
    cut = split_records(whole, max_bytes=max_bytes, overhead=overhead)
    body = F.concat(F.lit('{"columns":'), names("columns"), F.lit(',"key_columns":'), names("key_columns"), F.lit(',"rows":['), F.array_join("rows", ","), F.lit("]}"))
    return cut.withColumn("body", F.when(F.col("kind") == "rows", body)).drop("columns", "key_columns")


def watermarks(records: DataFrame, *, every: int) -> DataFrame:
    """Marks per stream and epoch, one after each ``every`` commits and one at the end: STREAM, epoch, from_txid, from_commit, txid, commit, commits, records.

    records: STREAM, POSITION, one row per record acknowledged (fragments of a
    record are one). Each mark says how many commits and records lie after
    the one before it, so that ``certified_heads`` can hold them against what came.
    """
    own = [*STREAM, "epoch"]
    at = records.groupBy(*own, "txid", "commit").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*own).orderBy("txid", "commit")
    block = F.floor((F.row_number().over(order) - 1) / every)
    marks = at.withColumn("_block", block).groupBy(*own, "_block").agg(F.max(F.struct("txid", "commit")).alias("upto"), F.count("*").alias("commits"), F.sum("n").alias("records"))
    before = F.lag("upto").over(Window.partitionBy(*own).orderBy("_block"))
    linked = marks.withColumn("_from", before)
    return linked.select(*own, F.col("_from.txid").alias("from_txid"), F.col("_from.commit").alias("from_commit"), "upto.txid", "upto.commit", "commits", "records")


def topic_batches(messages: DataFrame, *, records: int, size: int) -> DataFrame:
    """Batches of a topic's messages, with the offset that each lets its partition commit: partition, batch, last_place, n, bytes.

    messages: partition, place (the offset), bytes, sound (it decodes to a record), skip (an
    operator chose to drop it). A batch closes when it has ``records`` records
    or ``size`` bytes. A message that doesn't decode stops its partition: it and
    what follows are not covered, until it is skipped, which covers its offset
    and lands nothing. Of repeated offsets one counts.
    """
    once = messages.dropDuplicates(["partition", "place"])
    stop = F.min(F.when(~F.col("sound") & ~F.col("skip"), F.col("place"))).over(Window.partitionBy("partition"))
    read = once.withColumn("_stop", stop).where("_stop IS NULL OR place < _stop").withColumn("_lands", F.col("sound") & ~F.col("skip"))

    def visit(key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        number, n, held, last = 0, 0, 0, None
        for place, lands, weight in found:
            last = place
            if lands:
                n, held = n + 1, held + weight
            if n >= records or held >= size:
                yield (*key, number, last, n, held)
                number, n, held, last = number + 1, 0, 0, None
        if last is not None:
            yield (*key, number, last, n, held)

    return walk(read, by=["partition"], order=["place"], take=["place", "_lands", "bytes"], visit=visit, schema="partition bigint, batch int, last_place bigint, n bigint, bytes bigint")


def flushes(records: DataFrame, *, flush_bytes: int, interval_ms: int) -> DataFrame:
    """When a sink writes its buffer: node, flush, n, bytes, first_ms, why (bytes or interval).

    records: node, at_ms, bytes. The interval runs from the flush before, or the
    first record after it; a buffer that reaches ``flush_bytes`` is written at once.
    """

    def visit(key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        number, n, held, first = 0, 0, 0, 0
        for at, weight in found:
            if n and at >= first + interval_ms:
                yield (*key, number, n, held, first, "interval")
                number, n, held = number + 1, 0, 0
            first = first if n else at
            n, held = n + 1, held + weight
            if held >= flush_bytes:
                yield (*key, number, n, held, first, "bytes")
                number, n, held = number + 1, 0, 0
        if n:
            yield (*key, number, n, held, first, "interval")

    return walk(records, by=["node"], order=["at_ms", "bytes"], take=["at_ms", "bytes"], visit=visit, schema="node string, flush int, n bigint, bytes bigint, first_ms bigint, why string")


def first_rows(changes: DataFrame) -> DataFrame:
    """One of each row change that came repeatedly: by stream, position, table, key and fragment."""
    return changes.dropDuplicates([*STREAM, *POSITION, *TABLE, "key", "fragment"])


