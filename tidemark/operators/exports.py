"""What surrounds the change records: packing into fragments, what is exported, delivery, upkeep of tables and objects."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import range_join
from tidemark.operators.walks import walk

#: Tables that are never exported by prefix, and those exported in spite of it.
HIDDEN_PREFIXES = ("sqlite_", "_litestream_", "_cf_")
EXPORTED_ANYWAY = ("_cf_kv", "__kv_meta")
EXPORTED_PREFIX = "__queue_"
#: Classes of the platform that are exported beside an application's, and those that never are.
PLATFORM_CLASSES = ("__D1Database", "__KvNamespace")
NEVER_CLASSES = ("__Queue", "__Workflow", ".cron")


def split_records(records: DataFrame, *, max_bytes: int, overhead: int = 0) -> DataFrame:
    """Records (any columns and ``rows``, an array of texts) as fragments of at most ``max_bytes``: + fragment, fragments, kind.

    Rows are packed in order. A record with a single row that can't fit becomes
    one bulk record without rows; one without rows stays one fragment.
    """
    room = max_bytes - overhead

    def add(state: Column, row: Column) -> Column:
        size = F.octet_length(row)
        fresh = (state["used"] > 0) & (state["used"] + size > room)
        number = state["number"] + fresh.cast("int")
        return F.struct(number.alias("number"), F.when(fresh, size).otherwise(state["used"] + size).alias("used"), F.array_append(state["at"], number).alias("at"))

    start = F.struct(F.lit(1).alias("number"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))
    too_big = F.exists("rows", lambda r: F.octet_length(r) > room)
    packed = records.withColumn("_at", F.aggregate("rows", start, add, lambda s: s["at"]))
    packed = packed.withColumn("fragments", F.when(too_big | (F.size("rows") == 0), 1).otherwise(F.array_max("_at")))
    spread = packed.withColumn("fragment", F.explode(F.sequence(F.lit(1), F.col("fragments"))))
    own = F.filter(F.arrays_zip("rows", "_at"), lambda p: p["_at"] == F.col("fragment"))
    return spread.withColumn("kind", F.when(too_big, "bulk").otherwise("rows")).withColumn("rows", F.when(too_big, F.array().cast("array<string>")).otherwise(F.transform(own, lambda p: p["rows"]))).drop("_at")


def exported_table(name: Column) -> Column:
    """Whether a table is exported; prefixes are compared without case."""
    low = F.lower(name)
    hidden = low.startswith(HIDDEN_PREFIXES[0]) | low.startswith(HIDDEN_PREFIXES[1]) | low.startswith(HIDDEN_PREFIXES[2])
    own = low.startswith("__") & ~(low.startswith(EXPORTED_PREFIX) | low.isin(*EXPORTED_ANYWAY))
    return (~hidden & ~own) | low.isin(*EXPORTED_ANYWAY)


def exported_class(name: Column, allowed: list[str] | None = None) -> Column:
    never = name.isin(*NEVER_CLASSES) | name.startswith("__Workflow.") | name.endswith(".cron")
    ours = ~name.startswith("__") | name.isin(*PLATFORM_CLASSES) if allowed is None else name.isin(*allowed)
    return ours & ~never


def delivered(commits: DataFrame, by: list[str]) -> DataFrame:
    """How far a stream's commits were acknowledged without a break: by, delivered, frozen.

    commits: by, commit, acked. Everything from the first drop on waits for a repair.
    """
    first_drop = F.min(F.when(~F.col("acked"), F.col("commit"))).over(Window.partitionBy(*by))
    marked = commits.withColumn("_drop", first_drop)
    before = F.max(F.when(F.col("_drop").isNull() | (F.col("commit") < F.col("_drop")), F.col("commit")))
    return marked.groupBy(*by).agg(before.alias("delivered"), F.bool_or(F.col("_drop").isNotNull()).alias("frozen"))


def recovered_sessions(recovered: DataFrame) -> DataFrame:
    """Per session: records expected, streams held, whether any was lost, and whether it fell short.

    A stream held is a (cell, facet, epoch of its head); how many were sent is
    the most that any record of the session says, 0 if none says.
    """
    stream = F.struct("cell", "facet", "epoch")
    out = recovered.groupBy("session").agg(F.coalesce(F.max("expected"), F.lit(0)).alias("expected"), F.count_distinct(stream).alias("held"), F.bool_or("loss").alias("loss"))
    return out.withColumn("short", F.col("held") < F.col("expected"))


def sync_plan(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with derived tables: created, replaced, unchanged or skipped (nothing to select). wanted: name, columns; existing: name, digest."""
    text = F.concat_ws(",", "columns")
    named = wanted.select("name", F.size("columns").alias("_n"), F.md5(text).alias("wanted"))
    action = F.when(F.col("_n") == 0, "skipped").when(F.col("digest").isNull(), "created").when(F.col("digest") == F.col("wanted"), "unchanged").otherwise("replaced")
    return named.join(existing, "name", "left").select("name", action.alias("action"))


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables between two catalogues (name, root, generation): renamed (same root page), vanished, opened (a new generation) or kept."""
    b = before.select(F.col("name").alias("old_name"), F.col("root").alias("old_root"), F.col("generation").alias("old_generation"))
    named = after.join(b, after["name"] == b["old_name"], "full_outer")
    moved = named.where("old_name IS NULL").select("name", "root").join(named.where("name IS NULL").select("old_name", F.col("old_root").alias("root")), "root", "left")
    renamed = moved.where("old_name IS NOT NULL")
    same = named.where("name IS NOT NULL AND old_name IS NOT NULL")
    kept = same.select("name", F.when(F.col("root") == F.col("old_root"), "kept").otherwise("opened").alias("change"), (F.col("old_generation") + (F.col("root") != F.col("old_root")).cast("bigint")).alias("generation"), F.lit(None).cast("string").alias("renamed_from"))
    fresh = moved.select("name", F.when(F.col("old_name").isNull(), "opened").otherwise("renamed").alias("change"), F.lit(1).cast("bigint").alias("generation"), F.col("old_name").alias("renamed_from"))
    gone = named.where("name IS NULL").join(renamed.select("old_name"), "old_name", "left_anti").select(F.col("old_name").alias("name"), F.lit("vanished").alias("change"), F.col("old_generation").alias("generation"), F.lit(None).cast("string").alias("renamed_from"))
    return kept.unionByName(fresh).unionByName(gone)


def kv_rows(changes: DataFrame, scope: str) -> DataFrame:
    """Rows of the key-value table as (key, value) of one scope."""
    return changes.where(F.col("scope") == scope).select(F.col("k").alias("key"), F.col("v").alias("value"))


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    return files.join(applied, "name", "left_anti").orderBy("name")


def fixed_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed: the first by hash."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def shed(load: DataFrame) -> DataFrame:
    """Bytes to shed to get back to the budget: from the buffer first, then from what is pending."""
    over = F.greatest(F.col("buffered") + F.col("waiting") - F.col("budget"), F.lit(0))
    first = F.least(over, F.col("buffered"))
    return load.select("*", first.alias("shed_buffered"), F.least(over - first, F.col("waiting")).alias("shed_waiting"))


def conditional(objects: DataFrame, *, if_match: str | None = None, if_none_match: str | None = None, modified_since: int | None = None, unmodified_since: int | None = None) -> DataFrame:
    """Objects with whether a conditional read gives the body; an entity tag outranks the date of its kind."""
    ok = F.lit(True)
    if if_match is not None:
        ok = ok & (F.col("etag") == if_match)
    elif unmodified_since is not None:
        ok = ok & (F.col("modified_ms") <= unmodified_since)
    if if_none_match is not None:
        ok = ok & (F.col("etag") != if_none_match)
    elif modified_since is not None:
        ok = ok & (F.col("modified_ms") > modified_since)
    return objects.withColumn("ok", ok)


def byte_range(data: Column, *, offset: int | None = None, length: int | None = None, suffix: int | None = None) -> Column:
    """Part of a binary; a suffix outranks offset and length."""
    raw = data.cast("binary")
    if suffix is not None:
        start = F.greatest(F.octet_length(raw) - suffix, F.lit(0)) + 1
        return F.substring(raw, start, F.lit(2**31 - 1))
    return F.substring(raw, (offset or 0) + 1, 2**31 - 1 if length is None else length)


def delivery_batches(messages: DataFrame, *, size: int, wait_ms: int) -> DataFrame:
    """Batches per queue in order of readiness: one closes when full, or when its oldest message has waited; queue, batch, n, first_at.

    Where a batch ends depends on where the one before it did, so a queue is walked in order, as a stream.
    """

    def visit(key: tuple, times: Iterator[tuple]) -> Iterator[tuple]:
        number, n, first = 0, 0, 0
        for (at,) in times:
            if n and (n >= size or at >= first + wait_ms):
                yield (*key, number, n, first)
                number, n = number + 1, 0
            first = first if n else at
            n += 1
        if n:
            yield (*key, number, n, first)

    return walk(messages, by=["queue"], order=["ready_at"], take=["ready_at"], visit=visit, schema="queue string, batch int, n bigint, first_at bigint")


def slow_members(medians: DataFrame, *, factor: float) -> DataFrame:
    """Members whose median exceeds ``factor`` times the least of their group's others."""
    others = Window.partitionBy("group").orderBy("median", "member")
    ranked = medians.withColumns({"_r": F.row_number().over(others), "_least": F.min("median").over(Window.partitionBy("group")), "_second": F.lead("median").over(others)})
    rest = F.when(F.col("_r") == 1, F.col("_second")).otherwise(F.col("_least"))
    return ranked.where(F.col("median") > rest * factor).select("group", "member", "median")


def attribute_commits(commits: DataFrame, captures: DataFrame, by: list[str], *, width: int = 256) -> DataFrame:
    """Each commit with the first capture that contains its last log frame; null where none does, never a guess."""
    ranges = captures.select(*by, "capture", "from_frame", (F.col("to_frame") + 1).alias("_end"))
    held = range_join(commits, ranges, by=by, at="last_frame", low="from_frame", high="_end", width=width)
    first = held.groupBy(*by, "commit").agg(F.min("capture").alias("capture"))
    return commits.select(*by, "commit").distinct().join(first, [*by, "commit"], "left")
