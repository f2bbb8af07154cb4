"""Operations on spans, logs and measurements: histograms, medians, latches, sampling, layout and retention."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.walks import walk

MAX_SCALE = 20
MAX_BUCKETS = 160


def exp_histogram(values: DataFrame, group: str, value: str, *, buckets: int = MAX_BUCKETS, max_scale: int = MAX_SCALE) -> DataFrame:
    """Exponential histogram per group: group, scale, zero_count, n, total, low, high, bucket, bucket_count.

    Bucket i of scale s holds (2^(i/2^s), 2^((i+1)/2^s)]; the scale is the
    largest at which at most ``buckets`` buckets are used. Negative and
    non-finite values are dropped, groups without values do not appear. Indexes
    at the largest scale are counted first, so both passes combine map-side.
    """
    sound = values.where((F.col(value) >= 0) & (F.col(value) < F.lit(float("inf"))) & ~F.isnan(value))
    index = F.when(F.col(value) > 0, F.ceil(F.log2(F.col(value)) * float(2**max_scale)) - 1)
    fine = sound.groupBy(group, index.alias("i")).agg(F.count("*").alias("c"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    spread = fine.groupBy(group).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.sum("c").alias("n"), F.sum("s").alias("total"), F.min("lo").alias("low"), F.max("hi").alias("high"), F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("c"))), F.lit(0)).alias("zero_count"))
    shifts = F.sequence(F.lit(0), F.lit(max_scale + 11))
    by = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("bigint")
    shift = F.coalesce(F.array_min(F.filter(shifts, lambda k: by(F.col("last"), k) - by(F.col("first"), k) < buckets)), F.lit(0))
    scaled = fine.join(spread.withColumn("shift", shift), group)
    scaled = scaled.withColumn("bucket", by(F.col("i"), F.col("shift")))
    return scaled.groupBy(group, (F.lit(max_scale) - F.col("shift")).alias("scale"), "zero_count", "n", "total", "low", "high", "bucket").agg(F.sum("c").alias("bucket_count")).where("bucket IS NOT NULL OR n = zero_count")


def upper_median(values: Column) -> Column:
    """The middle of sorted values, the upper one of two."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def sliding_median(samples: DataFrame, *, member: str, at: str, value: str, span: int, least: int) -> DataFrame:
    """Each sample with the upper median of its member's last ``span`` (time units), null with fewer than ``least`` samples."""
    window = Window.partitionBy(member).orderBy(at).rangeBetween(-span, 0)
    held = F.collect_list(value).over(window)
    return samples.withColumn("median", F.when(F.size(held) >= least, upper_median(held)))


def sustained(samples: DataFrame, *, member: str, at: str, suspect: Column, for_at_least: int) -> DataFrame:
    """Runs of suspect samples, unbroken by a healthy one, that last: member, since, until, n."""
    order = Window.partitionBy(member).orderBy(at)
    marked = samples.withColumn("_s", suspect).withColumn("_run", F.sum(F.when(~F.col("_s"), 1).otherwise(0)).over(order))
    runs = marked.where("_s").groupBy(member, "_run").agg(F.min(at).alias("since"), F.max(at).alias("until"), F.count("*").alias("n"))
    return runs.where(F.col("until") - F.col("since") >= for_at_least).drop("_run")


def latch(samples: DataFrame, *, member: str, order: list[str], value: str, ceiling: float, release: float = 0.8) -> DataFrame:
    """Hysteresis: engaged from a value at the ceiling on, until one at or below ``release`` of it."""
    event = F.when(F.col(value) >= ceiling, True).when(F.col(value) <= ceiling * release, False)
    return samples.withColumn("engaged", F.coalesce(F.last_value(event, F.lit(True)).over(Window.partitionBy(member).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def sampled(spans: DataFrame, ratio: float, *, parent: Column | None = None) -> DataFrame:
    """Head sampling: a trace is kept if the first 64 bits of its id lie below ``ratio`` of their range; a remote parent's choice comes first."""
    own = F.conv(F.substring("trace_id", 1, 16), 16, 10).cast("decimal(20,0)") < F.lit(int(ratio * 2**64)).cast("decimal(20,0)")
    return spans.where(own if parent is None else F.coalesce(parent, own))


#: A receiver fills to so many hundredths below its target.
DEADBAND_PERCENT = 2


def rebalance(peers: DataFrame, *, now: int, batch: int, max_age_ms: int = 60_000, since_ms: int = 0) -> DataFrame:
    """Weighted targets: node, owned_cells, target, surplus, room; no rows unless every live peer is fresh, paced and unpaused.

    target = ceil(owned in all * weight / weights in all), weights being 1 at
    least. room is what a node can take before it comes within the deadband
    below its target; draining and restoring nodes have none. Only the densest
    node gives (of equals the first by name): what it owns beyond its target, but no
    more than the others' room or ``batch``. One row per node: global windows over the fleet.
    """
    live = peers.where(F.col("expires_ms") > now).withColumn("_w", F.greatest("placement_weight", F.lit(1)))
    whole = Window.partitionBy(F.lit(0))
    fresh = (F.col("sampled_ms") > since_ms) & (F.col("sampled_ms") + max_age_ms >= now)
    ready = fresh & F.col("paced") & ~F.col("paused") & F.col("owned_cells").isNotNull() & F.col("placement_weight").isNotNull()
    summed = live.withColumns({"_ready": F.min(ready.cast("int")).over(whole), "_owned": F.sum("owned_cells").over(whole), "_all": F.sum("_w").over(whole)})
    planned = summed.where("_ready = 1").withColumn("target", F.expr("(_owned * _w + _all - 1) DIV _all"))
    takes = ~F.col("draining") & (F.col("restoring") == 0)
    space = F.greatest(F.col("target") - F.expr(f"(target * {DEADBAND_PERCENT} + 99) DIV 100") - F.col("owned_cells"), F.lit(0))
    planned = planned.withColumn("room", F.when(takes, space).otherwise(0))
    density = F.col("owned_cells") / F.col("_w")
    donor = F.row_number().over(whole.orderBy(F.desc(density), "node")) == 1
    others = F.sum("room").over(whole) - F.col("room")
    surplus = F.greatest(F.least(F.col("owned_cells") - F.col("target"), others, F.lit(batch)), F.lit(0))
    return planned.withColumn("_donor", donor).select("node", "owned_cells", "target", F.when(F.col("_donor"), surplus).otherwise(0).alias("surplus"), "room")


def shared_heap(isolates: DataFrame) -> DataFrame:
    """An isolate's bytes spread evenly over its cells, one row per cell."""
    each = F.floor(F.col("bytes") / F.col("cells")).cast("bigint")
    return isolates.where("cells > 0").select("isolate", each.alias("bytes"), F.explode(F.sequence(F.lit(1), F.col("cells").cast("int"))).alias("cell"))


def gauges(states: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Numbers out of nested JSON: member, gauge, value; an absent one has no row, a zero has."""
    values = F.array(*(F.struct(F.lit(name).alias("gauge"), F.get_json_object(column, path).try_cast("double").alias("value")) for name, path in paths.items()))
    return states.select("member", F.inline(values)).where("value IS NOT NULL")


def eviction_plan(entries: DataFrame, *, budget: int) -> DataFrame:
    """Per cache, newest first, what stays: an entry stays if it still fits, so a small old one may stay where a large newer one went.

    The choice depends on all choices before it; a cache's index is walked in order, as a stream.
    """

    def visit(key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        used = 0
        for name, size in found:
            stays = used + size <= budget
            used += size if stays else 0
            yield (*key, name, stays)

    return walk(entries, by=["cache"], order=[F.desc("used_at"), "key"], take=["key", "size"], visit=visit, schema="cache string, key bigint, stays boolean")


def due(alarms: DataFrame, *, now_minute: str) -> DataFrame:
    """Armed minutes up to now, the earliest per cell."""
    return alarms.where(F.col("minute") <= now_minute).groupBy("cell").agg(F.min("minute").alias("minute"))


def expired_objects(objects: DataFrame, *, today: str, days: int) -> DataFrame:
    """Objects whose day, from the key <prefix>/<node>/yyyy/mm/dd/hh/..., is before the cutoff; keys that don't parse are never touched."""
    found = F.regexp_extract("key", r"/(\d{4}/\d{2}/\d{2})/\d{2}/[^/]+\.parquet$", 1)
    day = F.try_to_date(F.nullif(found, F.lit("")), "yyyy/MM/dd")
    return objects.where(day < F.date_sub(F.lit(today).cast("date"), days))


def list_objects(objects: DataFrame, *, prefix: str = "", delimiter: str | None = None, start_after: str | None = None, limit: int = 1000) -> DataFrame:
    """Object listing: keys, and with a delimiter the common prefixes that stand for keys below them, in order."""
    rows = objects.where(F.col("key").startswith(prefix)) if prefix else objects
    rows = rows.where(F.col("key") > start_after) if start_after is not None else rows
    rest = F.substring("key", len(prefix) + 1, 2**30)
    cut = F.locate(delimiter, rest) if delimiter else F.lit(0)
    rolled = F.when(cut > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), cut + len(delimiter or "") - 1)))
    named = rows.select(F.coalesce(rolled, F.col("key")).alias("name"), rolled.isNotNull().alias("is_prefix"), "size")
    return named.groupBy("name", "is_prefix").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes")).orderBy("name").limit(min(limit, 1000))
