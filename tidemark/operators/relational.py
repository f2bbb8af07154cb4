"""Joins that Spark has no operator for, and guards for user SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of a user's statement and of its result.
MAX_SQL_BYTES, MAX_BINDS, MAX_ROWS, MAX_RESULT_BYTES = 100_000, 100, 100_000, 32 << 20


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], at: str, keep: list[str]) -> DataFrame:
    """Each left row with ``keep`` of the last right row of its key at or before it.

    A union sorted once per key carries the last right value down, instead of
    a range join. Of right rows at one time the greatest counts. ``left`` gets no duplicates.
    """
    value = F.struct(*keep)
    lefts = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)})
    rights = right.groupBy(*by, at).agg(F.max(value).alias("_value")).withColumn("_side", F.lit(0))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    down = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_value", ignorenulls=True).over(down)).where("_side = 1")
    return carried.select(*left.columns, *(F.col(f"_last.{c}").alias(c) for c in keep))


def range_join(points: DataFrame, ranges: DataFrame, *, at: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the ranges [low, high) of their key that hold them: an equi-join on key and bins of ``width``, with the bounds as residual."""
    by = by or []
    sound = ranges.where(F.col(high) > F.col(low))
    bins = sound.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    hit = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(bins, [*by, "_bin"]).where(hit).drop("_bin")


def range_counts(points: DataFrame, ranges: DataFrame, *, at: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Ranges [low, high) with ``n``, how many points of their key they hold; ranges that hold none are left out.

    A range holds the points below its high less those below its low. How many
    lie below a bound is a running total: over bins of ``width``, and in a bin
    over distinct values. So rows are met once each, never a range with its points.
    """
    by = by or []
    sound = ranges.where(F.col(high) > F.col(low))
    bounds = sound.select(*by, F.explode(F.array(low, high)).alias("_x")).distinct()
    met = points.select(*by, F.col(at).alias("_x"), F.lit(1).alias("_n")).where("_x IS NOT NULL").unionByName(bounds.withColumn("_n", F.lit(0)))
    # NaN, the greatest value, has no floor.
    bin_ = F.when(F.isnan("_x"), F.lit(2**63 - 1)).otherwise(F.floor(F.col("_x") / width).cast("bigint"))
    values = met.groupBy(*by, "_x").agg(F.sum("_n").alias("_n")).withColumn("_bin", bin_)
    before = lambda order: F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = values.groupBy(*by, "_bin").agg(F.sum("_n").alias("_n")).select(*by, "_bin", before(Window.partitionBy(*by).orderBy("_bin")).alias("_base"))
    inside = values.withColumn("_inside", before(Window.partitionBy(*by, "_bin").orderBy("_x")))
    below = inside.join(bins, [*by, "_bin"]).withColumn("_below", F.col("_base") + F.col("_inside"))
    under = lambda bound: below.select(*by, F.col("_x").alias(bound), F.col("_below").alias(f"_{bound}"))
    counted = sound.join(under(low), [*by, low]).join(under(high), [*by, high])
    return counted.withColumn("n", F.col(f"_{high}") - F.col(f"_{low}")).where("n > 0").select(*ranges.columns, "n")


def gaps_and_islands(rows: DataFrame, *, by: list[str], at: str, gap: Column | int) -> DataFrame:
    """Sessions: runs of a key's rows with at most ``gap`` between neighbours: by, first, last, n."""
    order = Window.partitionBy(*by).orderBy(at)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(order)) > gap, F.lit(True)).cast("int")
    marked = rows.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_run")


def _nodes(plan):
    """A parsed plan and all below it, also what hangs beside it as a common table expression or a subquery."""
    yield plan
    for inner in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for i in range(inner.size()):
            if inner.apply(i).getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical.") or hasattr(inner.apply(i), "multipartIdentifier"):
                yield from _nodes(inner.apply(i))


def check_reading(spark: SparkSession, text: str) -> None:
    """Raise unless Spark parses ``text`` as one query: a command or a write at any place is refused."""
    from pyspark.errors import ParseException

    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ParseException(str(e)) if "ParseException" in str(e) else e from None
    load = plan.getClass().getClassLoader().loadClass
    kinds = [load(f"org.apache.spark.sql.catalyst.plans.logical.{x}") for x in ("Command", "ParsedStatement")]
    if any(kind.isInstance(node) for node in _nodes(plan) for kind in kinds):
        raise PermissionError("only queries are allowed")


def bounded(rows: DataFrame, limit: int = MAX_ROWS, size: int = MAX_RESULT_BYTES) -> DataFrame:
    """``rows``, which must be at most ``limit`` and ``size`` bytes of JSON: more is an error when they are read, never a cut.

    Only limit + 1 rows are gathered to be counted, whatever the size of the result.
    """
    names = rows.columns
    some = rows.limit(limit + 1).withColumn("_size", F.octet_length(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)))))
    whole = Window.partitionBy(F.lit(0))
    fault = F.when(F.count("*").over(whole) > limit, f"more than {limit} rows").when(F.sum("_size").over(whole) > size, f"more than {size} bytes")
    judged = some.withColumn("_fault", fault)
    return judged.where(F.col("_fault").isNull() | F.raise_error(F.col("_fault")).cast("boolean")).select(*(F.col(f"`{n}`") for n in names))


def user_sql(spark: SparkSession, text: str, args: list | None = None, *, limit: int = MAX_ROWS, size: int = MAX_RESULT_BYTES, **tables: DataFrame) -> DataFrame:
    """One query with positional parameters over the given tables; a result beyond ``limit`` rows or ``size`` bytes is an error.

    The statement is parsed, and refused if any part of it is a command or a
    write. Booleans bind as 0 and 1, bytes as binary; other types than numbers,
    text and null are refused, as are over-long statements. Tables are bound
    under names of their own, so that no view of the session is replaced.
    """
    args = list(args or [])
    if len(text.encode()) > MAX_SQL_BYTES or len(args) > MAX_BINDS:
        raise ValueError("statement too large")
    check_reading(spark, text)
    bound = []
    for a in args:
        if not (a is None or isinstance(a, (bool, int, float, str, bytes))):
            raise TypeError(f"can't bind {type(a).__name__}")
        bound.append(int(a) if isinstance(a, bool) else a)
    own = {name: f"tidemark_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(own[name])
        heads = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in own.items())
        rows = spark.sql(f"WITH {heads} SELECT * FROM (\n{text}\n)" if own else text, args=bound)
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)
    return bounded(rows, limit, size)


def one(rows: DataFrame) -> dict:
    """The only row; an error if there is none or more."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError("expected exactly one row, got " + ("none" if not found else "more"))
    return found[0].asDict()
