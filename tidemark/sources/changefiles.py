"""Change records in Parquet and JSON lines, and object layout by node and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds of records and the names of their envelope's fields.
KINDS = ("rows", "snapshot", "snapshot_end", "schema", "link", "recovered", "deleted", "watermark", "bulk", "gap")
_TEXT = ("kind", "script", "class", "cell", "cell_name", "facet")
_U64 = ("incarnation", "epoch", "txid", "commit")
#: Unsigned 64-bit numbers read as decimal(20,0).
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in _TEXT] + [T.StructField(c, T.DecimalType(20, 0)) for c in _U64] + [T.StructField("committed_at", T.TimestampType()), T.StructField("node", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("fragment", T.LongType()), T.StructField("fragments", T.LongType()), T.StructField("body", T.StringType())])


def read_changes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined): rows of unknown kind, without a cell, or whose body names another kind are set apart."""
    return split_valid(spark.read.schema(RECORD).parquet(path))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = F.get_json_object("body", "$.kind")
    good = F.coalesce(F.col("kind").isin(*KINDS) & F.col("cell").isNotNull() & (named.isNull() | (named == F.col("kind"))) & F.col("fragment").between(1, F.col("fragments")), F.lit(False))
    return rows.where(good), rows.where(~good)


def write_changes(records: DataFrame, path: str) -> None:
    """One directory per day, ordered by stream within files, with a bloom filter for lookups by cell."""
    dated = records.withColumn("dt", F.to_date("committed_at"))
    ordered = dated.repartition("dt", "script", "class", "cell").sortWithinPartitions("script", "class", "cell", "epoch", "txid", "commit")
    ordered.write.mode("append").option("compression", "zstd").option("parquet.bloom.filter.enabled#cell", "true").partitionBy("dt").parquet(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record a line, + source: the object it was read from, as the line's ``object`` says, or else the file's name.

    What the envelope doesn't name stays in body. A line that isn't JSON gives a row of nulls with the line as body, which
    ``split_valid`` sets apart.
    """
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path"))
    envelope = [f for f in RECORD.fields if f.name not in ("body", "committed_at")]
    schema = T.StructType([*envelope, T.StructField("committed_at", T.LongType()), T.StructField("object", T.StringType())])
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.col("value").alias("body"), "_file")
    typed = parsed.select("r.*", "body", "_file").withColumn("committed_at", F.timestamp_millis("committed_at"))
    return typed.select(*(f.name for f in RECORD.fields), F.coalesce("object", "_file").alias("source"))


def as_messages(records: DataFrame) -> DataFrame:
    """Topic messages: key by stream, payload as JSON, time of commit."""
    key = F.concat_ws("\u0000", "script", "class", "cell", F.coalesce("facet", F.lit("")), F.col("incarnation").cast("string"))
    return records.select(key.alias("key"), F.to_json(F.struct(*records.columns)).alias("value"), F.col("committed_at").alias("timestamp"))


def newer_objects(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Objects of a listing that are new or changed since they were indexed."""
    return listed.join(known, ["key", "version"], "left_anti")


def with_layout(spans: DataFrame) -> DataFrame:
    """node, dt and hh from <prefix>/<node>/yyyy/mm/dd/hh/<file>, for pruning by partition."""
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/(\d{4}/\d{2}/\d{2})/(\d{2})/[^/]+$", i)
    return spans.withColumns({"node": part(1), "dt": F.replace(part(2), F.lit("/"), F.lit("-")), "hh": part(3)})
