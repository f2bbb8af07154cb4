"""Event-time and stateful pipelines with Structured Streaming, run over what has landed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import shared_dir


def scratch(spark: SparkSession) -> str:
    """A folder of its own for a run's checkpoints and results, in the folder that all executors share."""
    return f"{shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; TIMESTAMP_NTZ can't carry a watermark, so ts is cast (the session's zone is UTC)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str, at: str | None = None) -> DataFrame:
    """Runs a stream over all that is available and returns the rows it wrote.

    Each micro-batch overwrites its own folder, so a batch that runs again
    after a failure leaves no duplicates. In complete mode the last batch is
    the result, in update and append mode all batches are.
    """
    spark = stream.sparkSession
    at = at or scratch(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("_batch", "integer")).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    if mode == "complete":
        last = rows.agg(F.max("_batch")).first()[0]
        rows = rows.where(F.col("_batch") == F.lit(last))
    return rows.drop("_batch")


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """First deliveries only, remembered for as long as the watermark allows."""
    return events.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(keys)


def current_state(events: DataFrame) -> DataFrame:
    """The newest event of each user, for update mode: late events never replace newer ones."""
    newest = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("v"))
    return newest.select("user_id", "v.ts", "v.event_id", "v.event_type")


def enriched(events: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """A stream joined to a table that doesn't change."""
    return events.join(table, on)


def landed(records: DataFrame, path: str, tombstones: DataFrame):
    """Routes a stream of landed records to two tables under ``path``; a replayed batch overwrites itself."""
    from tidemark.operators.cdc import route

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in zip(("changes", "meta"), route(batch, tombstones), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return records.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
