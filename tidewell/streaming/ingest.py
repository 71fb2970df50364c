"""Structured Streaming ingest: de-duplicated events to a table, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.plans.scratch import shared_dir

_STORE = "spark.sql.streaming.stateStore.providerClass"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """Events of a Parquet folder or file as a stream; the schema comes from the files there."""
    schema = spark.read.parquet(folder).schema
    any_kind = f"{folder[:-1]}[{folder[-1]}]"  # as a pattern, so that a single file will do as well
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(any_kind)


def deduplicated(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event once, in whatever order files come; the ids seen are kept in the state store.

    Only an endless stream needs a ``delay``: state is bounded then, and events later than
    the watermark are lost.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay is None:
        return timed.dropDuplicates(["event_id"])
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def hourly_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Drain a stream into Parquet in the shared folder and return the table; state is kept on disk."""
    import uuid

    spark, run = stream.sparkSession, uuid.uuid4().hex
    out = f"{shared_dir(spark)}/{name}-{run}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{shared_dir(spark)}/{name}-state-{run}").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.parquet(out)
