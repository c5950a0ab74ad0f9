"""Incremental ingest with Structured Streaming: micro-batches, checkpoints and idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 4) -> DataFrame:
    """A stream of Parquet files, so many to a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(stream: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """The first row of every key; keys are remembered for as long as rows may be late."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there, batch by batch, resuming where the checkpoint ends."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_sink(spark: SparkSession, folder: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A sink that merges each batch into a versioned Parquet table.

    Of all rows of a key, stored or new, the one with the greatest ``order``
    stays, in whatever order and batches they arrive.
    A batch writes the version that bears its number and reads the one before
    it, so a batch that is repeated after a failure gives the same table. Older
    versions than those two are removed.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    settings = spark.sparkContext._jsc.hadoopConfiguration()

    def sink(batch: DataFrame, number: int) -> None:
        values = [c for c in batch.columns if c != key]
        rows = batch.where(F.col(key).isNotNull())
        if number > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/v{number - 1}"))
        last = rows.groupBy(key).agg(F.max(F.struct(order, *(c for c in values if c != order))).alias("x"))
        merged = last.select(key, *(F.col(f"x.{c}").alias(c) for c in values))
        merged.write.mode("overwrite").parquet(f"{folder}/v{number}")
        if number > 1:
            old = hadoop(f"{folder}/v{number - 2}")
            old.getFileSystem(settings).delete(old, True)

    return sink
