"""The registry as a stream: observations arrive as files, each micro-batch upserts the current records.

State is a folder of numbered versions; a batch writes the next one and a pointer row, so a batch that is run again after a
failure overwrites its own version (exactly once). Volatile columns don't make an observation new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators.catalog import current_records


def deduplicated(stream: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """First observation of each key within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, event_time: str, width: str, delay: str, by: str) -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), by).agg(F.count(F.lit(1)).alias("n"))


def replay(spark: SparkSession, source: str, schema, state: str, checkpoint: str, key: str, order: list[str], files_per_batch: int = 1) -> DataFrame:
    """Read all files of ``source`` as a stream, keep the latest observation of each key under ``state``, return it."""

    def upsert(batch: DataFrame, number: int) -> None:
        new = current_records(batch, key, order)
        if number:
            new = current_records(new.unionByName(batch.sparkSession.read.parquet(f"{state}/v{number - 1}")), key, order)
        new.write.mode("overwrite").parquet(f"{state}/v{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress if p["numInputRows"] > 0), default=0)
    return spark.read.parquet(f"{state}/v{last}")
