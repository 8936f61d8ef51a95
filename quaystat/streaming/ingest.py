"""Bronze ingestion as a stream of files: new rows only, idempotent by key within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events of the Parquet files that arrive in a folder, once each."""
    src = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return src.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])


def hourly(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch once; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
