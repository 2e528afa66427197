"""Event-time windows, the same plan for a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """Counts and sums per hour and event type. With ``late`` (a stream) later rows than that are dropped and state is freed."""
    timed = events.filter(F.col("ts").isNotNull())
    if late:
        timed = timed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        hours = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))
        return hours.select(F.col("w.start").alias("hour"), "event_type", "events", "total")
    hours = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return hours.select(F.col("w.start").alias("hour"), "event_type", "events", "total")


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of those there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_deliveries(turns: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of requests without second deliveries, as long as those come within ``late``."""
    return turns.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["request_id"])
