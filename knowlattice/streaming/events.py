"""Structured Streaming over the event feed: windowed counts with watermarks, sessions, and events told apart once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, table

LATE = "10 minutes"


def unmarked(spark: SparkSession, folder: str) -> DataFrame:
    """The event files of a folder as a stream; new files are new events."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``unmarked`` with a watermark."""
    return unmarked(spark, folder).withWatermark("ts", LATE)


def drained(stream: DataFrame, what: str) -> DataFrame:
    """Runs the stream over what is there (``availableNow``), appends finished rows to the shared folder and reads them."""
    spark = stream.sparkSession
    path = shared_folder(spark, what)
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _counted(stream: DataFrame, window) -> DataFrame:
    found = stream.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and their value by window and type; a window comes out once the watermark has passed its end."""
    return _counted(stream, F.window("ts", width))


def sliding(stream: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    return _counted(stream, F.window("ts", width, slide))


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of one user's events with less than ``gap`` between them."""
    found = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def once(stream: DataFrame) -> DataFrame:
    """Each event once, however often it is sent again before it is too late."""
    return stream.select("event_id", "ts").dropDuplicates(["event_id", "ts"])
