"""Structured Streaming over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, time: str = "ts") -> DataFrame:
    """Parquet files of a folder as they come, with the event time as a timestamp, so that watermarks may be set."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by..., n, total) of tumbling windows; rows later than ``late`` behind the newest are dropped."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counts = marked.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, start, end, n): runs of a key's events less than ``gap`` apart."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    found = marked.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the stream, as a Parquet folder.

    A complete result replaces the one before it; appended rows go to a folder
    for each micro-batch, so that a batch that is run again replaces itself.
    """
    spark, whole = stream.sparkSession, mode == "complete"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={0 if whole else n}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", folder).parquet(f"{folder}/batch=*").select(*stream.columns)


def to_parquet(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """A started query that appends finished windows to a Parquet folder."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def utc_day(time: Column) -> Column:
    return F.date_trunc("day", time)
