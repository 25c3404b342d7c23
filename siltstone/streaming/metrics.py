"""Structured Streaming forms: replays of a Parquet log with ``availableNow``, held against the batch answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.storage import is_folder, new_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's is UTC by contract.

    A table of part files is a folder and streamed as one. A stream's source can't be a single file, so that is
    picked by name out of its own folder, not out of those below.
    """
    source, table = spark.readStream.schema(EVENTS), f"{sf_dir}/events.parquet"
    raw = source.parquet(table) if is_folder(spark, table) else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def replayed(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is now, into a Parquet table in the shared folder, with its checkpoint beside it."""
    spark = stream.sparkSession
    folder = new_folder(spark, "replay")
    rows = new_folder(spark, "rows", folder)  # a stream without any file writes nothing
    if mode == "append":
        appended_log(stream, rows, f"{folder}/checkpoint")
    else:
        whole = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
        whole.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)


def windowed(events: DataFrame, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows, with a watermark that bounds the state."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w")["start"].cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """A user's events less than ``gap`` apart; a session comes out once the watermark has passed it."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w")["start"].cast("timestamp_ntz").alias("session_start"), "n")


def appended_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The request-log sink: appends what is new, exactly once by the checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
