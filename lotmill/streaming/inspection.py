"""Inspection logs as streams: nightly bounded batches, windowed counts, sessions, duplicate suppression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, ddl: str = EVENTS, glob: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream; time columns without zone are taken as UTC."""
    return spark.readStream.schema(ddl).option("pathGlobFilter", glob).parquet(folder)


def windowed(events: DataFrame, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``by, window_start, n, total`` per tumbling or sliding window of ``ts``; rows later than the watermark are dropped by the engine."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(*by, F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``by, session_start, session_end, n`` of runs of events with no gap of that length."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def nightly(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, once, and stop; the checkpoint remembers, so a second run of a day does nothing."""
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a stream into a Parquet table, exactly once."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
