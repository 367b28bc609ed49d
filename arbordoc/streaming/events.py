"""Extensions beyond lookups: windows over a stream of JSON properties. The same function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_get


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream; the schema is read from the files that are there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark; Spark wants a time of the session's zone there (UTC in this engine's sessions)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def tumbling_stats(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Per window and event type: n and the sum of property k. State is dropped once the watermark, `late` behind the newest event, has passed a window's end."""
    e = _marked(events, ts, late)
    g = e.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(path_get(F.col("props"), "k", to="long")).alias("sum_k"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "sum_k")


def first_of_each(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key's row once, within the watermark: dedup of a stream with bounded state."""
    if events.isStreaming:
        return _marked(events, ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
