"""Incremental batches over growing tables: what is new since the last run is read once, and sinks take no record twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame) -> DataFrame:
    """``day, event_type, n, total`` of an events table or stream."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return events.groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n``: counts per tumbling window of a stream; events later than ``late`` behind are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_available(spark: SparkSession, source: str, checkpoint: str, step: Callable[[DataFrame, int], None], fmt: str = "parquet") -> int:
    """Process the files of ``source`` that no earlier run has seen, in batches given to ``step``; returns the number of batches.

    The checkpoint must lie in shared storage; a batch that failed is given to ``step`` again, so ``step`` must be idempotent.
    """
    schema = spark.read.format(fmt).load(source).schema
    seen = []

    def each(batch: DataFrame, number: int) -> None:
        step(batch, number)
        seen.append(number)

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(seen)


def append_new(batch: DataFrame, sink: str, key: str) -> None:
    """Append the rows whose key the sink does not hold yet; a repeated batch adds nothing. One row per key is kept."""
    once = batch.dropDuplicates([key])
    try:
        held = batch.sparkSession.read.parquet(sink).select(key)
        once = once.join(held, key, "left_anti")
    except Exception as e:  # the sink does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    once.write.mode("append").parquet(sink)
