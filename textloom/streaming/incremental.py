"""Structured Streaming over the batch operators: windowed counts, and upserts of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, by, n, total`` by tumbling window; events later than ``late`` are dropped from a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def upserted(stream: DataFrame, path: str, checkpoint: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs ``compute`` on every micro-batch and writes it under its number, so that a repeated batch replaces itself.

    ``latest`` reads the table.
    """

    def one(rows: DataFrame, number: int) -> None:
        compute(rows).withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, key: str) -> DataFrame:
    """The row of the last batch for each key."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    columns = [c for c in rows.columns if c != "_batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("r")).select("r.*")
