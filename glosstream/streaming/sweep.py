"""Unfinished work picked up by a stream: each micro-batch routes what is new, and may be repeated without harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unfinished(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.filter(F.col(status).isin("pending", "translating"))


def sweep(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Work off all files that came since the last sweep, then stop.

    Each batch is written under its own number with overwrite: a batch that is
    run again after a failure replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(unfinished(df)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events by type and window with a watermark (an extra of this engine, on a stream or a table)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
