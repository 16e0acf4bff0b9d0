"""Incremental ingest: new result files into the fact table and its running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, by: list[str]) -> StreamingQuery:
    """Append files that have come since the last run to a partitioned Parquet table, then stop.

    The checkpoint remembers which files are done, so a run that fails is repeated without loss
    or repetition.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy(*by).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean values by window and key of a stream or table, for rows not later than ``late``."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")
