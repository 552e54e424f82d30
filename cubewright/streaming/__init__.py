"""Structured Streaming over event tables: windows, sessions, deduplication.

Beyond the measures of a model: the same aggregations kept up to date over a
stream, with watermarks that bound the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, by: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Count, sum and average per window and key; windows overlap if ``slide`` is given."""
    window = F.window(column, size, slide) if slide else F.window(column, size)
    grouped = timed(events, column).withWatermark(column, late).groupBy(window.alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "average")


def sessions(events: DataFrame, by: list[str], gap: str = "30 minutes", late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Events of a key no further apart than ``gap``."""
    grouped = timed(events, column).withWatermark(column, late).groupBy(F.session_window(column, gap).alias("s"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """The first event of each key; state is kept for the watermark's delay only."""
    return timed(events, column).withWatermark(column, late).dropDuplicatesWithinWatermark(keys)
