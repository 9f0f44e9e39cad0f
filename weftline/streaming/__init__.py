"""Blocks and intervals as streams: the filters and projections hold no state and work on both; counts
of columns and windows of events keep state in Spark, behind a watermark where time bounds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as W
from ..operators import blocks as B


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the rows of Parquet files as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def clean_blocks(blocks: DataFrame, min_good: int, max_wildcards: int) -> DataFrame:
    """Plain characters, then blocks with enough good columns."""
    return B.filter_max_wildcards(B.translate_chars(blocks), min_good, max_wildcards)


def running_column_counts(blocks: DataFrame) -> DataFrame:
    """``(key, count)`` so far; the state is bounded by the number of possible columns."""
    return blocks.select(F.explode(W.text_columns(F.col("components"))).alias("key")).groupBy(F.upper("key").alias("key")).agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """``(start, by, n)``: rows of each value by windows of time; rows later than ``late`` are dropped by
    the watermark, as are windows that are over."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
