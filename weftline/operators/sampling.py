"""Samples of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import dense_order


def _draw(seed: int, of: Column) -> Column:
    """A number from 0 to 2^32 that other engines draw alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), of.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def bootstrap(rows: DataFrame, order: str, seed: int = 0) -> DataFrame:
    """As many draws with replacement as there are rows: ``draw`` numbers them."""
    placed = dense_order(rows, order)
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    draws = placed.select(F.col("_place").alias("draw")).crossJoin(F.broadcast(n))  # n: one row
    draws = draws.select("draw", (F.floor(_draw(seed, F.col("draw")) * F.col("_n") / 4294967296) + 1).alias("_place"))
    return draws.join(placed, "_place").drop("_place")


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: those with the smallest hashes of their keys."""
    return rows.orderBy(_draw(seed, F.col(key)), key).limit(n)
