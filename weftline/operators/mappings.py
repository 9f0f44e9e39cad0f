"""Mappings from keys to symbols, ``(key, symbol)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as W


def last_wins(mapping: DataFrame, order: str = "line_no") -> DataFrame:
    """A mapping with one row for each key: the last by line."""
    return mapping.groupBy("key").agg(F.max_by("symbol", order).alias("symbol"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """``key`` to the symbol that ``second`` has for ``first``'s symbol; a symbol without one is an error."""
    to = second.select(F.col("key").alias("symbol"), F.col("symbol").alias("_to"))
    missing = F.raise_error(F.concat(F.lit("no symbol for "), F.col("symbol"))).cast("string")
    return first.join(to, "symbol", "left").select("key", F.coalesce("_to", missing).alias("symbol"))


def convert_missing(mapping: DataFrame, most: int, replace: bool = False) -> DataFrame:
    """Keys with more than ``most`` wildcards map to -1. With ``replace`` the others that have some map
    as the key with gaps for wildcards does, which has to be there."""
    wild = W.count_of(F.col("key"), W.WILDCARD)
    if not replace:
        return mapping.withColumn("symbol", F.when(wild > most, "-1").otherwise(F.col("symbol")))
    plain = mapping.select(F.col("key").alias("_plain"), F.col("symbol").alias("_to"))
    rows = mapping.withColumn("_plain", F.replace("key", F.lit(W.WILDCARD), F.lit("-"))).join(plain, "_plain", "left")
    missing = F.raise_error(F.concat(F.lit("no symbol for "), F.col("_plain"))).cast("string")
    return rows.withColumn("symbol", F.when(wild > most, "-1").when(wild > 0, F.coalesce("_to", missing)).otherwise(F.col("symbol"))).select(*mapping.columns)


def from_clusters(distributions: DataFrame, trace: DataFrame, clusters: int) -> DataFrame:
    """``(key, symbol)``: the clusters of the trace's row for ``clusters``, given to the names of the
    distributions ``(row_idx, key)`` by place. Both have to be of one length."""
    return from_assignments(distributions, trace.where(F.col("n_clusters") == clusters).limit(1).select(F.posexplode("assign").alias("row_idx", "symbol")))


def from_assignments(distributions: DataFrame, assigned: DataFrame) -> DataFrame:
    """The same for clusters in long form, ``(row_idx, symbol)``."""
    rows = distributions.select("row_idx", "key").join(assigned, "row_idx", "full")
    bad = F.raise_error(F.lit("as many clusters as names are asked for")).cast("string")
    return rows.select("key", F.when(F.col("key").isNull() | F.col("symbol").isNull(), bad).otherwise(F.col("symbol").cast("string")).alias("symbol"))


def ordered_words(spark, radix: int, length: int = 3) -> DataFrame:  # noqa: ANN001
    """``(row, word)``: all words of ``length`` symbols, numbered with the first symbol the highest
    digit, written the other way round."""
    digits = [(F.floor(F.col("id") / radix**k) % radix).cast("string") for k in range(length)]
    return spark.range(radix**length).select(F.col("id").alias("row"), F.concat_ws(" ", *digits).alias("word"))


def symbol_members(mapping: DataFrame) -> DataFrame:
    """``(symbol, keys)``: the keys of each symbol in order, joined by spaces."""
    lists = mapping.groupBy("symbol").agg(F.sort_array(F.collect_list("key")).alias("_k"))
    return lists.select("symbol", F.array_join("_k", " ").alias("keys"))
