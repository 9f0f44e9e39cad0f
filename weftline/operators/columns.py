"""Counts of alignment columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as W
from ..sources import numbered_rows


def distinct_columns(lists: pa.Array, shortest: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of lists of texts that are laid above each other the different columns, upper-cased, which of them each column is, and how many columns each list has: as many as its
    first text has characters, or as its ``shortest`` has; none, if a text is null."""
    k = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat, begin = lists.flatten().cast(pa.string()), np.cumsum(k) - k
    null = np.bincount(np.repeat(np.arange(len(k)), k)[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(k)) > 0
    flat = pc.utf8_upper(pc.fill_null(flat, ""))
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    # characters as numbers, four bytes each
    text = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    start, n, some = np.cumsum(length) - length, np.zeros(len(k), np.int64), np.flatnonzero((k > 0) & ~null)
    if len(some):
        least = np.full(len(k), np.iinfo(np.int64).max)
        np.minimum.at(least, np.repeat(np.arange(len(k)), k), length)
        n[some] = least[some] if shortest else length[begin[some]]
    row = np.repeat(np.arange(len(k)), n)
    place, code = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), np.zeros(len(row), np.int64)
    base = int(text.max(initial=0)) + 2
    for d in range(int(k.max(initial=0))):
        if code.max(initial=0) > 2**62 // base:
            code = np.unique(code, return_inverse=True)[1] + 1
        at = np.flatnonzero(d < k[row])
        one = begin[row[at]] + d
        at, one = (v[place[at] < length[one]] for v in (at, one))
        code[at] = code[at] * base + text[start[one] + place[at]] + 1
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    every = flat.to_pylist()
    return ["".join(t[j : j + 1] for t in every[begin[r] : begin[r] + k[r]]) for r, j in zip(row[first].tolist(), place[first].tolist(), strict=True)], which, n


def column_space(spark, width: int, alphabet: str = W.ALPHABET, wildcards: int | None = 0) -> DataFrame:  # noqa: ANN001
    """``(key, key_ord)``: all words of ``width`` characters with at most ``wildcards`` wildcards (none
    by default), but for the one of gaps alone, in order of the alphabet. Numbers are decoded, not
    multiplied out of joins."""
    letters = alphabet + (W.WILDCARD if wildcards else "")
    n = len(letters)
    ids = spark.range(n**width)
    places = [(F.floor(F.col("id") / n ** (width - 1 - k)) % n + 1).cast("int") for k in range(width)]
    key = F.concat(*(F.substring(F.lit(letters), p, F.lit(1)) for p in places))
    words = ids.select(key.alias("key"), F.col("id").alias("key_ord")).where(F.col("key") != "-" * width)
    return words.where(W.count_of(F.col("key"), W.WILDCARD) <= (wildcards or 0))


def column_counts(blocks: DataFrame) -> DataFrame:
    """``(key, count)`` of the columns of all blocks, upper-cased."""
    columns = blocks.select(F.explode(W.text_columns(F.col("components"))).alias("key"))
    return columns.groupBy(F.upper("key").alias("key")).agg(F.count(F.lit(1)).alias("count"))


def dense_column_counts(blocks: DataFrame, width: int, wildcards: int | None = 0) -> DataFrame:
    """``(key, key_ord, count)`` for every possible column, 0 for those that do not occur; columns with
    other characters or of gaps alone are left out."""
    space = column_space(blocks.sparkSession, width, wildcards=wildcards)
    counts = column_counts(blocks)
    return space.join(counts, "key", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def sufficient_statistics(blocks: DataFrame, species: list[str]) -> DataFrame:
    """``(i, key, count)``: columns of the named species, wildcards for one that a block lacks,
    numbered in order of the columns. The first species has to be in every block."""
    n = F.length(F.get("components", F.lit(0))["text"])
    texts = []
    for k, s in enumerate(species):
        found = F.upper(W.component(F.col("components"), s)["text"])
        missing = F.raise_error(F.lit(f"a block lacks {s}")).cast("string") if k == 0 else F.repeat(F.lit(W.WILDCARD), n)
        texts.append(F.coalesce(found, missing))

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, which, _ = distinct_columns(part.column(0), shortest=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.bincount(which, minlength=len(keys)).astype(np.int64))], names=["key", "n"])

    counts = blocks.select(F.array(*texts).alias("t")).mapInArrow(counted, "key string, n long").groupBy("key").agg(F.sum("n").alias("count"))
    # raw texts of many species can have any number of different columns
    return numbered_rows(counts, ["key"], "i").select((F.col("i") - 1).cast("int").alias("i"), "key", "count")
