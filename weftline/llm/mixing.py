"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, unpacked_row

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (3, 1, 2)


def _hashed(*columns: Column) -> Column:
    """A 32-bit hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, source_docs, target)`` from ``(source, source_size, source_docs)``.

    Sources take the weights in order of their names (code points; null last). ``share`` times the sum
    of all sizes is dealt by weight; a target stops at ``most`` times its source's size and the excess
    is dealt again. That is one water level: with the sources in order of size over weight, the level
    is what is left after the capped sources over the weights that are left. The table has one row
    for each source, not for each document.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_n", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = every.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", F.col("_left") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the level is that of the first source which it does not fill: of those not filled it is the
    # highest; where it fills all, caps hold
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    target = F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap")))
    return ranked.select("source", "source_size", "source_docs", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    columns: list[str] | None = None,
    **options: object,
) -> DataFrame:
    """Every row of ``docs`` (its ``columns``; all of them by default) with ``_size``,
    ``_source_size``, ``_target`` and ``_copies``, by the options of ``_sampled``, which says how.

    Null texts have size 0; null sources are one source, last in order; null or repeated keys only
    share a place in the order, which then goes by text and other ties are alike in every respect
    that counts. An empty table gives no rows. Columns of ``docs`` stay, whatever their names; only one
    that is called as an added one is replaced by it.
    """
    kept = docs if columns is None else docs.select(*columns)
    return unpacked_row(_sampled(docs, kept.columns, **options), kept, _size="size", _source_size="source_size", _target="target", _copies="copies")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it was drawn."""
    rows = _sampled(docs, docs.columns, all_rows=False, **options)
    return unpacked_row(rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def _sampled(
    docs: DataFrame,
    columns: list[str],
    all_rows: bool = True,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    buckets: int = 256,
) -> DataFrame:
    """``row`` (the ``columns`` of a row of ``docs``), ``size``, ``source_size``, ``target`` and ``copies``.

    Systematic sampling: a document is expected ``target / source_size`` times; the running sum of
    these in its source, from one random offset on, crosses an integer once for each copy. So no
    document comes more often than the rate rounded up, and never more than ``most`` times. The order
    in a source goes by size class, then by one of ``buckets`` hash buckets, then by size, hash and key, so that each
    stretch holds like documents and the words taken come near the target whatever the offset, which is one seeded
    draw for each source; over seeds a document comes as often as it is expected. The order is the same at every
    size of the table: neither classes nor buckets depend on how many rows there are.

    Ranks come from counts of small cells (source, size class, hash bucket) and ranks in a cell, so a
    hot source is never sorted in one task. A class is a number of binary digits and the five after the
    first, so there are 32 for each doubling of the size. Rows that repeat a key (or have none, and the same text)
    are counted by file first and numbered file by file, so they are not one task's work either. Documents of size 0
    are expected alike and take no words. Rows with their texts are written once; what is ranked is a few numbers
    of each, and texts are joined again once, by their place in the files."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    rows = saved(docs.select(row, F.col(key).cast("string").alias("key"), F.col(source).alias("source"), size.alias("size"), _hashed(F.lit(str(seed)), tie).alias("h")))
    at = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("line")]
    bits = F.length(F.bin("size"))  # with the first digits, counted in 32nds
    digits = F.expr("shiftright(shiftleft(size, 5), length(bin(size)) - 1)").cast("int")
    slim = rows.select(*at, "key", "source", "size", "h", (bits * 32 + digits).alias("class"), (F.col("h") % buckets).alias("bucket"))
    # sizes of the sources, and from them targets
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    targets = source_targets(sizes, weights, share, most).select(F.col("source").alias("source_"), "source_size", "target")
    # equal rows of a file are counted, and what stands before them in their cell is summed
    cell, alike = ["source", "class", "bucket"], ["source", "class", "bucket", "size", "h", "key", "file"]
    counts = slim.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    in_cell = F.sum("n").over(Window.partitionBy(*cell).orderBy("size", "h", "key", "file").rowsBetween(Window.unboundedPreceding, -1))
    counts = saved(counts.withColumn("inner", F.coalesce(in_cell, F.lit(0))))
    # what stands before a cell: the classes before, of which a source has some thousand at most, and the buckets before
    # in its class; so no task gets all cells of a source
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda names: reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names))
    cells = counts.groupBy(*cell).agg(F.sum("n").alias("n"))
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    classes = classes.select(F.col("source").alias("source_"), F.col("class").alias("class_"), earlier(["source"], "class").alias("lower"))
    cells = cells.withColumn("before", earlier(["source", "class"], "bucket")).join(classes, same(["source", "class"]))
    cells = cells.join(targets.withColumnRenamed("source_", "of"), F.col("source").eqNullSafe(F.col("of")))
    cells = cells.select(*(F.col(c).alias(f"{c}_") for c in cell), (F.col("lower") + F.col("before")).alias("before"), "source_size", "target")
    counts = counts.join(cells, same(cell)).select(*(F.col(c).alias(f"{c}_") for c in alike), (F.col("before") + F.col("inner")).alias("before"), "source_size", "target")
    numbered = slim.withColumn("rank", F.row_number().over(Window.partitionBy(*alike).orderBy("line"))).join(counts, same(alike))
    place = F.col("before") + F.col("rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hashed(F.lit(f"{seed}:0"), F.coalesce(F.col("source"), F.lit(""))) / 4294967296.0
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    drawn = numbered.select("file", "line", "size", "source_size", "target", F.least(copies, F.lit(int(most))).cast("int").alias("copies"))
    drawn = drawn if all_rows else drawn.where("copies > 0")
    return rows.select(*at, "row").join(drawn, ["file", "line"]).select("row", "size", "source_size", "target", "copies")
