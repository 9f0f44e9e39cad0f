"""Operators on intervals ``(chrom, start, end)``, half open. Joins go by bins of positions, so that
they are equi-joins with a rest condition and never meet all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import saved

BIN = 65_536


def extend(intervals: DataFrame, left: int, right: int) -> DataFrame:
    """Starts ``left`` lower, but not below 0, and ends ``right`` higher."""
    return intervals.withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("start") - left), "end": F.col("end") + right})


def genome_windows(chroms: DataFrame, build: str, size: int, literal: bool = False) -> DataFrame:
    """``(chrom, start, end)``: windows of ``size`` over all chromosomes of a build. The last one ends
    with its chromosome (``literal``: all have full length, and a length that is a multiple has one
    more)."""
    n = F.floor(F.col("size") / size) if literal else F.ceil(F.col("size") / size) - 1
    rows = chroms.where(F.col("build") == build).where((F.col("size") > 0) | F.lit(literal))
    rows = rows.select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("k"))
    end = (F.col("k") + 1) * size
    return rows.select("chrom", (F.col("k") * size).alias("start"), (end if literal else F.least(end, F.col("size"))).alias("end"))


def merge_overlaps(intervals: DataFrame, by: list[str] | None = None, cell: int = BIN) -> DataFrame:
    """The covered bases as intervals that neither overlap nor touch, for each chromosome (and for
    each value of ``by``). Empty intervals cover nothing.

    Equal starts meet first, so a cell of positions has one row for each at most. Each cell is a task's work; how far the cells before it reach, and where the
    cover that is open at its start began, comes from one row for each of them."""
    keys = [*(by or []), "chrom"]
    rows = intervals.where("start < end").select(*keys, "start", "end").withColumn("_cell", F.floor(F.col("start") / cell))
    rows = saved(rows.groupBy(*keys, "_cell", "start").agg(F.max("end").alias("end")))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda df, c, name: df.groupBy(*keys, "_cell").agg(F.max(c).alias(name)).withColumn(name, F.max(name).over(earlier))
    here = Window.partitionBy(*keys, "_cell").orderBy("start")
    reach = F.greatest("_reach", F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.join(carried(rows, "end", "_reach"), [*keys, "_cell"])
    marked = marked.withColumn("_new", F.when(F.coalesce(F.col("start") <= reach, F.lit(False)), None).otherwise(F.col("start"))).drop("_reach")
    marked = saved(marked.withColumn("_run", F.max("_new").over(here)))
    rows = marked.join(carried(marked, "_new", "_open"), [*keys, "_cell"])
    return rows.groupBy(*keys, F.coalesce("_run", "_open").alias("start")).agg(F.max("end").alias("end")).select(*keys, "start", "end")


def _bins(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor((F.greatest(start + 1, end) - 1) / size)))


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Pairs of rows on one chromosome that share a base; the columns of ``right`` but for ``chrom``
    get ``r_`` before their names. A pair meets in the bin of its first shared base only."""
    a = left.withColumn("_bin", _bins(F.col("start"), F.col("end"), bin_size))
    b = right.select(*(F.col(c).alias(c if c == "chrom" else f"r_{c}") for c in right.columns))
    b = b.withColumn("_bin", _bins(F.col("r_start"), F.col("r_end"), bin_size))
    pairs = a.join(b, ["chrom", "_bin"]).where("start < r_end and r_start < end")
    return pairs.where(F.floor(F.greatest("start", "r_start") / bin_size) == F.col("_bin")).drop("_bin")


def first_partition(intervals: DataFrame, partitions: DataFrame, key: str = "row_idx") -> DataFrame:
    """Each interval with the ``name`` and ``score`` of the first partition (by ``ord``) that it shares a
    base with, and ``frac_overlap``, the share of its bases there (the double rounded to four decimals, ties to even); without one ``OTHER``, -1 and 1.

    ``partitions`` is ``(ord, name, score, chrom, start, end)``; overlapping intervals of a partition
    count once. An empty interval is of no partition."""
    names = partitions.select("ord", "name", "score").distinct()
    merged = merge_overlaps(partitions, ["ord"])
    shared = overlap_join(intervals.select(key, "chrom", "start", "end"), merged)
    shared = shared.groupBy(key, F.col("r_ord").alias("ord")).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("bases"))
    best = shared.groupBy(key).agg(F.min(F.struct("ord", "bases")).alias("_b")).select(key, F.col("_b.ord").alias("ord"), F.col("_b.bases").alias("bases"))
    best = best.join(names, "ord").drop("ord")
    out = intervals.join(best, key, "left")
    frac = F.when(F.col("bases").isNull(), F.lit(1.0)).otherwise(F.col("bases") / (F.col("end") - F.col("start")))
    return out.select(*intervals.columns, F.coalesce("name", F.lit("OTHER")).alias("name"), F.coalesce("score", F.lit("-1")).alias("score"), F.format_number(frac, 4).alias("frac_overlap"))


def fuse_for_intervals(intervals: DataFrame, pieces: DataFrame, spacer: int = 10, key: str = "row_idx") -> DataFrame:
    """``(row_idx, n_blocks, text)``: the texts of the pieces ``(chrom, start, end, text)`` that an
    interval meets, in order, with gaps between those that do not touch; a null text where there is none."""
    hits = overlap_join(intervals.select(key, "chrom", "start", "end"), pieces.select("chrom", "start", "end", "text"))
    lists = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("r_start").alias("s"), F.col("r_end").alias("e"), F.col("r_text").alias("t")))).alias("_p"))
    gap = F.lit("-" * spacer)
    whole = F.aggregate(
        "_p",
        F.struct(F.lit(None).cast("long").alias("e"), F.lit("").alias("t")),
        lambda x, p: F.struct(p["e"].alias("e"), F.concat(x["t"], F.when(x["e"].isNull() | (x["e"] == p["s"]), F.lit("")).otherwise(gap), p["t"]).alias("t")),
    )
    out = intervals.select(key).join(lists.select(key, F.size("_p").alias("n_blocks"), whole["t"].alias("text")), key, "left")
    return out.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))


def blocks_for_intervals(intervals: DataFrame, blocks: DataFrame, species: list[str], spacer: int = 10, key: str = "row_idx") -> DataFrame:
    """``(row_idx, components)``: one block for each interval ``(chrom, start, end)``, ``chrom`` being the source
    of blocks' first components, and places those on the component's own strand.

    The blocks that an interval meets are put in order and neighbours that go on (on one source and
    strand, in all components) are fused. If one block is left it is the result; of several the texts are
    joined with ``spacer`` gaps, as components without a place; without any their texts are empty.
    """
    c = F.get("components", F.lit(0))
    pieces = blocks.select(c["src"].alias("chrom"), c["start"].alias("start"), (c["start"] + c["size"]).alias("end"), "components")
    hits = overlap_join(intervals.select(key, "chrom", "start", "end"), pieces)
    lists = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("r_start", "r_end", F.col("r_components").alias("b")))).alias("_p"))
    on = lambda a, b: (a["src"] == b["src"]) & (a["strand"] == b["strand"]) & (a["start"] + a["size"] == b["start"])
    grown = lambda a, b: a.withField("text", F.concat(a["text"], b["text"])).withField("size", a["size"] + b["size"])

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(last) == F.size(p["b"])) & F.forall(F.zip_with(last, p["b"], on), lambda x: F.coalesce(x, F.lit(False)))
        fused = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.zip_with(last, p["b"], grown)))
        return F.when(F.coalesce(joins, F.lit(False)), fused).otherwise(F.concat(done, F.array(p["b"])))

    kind = blocks.schema["components"].dataType.simpleString()
    runs = lists.select(key, F.aggregate("_p", F.array().cast(f"array<{kind}>"), step).alias("_r"))
    runs = intervals.select(key).join(runs, key, "left").withColumn("_r", F.coalesce("_r", F.array().cast(f"array<{kind}>")))

    def fake(name: Column, i: Column) -> Column:
        text = F.array_join(F.transform("_r", lambda b: F.get(b, i)["text"]), "-" * spacer)
        size = F.length(F.replace(text, F.lit("-"), F.lit(""))).cast("long")
        return F.struct(F.concat(name, F.lit(".fake")).alias("src"), F.lit(0).cast("long").alias("start"), size.alias("size"), F.lit("?").alias("strand"), size.alias("src_size"), text.alias("text"))

    fakes = F.transform(F.array(*map(F.lit, species)), fake)
    return runs.select(key, F.when(F.size("_r") == 1, F.get("_r", F.lit(0))).otherwise(fakes).alias("components"))


def fetch_sequences(intervals: DataFrame, tiles: DataFrame, tile: int, key: str = "row_idx") -> DataFrame:
    """Intervals with ``seq``, from a store cut into tiles ``(chrom, tile_no, seq)`` of one length."""
    asks = intervals.where("start < end").select(key, "chrom", "start", "end").withColumn("tile_no", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))))
    parts = asks.join(tiles, ["chrom", "tile_no"])
    low = F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("tile_no") * tile)
    high = F.least(F.lit(tile).cast("long"), F.col("end") - F.col("tile_no") * tile)
    parts = parts.withColumn("part", F.substring("seq", (low + 1).cast("int"), (high - low).cast("int")))
    whole = parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tile_no", "part"))), lambda p: p["part"]), "").alias("seq"))
    return intervals.join(whole, key, "left")
