"""Blocks cut and laid over intervals of their first component: ranges taken out of blocks, blocks chopped, the best block for
each base, and how deep bases are covered.

Intervals are ``(row_idx, chrom, start, end)`` on the forward strand, half open, ``chrom`` being the part of the first component's
source after its first dot. What programs of these names do elsewhere is not given; the definitions are our own."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as W
from ..sources import saved
from .intervals import overlap_join

#: How many positions of a chromosome are one task's work.
CELL = 65_536

#: How many pieces a task lays over each other at once.
ROWS = 200_000

#: The bins in which ranges and blocks meet: about as long as these, so that many of either on a short stretch are many bins' work.
RANGE_BIN = 2_048

#: The bases and what pairs with each, as two texts.
COMPLEMENT = ("ACGTacgt", "TGCAtgca")


def _bases(text: Column) -> Column:
    """How many characters of a text are not gaps."""
    return F.length(F.replace(text, F.lit("-"), F.lit(""))).cast("long")


def cut_columns(components: Column, first: Column, n: Column) -> Column:
    """Components of ``n`` columns from ``first`` (from 0) on: texts cut, starts moved by the bases before the cut, sizes counted."""

    def cut(c: Column) -> Column:
        text = F.substring(c["text"], first + 1, n)
        moved = c["start"] + _bases(F.substring(c["text"], F.lit(1), first))
        return c.withField("text", text).withField("start", moved).withField("size", _bases(text))

    return F.transform(components, cut)


def reverse_complement(components: Column) -> Column:
    """Components read from the other strand: texts turned round with each base's counterpart, starts counted from the other end."""

    def turned(c: Column) -> Column:
        text = F.translate(F.reverse(c["text"]), *COMPLEMENT)
        start = c["src_size"] - (c["start"] + c["size"])
        return c.withField("text", text).withField("start", start).withField("strand", F.when(c["strand"] == "-", "+").otherwise("-"))

    return F.transform(components, turned)


def extract_ranges(intervals: DataFrame, blocks: DataFrame, chop: bool = True, by_strand: bool = False, key: str = "row_idx") -> DataFrame:
    """``(row_idx, block_id, components)`` for each interval and block that share a base of the block's first component.

    With ``chop`` the block is cut to the interval: to its columns from that of the first shared base to that of the last one, on whichever
    strand the first component is; the other components' starts move by the bases before the cut. A component without a base in the cut stays, with size 0.
    ``by_strand``: intervals have a ``strand``, and the blocks of one on ``-`` are turned to it, so that the first component runs as the interval does."""
    c0 = F.get("components", F.lit(0))
    # the column of each base of the first component, where the texts before it end: once for each block, not for each pair
    columns = F.filter(F.transform(W.chars(c0["text"]), lambda ch, i: F.when(ch != "-", i)), lambda i: i.isNotNull())
    placed = blocks.select(W.chrom_of(c0["src"]).alias("chrom"), W.forward_start(c0).alias("start"), W.forward_end(c0).alias("end"), "block_id", "components", *([columns.alias("columns")] if chop else []))
    side = ["strand"] if by_strand else []
    # saved, so that what is asked of the cut components is not worked out for each pair of the join and each block before it
    hits = saved(overlap_join(intervals.select(key, "chrom", "start", "end", *side), placed, RANGE_BIN))
    c0 = F.get("r_components", F.lit(0))
    if chop:
        # which bases of the first component, in the order in which it is written
        low, high = F.greatest("start", "r_start"), F.least("end", "r_end")
        first = F.when(c0["strand"] == "-", F.col("r_end") - high).otherwise(low - F.col("r_start")).cast("int")
        n = (high - low).cast("int")
        hits = hits.withColumns({"_first": first, "_n": n})
        start, last = F.get("r_columns", F.col("_first")), F.get("r_columns", F.col("_first") + F.col("_n") - 1)
        hits = hits.withColumns({"_at": start, "_wide": last - start + 1}).where("_wide > 0")
        components = cut_columns(F.col("r_components"), F.col("_at"), F.col("_wide"))
    else:
        components = F.col("r_components")
    if by_strand:
        # a turned block, if the first component runs the other way than the interval asks
        hits = hits.withColumn("_c", components)
        components = F.when(F.get("_c", F.lit(0))["strand"] != F.when(F.col("strand") == "-", "-").otherwise("+"), reverse_complement(F.col("_c"))).otherwise(F.col("_c"))
    return hits.select(key, F.col("r_block_id").alias("block_id"), components.alias("components"))


def chop_blocks(blocks: DataFrame, length: int = 500) -> DataFrame:
    """``(block_id, piece, components)``: blocks in pieces of at most ``length`` columns, from 0 on; starts are those of the pieces. A block
    without columns is one piece."""
    n = F.coalesce(F.length(F.get("components", F.lit(0))["text"]), F.lit(0))
    rows = blocks.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / length) - 1, F.lit(0)).cast("int"))).alias("piece"))
    cut = cut_columns(F.col("components"), F.col("piece") * length, F.lit(length))
    return rows.select(*(c for c in blocks.columns if c != "components"), "piece", cut.alias("components"))


def _painted(start: np.ndarray, end: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, which)``: maximal stretches and, of the segments that hold one, the first by ``order``. Segments are painted over each other,
    the last first, on the places where any of them begins or ends."""
    cuts = np.unique(np.concatenate([start, end]))
    owner = np.full(len(cuts), -1, np.int64)
    a, b = np.searchsorted(cuts, start), np.searchsorted(cuts, end)
    for k in order[::-1].tolist():
        owner[a[k] : b[k]] = k
    edge = np.flatnonzero(np.diff(owner, prepend=-2))
    edge = edge[owner[edge] >= 0]
    ends = np.flatnonzero(np.diff(owner, append=-2)) + 1
    ends = ends[owner[ends - 1] >= 0]
    return cuts[edge], cuts[np.minimum(ends, len(cuts) - 1)], owner[edge]


def best_cover(pieces: DataFrame, cell: int = CELL, fan_in: int = 16) -> DataFrame:
    """``(chrom, start, end, id)``: for each base that pieces ``(chrom, start, end, score, id)`` cover, the best of them, as maximal stretches.
    The best has the highest score (a null one is the lowest), then the smallest start, then the smallest id.

    Pieces are cut at cells of positions. What is best of some is known without the rest, so tasks first put together what they
    have, ``ROWS`` at a time: of any number of pieces in a cell at most one stretch for each position is left. These meet by cells, first in ``fan_in`` groups, then at once.
    All cells that a task has at hand are painted together, as cells may be many and have few pieces each."""
    kind = pieces.schema["id"].dataType.simpleString()
    # empty pieces go in the tasks below: a condition here would work out anew, for each place that it reads, what pieces are made of
    rows = pieces.select("chrom", "start", "end", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score"), F.col("start").alias("first"), "id")
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    rows = rows.withColumns({"start": F.greatest("start", F.col("cell") * cell), "end": F.least("end", (F.col("cell") + 1) * cell)})
    columns = ["chrom", "cell", "start", "end", "score", "first", "id"]
    rows = rows.select(columns)

    def best(table: pa.Table) -> pa.Table:
        """Of the pieces of any cells, in whose order the stretches come."""
        table = table.filter(pc.less(table.column("start"), table.column("end")))
        # the first by priority is painted last: ids sort as Arrow sorts them
        table = table.sort_by([("score", "descending"), ("first", "ascending"), ("id", "ascending")]).combine_chunks()
        if not len(table):
            return table
        chrom = pc.dictionary_encode(table.column("chrom").combine_chunks(), null_encoding="encode").indices.to_numpy().astype(np.int64)
        cells = table.column("cell").to_numpy()
        _, place = np.unique(chrom * (cells.max() - cells.min() + 1) + (cells - cells.min()), return_inverse=True)
        # cells are laid behind each other on one line; a piece lies in one of them, so no stretch goes on to the next
        shift = (place - cells) * cell
        start, end, which = _painted(table.column("start").to_numpy() + shift, table.column("end").to_numpy() + shift, np.arange(len(table)))
        kept = table.take(pa.array(which))
        for name, values in (("start", start), ("end", end)):
            kept = kept.set_column(kept.schema.get_field_index(name), name, pa.array(values - shift[which], pa.int64()))
        return kept.select(columns)

    def laid(batches: Iterator[pa.RecordBatch], by_cell: bool) -> Iterator[pa.RecordBatch]:
        """Stretches of some rows at a time; where rows come ``by_cell`` the last cell waits for more of it."""
        held: list[pa.RecordBatch] = []
        n, some = 0, (b for b in batches if b.num_rows)
        for b in chain(some, [None]):
            if b is not None:
                held.append(b)
                n += b.num_rows
                if n < ROWS:
                    continue
            if not held:
                continue
            chrom, at = held[-1].column("chrom")[-1], held[-1].column("cell")[-1]
            table = best(pa.Table.from_batches(held)) if n else pa.Table.from_batches(held)
            held, n = [], 0
            if by_cell and b is not None:
                of = table.column("chrom")
                waits = pc.and_(pc.equal(of, chrom) if chrom.is_valid else pc.is_null(of), pc.equal(table.column("cell"), at))
                held = table.filter(waits).combine_chunks().to_batches()
                table = table.filter(pc.invert(waits))
            yield from table.combine_chunks().to_batches()

    shape = f"chrom string, cell long, start long, end long, score double, first long, id {kind}"
    rows = rows.mapInArrow(lambda batches: laid(batches, by_cell=False), shape)
    for deal in (["chrom", "cell", F.pmod(F.xxhash64("start", "id"), F.lit(fan_in))], ["chrom", "cell"]):
        rows = rows.repartition(*deal).sortWithinPartitions("chrom", "cell").mapInArrow(lambda batches: laid(batches, by_cell=True), shape)
    # saved, as they are read twice; stretches that go on from one cell to the next are one again; an id has one for each cell that it lies in, at most
    rows = saved(rows.select("chrom", "start", "end", "id"))
    order = Window.partitionBy("chrom", "id").orderBy("start")
    edge = (F.pmod("start", F.lit(cell)) == 0) | (F.pmod("end", F.lit(cell)) == 0)
    new = F.coalesce((F.lag("end").over(order) < F.col("start")).cast("int"), F.lit(1))
    runs = rows.where(edge).withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("chrom", "id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return rows.where(~edge).unionByName(runs.select(rows.columns))


def tile_blocks(intervals: DataFrame, blocks: DataFrame, species: list[str], by_strand: bool = False, key: str = "row_idx") -> DataFrame:
    """``(row_idx, components)``: one block of the named species for each interval, with a column for each of its bases and for what the best
    blocks have between them.

    Each base is taken from the best block over it (``best_cover`` by ``score``, if blocks have one); each maximal stretch of one block is cut out of it
    (``extract_ranges``), turned to the forward strand (or that of the interval, ``by_strand``) and they are joined in order. Bases that no block has, and species
    that a block lacks, are wildcards. The first component has the interval's place, the others, put together from many places, none: they are called ``.tiled``.
    An empty interval has empty texts."""
    c0 = F.get("components", F.lit(0))
    score = F.col("score") if "score" in blocks.columns else F.lit(None).cast("double")
    # saved, as conditions on places would work out anew what blocks are made of
    pieces = saved(blocks.select(W.chrom_of(c0["src"]).alias("chrom"), W.forward_start(c0).alias("start"), W.forward_end(c0).alias("end"), score.alias("score"), F.col("block_id").alias("id")))
    # only blocks in bins that intervals meet can be over a base of one
    bins = lambda df: df.where("start < end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / RANGE_BIN), F.floor((F.col("end") - 1) / RANGE_BIN))))
    met = saved(bins(intervals).select("chrom", "_bin").distinct())
    cover = best_cover(bins(pieces).join(met, ["chrom", "_bin"], "left_semi").drop("_bin").distinct())
    hits = overlap_join(intervals.where("start < end").select(key, "chrom", "start", "end"), cover, RANGE_BIN)
    parts = saved(hits.select(key, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), F.col("r_id").alias("block_id")))
    # texts and the column of each base: once for each block that is the best somewhere, not for each stretch of each interval
    best = blocks.join(saved(parts.select("block_id").distinct()), "block_id", "left_semi")
    columns = F.filter(F.transform(W.chars(c0["text"]), lambda ch, i: F.when(ch != "-", i)), lambda i: i.isNotNull())
    texts = F.array(*(F.coalesce(W.component(F.col("components"), s)["text"], F.repeat(F.lit(W.WILDCARD), F.length(c0["text"]))) for s in species))
    best = saved(best.select("block_id", (c0["strand"] == "-").alias("_back"), W.forward_start(c0).alias("_low"), W.forward_end(c0).alias("_high"), columns.alias("_columns"), texts.alias("_texts")))
    asked = parts.join(best, "block_id")
    # each stretch is cut out of its own block alone, and turned to the forward strand
    first = F.when(F.col("_back"), F.col("_high") - F.col("end")).otherwise(F.col("start") - F.col("_low")).cast("int")
    asked = asked.withColumn("_first", first)
    at, last = F.get("_columns", F.col("_first")), F.get("_columns", F.col("_first") + (F.col("end") - F.col("start")).cast("int") - 1)
    cut = F.transform("_texts", lambda t: F.substring(t, F.col("_at") + 1, F.col("_wide")))
    turned = F.transform("_cut", lambda t: F.translate(F.reverse(t), *COMPLEMENT))
    asked = asked.withColumns({"_at": at, "_wide": last - at + 1}).withColumn("_cut", cut).withColumn("_cut", F.when(F.col("_back"), turned).otherwise(F.col("_cut")))
    lists = asked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("_cut").alias("t")))).alias("_p"))
    strand = [F.col("strand")] if by_strand else []
    rows = intervals.select(key, "chrom", "start", "end", *strand).join(lists, key, "left").withColumn("_p", F.coalesce("_p", F.array().cast(lists.schema["_p"].dataType)))
    gap = lambda n: F.repeat(F.lit(W.WILDCARD), n.cast("int"))

    def text(i: int) -> Column:
        """A species' text: its parts, and wildcards where there is none."""
        step = lambda x, p: F.struct(F.concat(x["t"], gap(p["start"] - x["at"]), p["t"][i]).alias("t"), p["end"].alias("at"))
        whole = F.aggregate("_p", F.struct(F.lit("").alias("t"), F.col("start").alias("at")), step, lambda x: F.concat(x["t"], gap(F.greatest(F.col("end") - x["at"], F.lit(0)))))
        return F.when(F.col("strand") == "-", F.translate(F.reverse(whole), *COMPLEMENT)).otherwise(whole) if by_strand else whole

    rows = rows.withColumn("_t", F.array(*map(text, range(len(species)))))
    ref = F.concat(F.lit(f"{species[0]}."), "chrom")
    run = F.when(F.col("strand") == "-", "-").otherwise("+") if by_strand else F.lit("+")
    first_ = F.struct(ref.alias("src"), F.col("start").alias("start"), F.greatest(F.col("end") - F.col("start"), F.lit(0)).alias("size"), run.alias("strand"), F.lit(None).cast("long").alias("src_size"), F.col("_t")[0].alias("text"))
    others = [
        F.struct(F.lit(f"{s}.tiled").alias("src"), F.lit(0).cast("long").alias("start"), F.length(F.regexp_replace(F.col("_t")[i], "[-*]", "")).cast("long").alias("size"), F.lit("+").alias("strand"), F.lit(None).cast("long").alias("src_size"), F.col("_t")[i].alias("text"))
        for i, s in enumerate(species) if i
    ]
    return rows.select(key, F.array(first_, *others).alias("components"))


def cover_depth(intervals: DataFrame, cell: int = CELL) -> DataFrame:
    """``(chrom, start, end, depth)``: maximal stretches of bases that equally many intervals cover, one at least.

    Signed events (one more where an interval starts, one less where it ends) are summed for each position, so intervals that start together are one row. Each cell of
    positions adds up its own events; what is open where it starts comes from the sums of the cells before it, of which there is one row each."""
    events = intervals.where("start < end").select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    events = events.select("chrom", "e.pos", "e.d").groupBy("chrom", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    events = events.withColumn("_cell", F.floor(F.col("pos") / cell))
    cells = events.groupBy("chrom", "_cell").agg(F.sum("d").alias("_sum"), F.min("pos").alias("_first"))
    order = Window.partitionBy("chrom").orderBy("_cell")
    cells = cells.select("chrom", "_cell", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_open"), F.lead("_first").over(order).alias("_next"))
    here = Window.partitionBy("chrom", "_cell").orderBy("pos")
    rows = events.join(cells, ["chrom", "_cell"])
    rows = rows.select("chrom", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(here), "_next").alias("end"), (F.col("_open") + F.sum("d").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("depth"))
    return rows.where("depth > 0")


def covered_ranges(blocks: DataFrame, species: list[str], least: int = 4, cell: int = CELL) -> DataFrame:
    """``(chrom, start, end)``: maximal ranges of the first component's bases that blocks of at least ``least`` of the named species cover: at
    each base those species count that any block over it has, each once.

    As in ``cover_depth`` a block is one more where it starts and one less where it ends, of each of its species in a column of its own, and positions are summed
    before they meet in cells. So a block is two rows, whatever its species; then only positions where enough species begin or cease to be there go on."""
    c0 = F.get("components", F.lit(0))
    names = [f"_n{i}" for i in range(len(set(species)))]
    named = F.transform("components", lambda c: W.species_of(c["src"]))
    has = [F.coalesce(F.array_contains(named, s), F.lit(False)).cast("int").alias(n) for s, n in zip(dict.fromkeys(species), names, strict=True)]
    placed = blocks.select(W.chrom_of(c0["src"]).alias("chrom"), W.forward_start(c0).alias("start"), W.forward_end(c0).alias("end"), *has)
    # an empty block has no events; as a condition that would work out anew, for each place that it reads, what blocks are made of
    both = F.when(F.col("start") < F.col("end"), F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    events = placed.select("chrom", *names, F.explode(both).alias("e")).groupBy("chrom", F.col("e.pos").alias("pos")).agg(*(F.sum(F.col(n) * F.col("e.d")).alias(n) for n in names))
    events = saved(events.where(" or ".join(f"{n} <> 0" for n in names)).withColumn("_cell", F.floor(F.col("pos") / cell)))
    order, here = Window.partitionBy("chrom").orderBy("_cell"), Window.partitionBy("chrom", "_cell").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cells = events.groupBy("chrom", "_cell").agg(*(F.sum(n).alias(n) for n in names))
    cells = cells.select("chrom", "_cell", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_open") for n in names))
    enough = lambda counts: sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0)) >= max(least, 1)
    rows = events.join(cells, ["chrom", "_cell"])
    rows = rows.select("chrom", "_cell", "pos", enough([F.col(f"{n}_open") + F.sum(n).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n in names]).alias("_on"), enough([F.col(f"{n}_open") for n in names]).alias("_open"))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_on").over(here), "_open")).where("_on <> _was")
    # where a range ends: at the next of these positions, in this cell or the next that has one
    edges = saved(rows.select("chrom", "_cell", "pos", "_on"))
    following = edges.groupBy("chrom", "_cell").agg(F.min("pos").alias("_first")).select("chrom", "_cell", F.lead("_first").over(order).alias("_next"))
    ranges = edges.join(following, ["chrom", "_cell"]).withColumn("end", F.coalesce(F.lead("pos").over(here), "_next"))
    return ranges.where("_on").select("chrom", F.col("pos").alias("start"), "end")
