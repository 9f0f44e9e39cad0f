"""Operators on alignment blocks, held one to a row with an array of components:
``(block_id, components)``, a component being ``(src, start, size, strand, src_size, text)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as W
from ..sources import numbered_rows, saved
from .columns import distinct_columns

#: How many places in an order are one task's work.
STRETCH = 65_536


def translate_chars(blocks: DataFrame, raw: str = W.RAW_CHARACTERS, plain: str = W.PLAIN_CHARACTERS) -> DataFrame:
    """Other gap characters of raw alignments become the gap or the wildcard; case counts."""
    return blocks.withColumn("components", F.transform("components", lambda c: c.withField("text", F.translate(c["text"], raw, plain))))


def block_intervals(blocks: DataFrame) -> DataFrame:
    """``(block_id, chrom, start, end)`` of the first component on the forward strand."""
    c = F.get("components", F.lit(0))
    return blocks.select("block_id", W.chrom_of(c["src"]).alias("chrom"), W.forward_start(c).alias("start"), W.forward_end(c).alias("end"))


def limit_to_species(blocks: DataFrame, species: list[str]) -> DataFrame:
    """Components of the named species only; blocks with more than one of them stay."""
    kept = blocks.withColumn("components", F.filter("components", lambda c: W.species_of(c["src"]).isin(species)))
    return kept.where(F.size("components") > 1)


def filter_max_wildcards(blocks: DataFrame, min_good: int, max_wildcards: int) -> DataFrame:
    """Blocks with at least ``min_good`` columns of at most ``max_wildcards`` wildcards."""
    good = F.filter(W.text_columns(F.col("components")), lambda c: W.count_of(c, W.WILDCARD) <= max_wildcards)
    return blocks.where(F.size(good) >= min_good)


def filter_missing_data(blocks: DataFrame, groups: list[list[str]], min_length: int = 100, min_real: float = 0.5, per_group: int = 1) -> DataFrame:
    """Blocks at least ``min_length`` columns long in which each group of species has at least
    ``per_group`` components with a share of real bases of ``min_real``; an empty text has none."""
    keep = F.length(F.get("components", F.lit(0))["text"]) >= min_length
    for group in groups:
        real = [F.coalesce(W.real_share(W.component(F.col("components"), s)["text"]) >= min_real, F.lit(False)).cast("int") for s in group]
        keep = keep & (sum(real[1:], real[0]) >= per_group)
    return blocks.where(keep)


def by_class(rows: DataFrame, classes: DataFrame, wanted: str, key: str = "row_idx") -> DataFrame:
    """Rows whose class, at the same place, is ``wanted``; the shorter of the two ends it."""
    of = classes.where(F.trim("label") == wanted).select(key)
    return rows.join(of, key, "left_semi")


def _fake(species: str, n: Column) -> Column:
    """A component of wildcards for a species that a block lacks."""
    return F.struct(
        F.lit(f"{species}.fake").alias("src"), F.lit(0).cast("long").alias("start"), n.cast("long").alias("size"), F.lit("?").alias("strand"), n.cast("long").alias("src_size"), F.repeat(F.lit("*"), n.cast("int")).alias("text")
    )


def drop_gap_columns(blocks: DataFrame) -> DataFrame:
    """Blocks without the columns in which no component has more than a gap or wildcard."""
    gaps = "".join(W.GAP_LIKE)
    plain = lambda c: W.chars(F.translate(c["text"], gaps, "-" * len(gaps)))
    over = lambda done, t: F.zip_with(done, t, lambda a, ch: a | F.coalesce(ch != "-", F.lit(False)))
    lay = lambda done, c: F.when(done.isNull(), F.transform(plain(c), lambda ch: ch != "-")).otherwise(F.slice(over(done, plain(c)), F.lit(1), F.size(done)))
    keep = F.aggregate("components", F.lit(None).cast("array<boolean>"), lay)
    # the flags stand beside each component, as an argument is worked out once and a lambda's body is not
    beside = F.arrays_zip(F.col("components").alias("c"), F.array_repeat(keep, F.size("components")).alias("k"))
    cut = lambda c, k: c.withField("text", F.array_join(F.zip_with(W.chars(c["text"]), k, lambda ch, x: F.when(x, ch)), ""))
    return blocks.withColumn("components", F.transform(beside, lambda z: cut(z["c"], z["k"])))


def require_species(blocks: DataFrame, species: list[str]) -> DataFrame:
    """Blocks that have all the species, in the order given; a species with a star after its name may
    be missing and is then made of wildcards. The first may not. Columns of gaps go."""
    if species[0].endswith("*"):
        raise ValueError("the first species has to be there")
    n = F.length(F.get("components", F.lit(0))["text"])
    parts, keep = [], F.lit(True)
    for s in species:
        found = W.component(F.col("components"), s.rstrip("*"))
        if s.endswith("*"):
            parts.append(F.coalesce(found, _fake(s.rstrip("*"), n)))
        else:
            keep = keep & found.isNotNull()
            parts.append(found)
    return drop_gap_columns(blocks.where(keep).withColumn("components", F.array(*parts)))


def fuse_adjacent(blocks: DataFrame, order: str = "block_id", exempt_fakes: bool = True) -> DataFrame:
    """Neighbours in ``order`` become one block where each component goes on where the one before
    ends, on one source and strand (components of wildcards always do). Texts and sizes add up, all
    else is the first block's.

    Neighbours are rows next to each other among all rows given. Each stretch of ``STRETCH`` places is
    looked at in a task of its own, with the last row of the stretch before it; a run that begins in an
    earlier stretch gets its start from the starts of all stretches, of which there is one each. So
    neither a source nor the whole table is a task's work; a run that is fused is one row.
    """
    heads = F.transform("components", lambda c: F.struct(c["src"].alias("src"), c["strand"].alias("strand"), c["start"].alias("start"), (c["start"] + c["size"]).alias("end")))
    # written once; what is put in order are heads with their rows' places in the files, by which texts are joined again
    blocks = saved(blocks.select(F.col(order).alias("_order"), "components"))
    spot = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    placed = numbered_rows(blocks.select(F.col("_metadata.file_name").alias("_at0"), F.col("_metadata.row_index").alias("_at1"), "_order", heads.alias("_h")), ["_order", "_at0", "_at1"])

    def goes_on(a: Column, b: Column) -> Column:
        touch = (a["strand"] == b["strand"]) & (a["end"] == b["start"])
        if exempt_fakes:
            touch = touch | (F.endswith(a["src"], F.lit(".fake")) & F.endswith(b["src"], F.lit(".fake")))
        return (a["src"] == b["src"]) & touch

    def started(rows: DataFrame) -> DataFrame:
        """Rows with the start of their run, where it lies in their stretch."""
        here, next_ = F.floor(F.col("_place") / STRETCH), F.floor(F.col("_place") / STRETCH) + 1
        # the last row of a stretch is looked at in the next one too, to be gone on from
        at = F.explode(F.when(F.col("_place") % STRETCH == STRETCH - 1, F.array(here, next_)).otherwise(F.array(here)))
        order_ = Window.partitionBy("_s").orderBy("_place")
        rows = rows.withColumn("_s", at).withColumn("_before", F.lag("_h").over(order_)).where(here == F.col("_s"))
        joins = (F.size("_before") == F.size("_h")) & F.forall(F.zip_with("_before", "_h", goes_on), lambda x: F.coalesce(x, F.lit(False)))
        rows = rows.withColumn("_start", F.when(~F.coalesce(joins, F.lit(False)), F.col("_place"))).drop("_before", "_h")
        return rows.withColumn("_run", F.max("_start").over(order_))

    last = started(placed.select("_place", "_h")).groupBy("_s").agg(F.max("_start").alias("_last"))
    earlier = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("_s", F.max("_last").over(earlier).alias("_open"))  # a row for each stretch
    rows = started(placed).join(last, "_s").select(F.col("_at0").alias("_file"), F.col("_at1").alias("_row"), "_place", F.coalesce("_run", "_open").alias("_run"))
    rows = blocks.select(*spot, "_order", "components").join(rows, ["_file", "_row"])
    runs = rows.groupBy("_run").agg(F.sort_array(F.collect_list(F.struct("_place", "_order", "components"))).alias("_b"))
    first = F.get("_b", F.lit(0))
    text = lambda of, i: F.array_join(F.transform(of, lambda b: F.get(b["components"], i)["text"]), "")
    size = lambda of, i: F.aggregate(of, F.lit(0).cast("long"), lambda x, b: x + F.get(b["components"], i)["size"])
    whole = F.transform(first["components"], lambda c, i: c.withField("text", text(F.col("_b"), i)).withField("size", size(F.col("_b"), i)))
    return runs.select(first["_order"].alias(order), F.size("_b").alias("n_blocks"), whole.alias("components"))


def dense_order(rows: DataFrame, order: str, place: str = "_place") -> DataFrame:
    """``rows`` with their places, from 1 on, in ``order``."""
    return numbered_rows(rows, [order], place)


def block_cpg_density(blocks: DataFrame) -> DataFrame:
    """``(block_id, density)``: CG in the gapped text of the first component over its size; null for
    an empty text."""
    c = F.get("components", F.lit(0))
    hits = F.regexp_count(F.upper(c["text"]), F.lit("CG")).cast("double")
    return blocks.select("block_id", F.when(F.length(c["text"]) > 0, F.try_divide(hits, c["size"])).alias("density"))


def to_symbols(blocks: DataFrame, mapping: DataFrame, missing: str = "-1", sent_keys: int = 500_000) -> DataFrame:
    """``(block_id, symbols)``: each column's symbol by ``mapping`` (``key``, ``symbol``), joined by
    spaces; columns are upper-cased, those without a symbol (null or empty, too) get ``missing``; blocks without columns
    are left out. Of the symbols of a key that repeats the greatest counts (``read_mapping`` has one for each key, that of its last line).

    A mapping of up to ``sent_keys`` keys (all columns of seven species are fewer) goes to every task and
    blocks are coded where they are; a larger one is joined column by column."""
    mapping = mapping.where("key is not null and symbol <> ''").groupBy("key").agg(F.max(F.col("symbol").cast("string")).alias("symbol"))
    known = mapping.limit(sent_keys + 1).toArrow()
    if known.num_rows <= sent_keys:
        sent = blocks.sparkSession.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in known.columns), strict=True)))  # bounded: sent_keys

        @F.arrow_udf("string")
        def coded(texts: pa.Array) -> pa.Array:
            keys, which, n = distinct_columns(texts, shortest=True)
            symbols = pa.array([sent.value.get(k, missing) for k in keys], pa.string()).take(pa.array(which))
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), symbols), " ")

        some = blocks.where(F.array_min(F.transform("components", lambda c: F.length(c["text"]))) > 0)
        return some.select("block_id", coded(F.transform("components", lambda c: c["text"])).alias("symbols"))
    columns = blocks.select("block_id", F.posexplode(W.text_columns(F.col("components"))).alias("pos", "key")).withColumn("key", F.upper("key"))
    coded = columns.join(mapping, "key", "left").withColumn("symbol", F.coalesce("symbol", F.lit(missing)))
    lists = coded.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("_s"))
    return lists.select("block_id", F.array_join(F.transform("_s", lambda s: s["symbol"]), " ").alias("symbols"))


def sequence_symbols(sequences: DataFrame, text: str = "seq", codes: str = "ACGT-*") -> DataFrame:
    """``sequences`` with ``symbols``: for each character its place in ``codes`` (from 0), else -1."""
    table = F.create_map(*(x for k, c in enumerate(codes) for x in (F.lit(c), F.lit(k))))
    return sequences.withColumn("symbols", F.transform(W.chars(F.upper(text)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(-1))))


def mask_blocks(blocks: DataFrame, mask: DataFrame, char: str = "X", literal: bool = False, bin_size: int = 4096) -> DataFrame:
    """Columns of masked bases overwritten with ``char`` in all components.

    ``mask`` is ``(chrom, start, end)``. A column is masked when its base of the first component (on
    the forward strand) lies in the mask; a run of gaps inside when the base after it is; one at the
    end when the base before it is (``literal``: when there is a base before it and the mask has the
    chromosome at all). Blocks without a masked column pass as they are. The mask meets blocks by bins
    of positions; a cut then is a stretch of bases, and so of columns, and each text is put together
    from its stretches.
    """
    from .intervals import merge_overlaps

    c0 = F.get("components", F.lit(0))
    rows = blocks.withColumns({"_chrom": W.chrom_of(c0["src"]), "_fs": W.forward_start(c0), "_fe": W.forward_end(c0)})
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor((F.greatest(a + 1, b) - 1) / bin_size)))
    cuts = merge_overlaps(mask).select(F.col("chrom").alias("_chrom"), F.col("start").alias("_ms"), F.col("end").alias("_me"))
    binned = cuts.withColumn("_bin", bins(F.col("_ms"), F.col("_me")))
    hits = rows.select("block_id", "_chrom", "_fs", "_fe").withColumn("_bin", bins(F.col("_fs"), F.col("_fe"))).join(binned, ["_chrom", "_bin"])
    hits = hits.where("_ms < _fe and _fs < _me").groupBy("block_id").agg(F.collect_set(F.struct("_ms", "_me")).alias("_cuts"))
    rows = rows.join(hits, "block_id", "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<struct<_ms:bigint,_me:bigint>>")))
    if literal:
        rows = rows.join(cuts.select("_chrom").distinct().withColumn("_any", F.lit(True)), "_chrom", "left")
    text = c0["text"]
    # the columns of the first component's bases
    at = F.filter(F.transform(W.chars(text), lambda ch, i: F.when(ch != "-", i)), lambda i: i.isNotNull())
    rows = rows.withColumns({"_at": at if literal else F.when(F.size("_cuts") > 0, at), "_width": F.length(text)})
    n = F.size("_at")

    def stretch(m: Column) -> Column:
        """The columns of a cut: its bases from the first on and the gaps before each."""
        low = F.when(c0["strand"] == "-", c0["src_size"] - c0["start"] - m["_me"]).otherwise(m["_ms"] - c0["start"]).cast("int")
        high = F.when(c0["strand"] == "-", c0["src_size"] - c0["start"] - m["_ms"]).otherwise(m["_me"] - c0["start"]).cast("int")
        start = F.when(low <= 0, 0).otherwise(F.try_element_at("_at", low) + 1)
        end = F.when(high >= n, F.try_element_at("_at", n) + 1 if literal else F.col("_width")).otherwise(F.try_element_at("_at", high) + 1)
        return F.when((n > 0) & (low < n) & (high > 0), F.struct(start.cast("int").alias("s"), end.cast("int").alias("e")))

    spans = F.sort_array(F.filter(F.transform("_cuts", stretch), lambda x: x.isNotNull()))
    if literal:
        last = F.try_element_at("_at", n) + 1
        spans = F.when(F.col("_any") & (n > 0) & (last < F.col("_width")), F.concat(spans, F.array(F.struct(last.cast("int").alias("s"), F.col("_width").cast("int").alias("e"))))).otherwise(spans)
    rows = rows.withColumn("_spans", spans)

    def covered(text: Column, spans: Column) -> Column:
        """A text with its stretches overwritten."""
        step = lambda x, m: F.struct(F.concat(x["t"], F.substring(text, x["at"] + 1, m["s"] - x["at"]), F.repeat(F.lit(char), m["e"] - m["s"])).alias("t"), m["e"].alias("at"))
        return F.aggregate(spans, F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), step, lambda x: F.concat(x["t"], F.substring(text, x["at"] + 1, F.length(text))))

    beside = F.arrays_zip(F.col("components").alias("c"), F.array_repeat("_spans", F.size("components")).alias("m"))
    new = F.transform(beside, lambda z: z["c"].withField("text", covered(z["c"]["text"], z["m"])))
    return rows.withColumn("components", F.when(F.size("_spans") > 0, new).otherwise(F.col("components"))).select(*blocks.columns)
