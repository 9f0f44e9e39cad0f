"""Scores of symbol sequences ``(seq_id, ints)``: Markov models of variable order, log odds of two of them, and
scores of windows. Negative symbols are missing; a context does not reach over one.

A context is the symbols before a place, oldest first, joined by spaces; the empty one is the root. How the models are
trained is our own definition, as only their names and parameters are given where they are called."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import STRETCH


def _fields(context: Column) -> Column:
    """The symbols of a context."""
    return F.when(context == "", F.array().cast("array<string>")).otherwise(F.split(context, " "))


def _suffixes(context: Column) -> Column:
    """The contexts that a context ends with, itself and the root included, as ``(depth, context)``."""
    f = _fields(context)
    last = lambda d: F.array_join(F.slice(f, F.size(f) - d + 1, d), " ")
    return F.transform(F.sequence(F.lit(0), F.size(f)), lambda d: F.struct(d.alias("depth"), last(d).alias("context")))


def histories(sequences: DataFrame, order: int, by: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``(by, pos, symbol, before)``: each place (from 0) with its symbol and the context of at most ``order`` symbols before it."""
    grown = lambda done, x: F.when(x < 0, F.array().cast("array<int>")).otherwise(F.concat(done, F.array(x)))
    recent = lambda i: F.slice("ints", F.greatest(i - order, F.lit(0)) + 1, F.least(i, F.lit(order)))
    before = lambda i: F.array_join(F.aggregate(recent(i), F.array().cast("array<int>"), grown), " ")
    places = F.transform("ints", lambda x, i: F.struct(i.alias("pos"), x.alias("symbol"), before(i).alias("before")))
    return sequences.select(*by, F.inline(places))


#: How many rows of a table of scores are sent to all tasks; a larger one is joined.
MOST_SENT = 500_000


def _groups(table: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """A number for each row, the same for the same values of ``by``."""
    out = np.zeros(len(table), np.int64)
    for c in by:
        code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        out = np.unique(out * (len(table) + 1) + code, return_inverse=True)[1]
    return out


def _entries(lists: pa.ChunkedArray, null: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists the row, the place and the value of each entry (``null`` for one that is null), and the lengths."""
    lists = lists.combine_chunks()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pc.list_flatten(lists), null).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), flat, n


def _kinds(ints: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place a number, the same for the same history and symbol, and how many symbols its history has."""
    code = np.where(ints < 0, 0, np.unique(ints, return_inverse=True)[1] + 1)
    kind, length, on, base = code.copy(), np.zeros(len(ints), np.int64), np.ones(len(ints), bool), int(code.max(initial=0)) + 1
    for d in range(1, min(order, len(ints)) + 1):
        before = np.concatenate([np.zeros(d, np.int64), code[:-d]])
        on = on & (place >= d) & (before > 0)
        if kind.max() > 2**62 // base:
            kind = np.unique(kind, return_inverse=True)[1]
        kind = kind * base + np.where(on, before, 0)
        length += on
    return kind, length


def context_counts(sequences: DataFrame, order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, depth, context, symbol, count)``: how often each symbol follows each context of up to ``order`` symbols. Places
    are counted by their whole context first, in the tasks that have them, so no place is shuffled, and shorter ones are sums of what was counted."""
    rows = sequences.select(*by, "ints")
    symbol = rows.schema["ints"].dataType.elementType.simpleString()
    shape = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), f"before string, symbol {symbol}, n long"])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            table = pa.Table.from_batches([part])
            row, place, ints, _ = _entries(table.column("ints"), -1)
            kind, length = _kinds(ints, place, order)
            there = np.flatnonzero(ints >= 0)
            if not len(there):
                continue
            kind = np.unique(kind[there], return_inverse=True)[1]
            _, first, n = np.unique(_groups(table, by)[row[there]] * (len(there) + 1) + kind, return_index=True, return_counts=True)
            at = there[first]
            before = [" ".join(map(str, ints[i - length[i] : i].tolist())) for i in at.tolist()]
            who = table.select(list(by)).take(pa.array(row[at]))
            out = [*who.columns, pa.array(before, pa.string()), pa.array(ints[at]), pa.array(n.astype(np.int64))]
            yield from pa.table(out, names=[*by, "before", "symbol", "n"]).combine_chunks().to_batches()

    whole = rows.mapInArrow(counted, shape).groupBy(*by, "before", "symbol").agg(F.sum("n").alias("n"))
    each = whole.select(*by, F.inline(_suffixes(F.col("before"))), "symbol", "n")
    return each.groupBy(*by, "depth", "context", "symbol").agg(F.sum("n").alias("count"))


def context_tree(counts: DataFrame, least: int = 10, divergence: float = 0.01, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, depth, context, total, kl)``: the contexts that stay of ``context_counts``.

    A context is worth keeping that was seen ``least`` times and whose next symbols are so distributed that the divergence (Kullback and
    Leibler, natural log) from those of its parent, the context without its oldest symbol, is at least ``divergence``. Pruning from the leaves takes
    away what is not worth keeping and has no child left; so what stays is each context worth keeping and all that it ends with, and the root.
    ``kl`` is null for the root."""
    keys = [*by, "depth", "context"]
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("total"))
    shares = counts.join(totals, keys).withColumn("p", F.col("count") / F.col("total"))
    above = shares.select(*by, F.col("context").alias("_up"), "symbol", F.col("p").alias("q"), (F.col("depth") + 1).alias("depth"))
    own = shares.where("depth > 0").withColumn("_up", F.regexp_replace("context", "^[^ ]+ ?", ""))
    kl = own.join(above, [*by, "depth", "_up", "symbol"]).groupBy(*keys).agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))
    rows = totals.join(kl, keys, "left")
    worth = rows.where((F.col("depth") == 0) | ((F.col("total") >= least) & (F.col("kl") >= divergence)))
    stays = worth.select(*by, F.inline(_suffixes(F.col("context")))).distinct()
    return rows.join(stays, keys, "left_semi").select(*keys, "total", "kl")


def log_odds(counts: DataFrame, tree: DataFrame, positive: Column, pseudo: float = 1.0) -> DataFrame:
    """``(depth, context, symbol, score)`` for each context of ``tree`` (those of either class) and each symbol: the log of its share after that context
    in the rows of ``context_counts`` that are ``positive`` over its share in the others, ``pseudo`` added to each count."""
    contexts = tree.select("depth", "context").distinct()
    symbols = counts.select("symbol").distinct().agg(F.sort_array(F.collect_list("symbol")).alias("_s"))  # one row: the alphabet
    every = contexts.crossJoin(F.broadcast(symbols)).select("depth", "context", F.size("_s").alias("_r"), F.explode("_s").alias("symbol"))
    sides = counts.groupBy("depth", "context", "symbol").agg(*(F.sum(F.when(w, F.col("count")).otherwise(0)).alias(n) for n, w in (("_a", positive), ("_b", ~positive))))
    sums = sides.groupBy("depth", "context").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    rows = every.join(sides, ["depth", "context", "symbol"], "left").na.fill(0, ["_a", "_b"]).join(sums, ["depth", "context"])
    share = lambda n, of: (F.col(n) + pseudo) / (F.col(of) + pseudo * F.col("_r"))
    return rows.select("depth", "context", "symbol", F.ln(share("_a", "_na") / share("_b", "_nb")).alias("score"))


def scored(sequences: DataFrame, table: DataFrame, order: int, by: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``(by, scores)``: of each sequence its places' scores by the longest context of ``table`` (``log_odds``) before them; null for a missing symbol and one
    that the table does not have. A table of up to ``MOST_SENT`` rows goes to all tasks, which look up each different history of a batch once; a larger one is
    joined with the histories, each once."""
    known = table.select("depth", "context", "symbol", "score").limit(MOST_SENT + 1).toArrow()
    if known.num_rows > MOST_SENT:
        places = histories(sequences, order, by)
        kinds = places.where("symbol >= 0").select("before", "symbol").distinct()
        found = kinds.select("before", "symbol", F.inline(_suffixes(F.col("before")))).join(table, ["depth", "context", "symbol"])
        found = found.groupBy("before", "symbol").agg(F.max_by("score", "depth").alias("score"))
        rows = places.join(found, ["before", "symbol"], "left").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "score"))).alias("_p"))
        return rows.select(*by, F.transform("_p", lambda p: p["score"]).alias("scores"))
    keys = zip(*(known.column(c).to_pylist() for c in ("context", "symbol")), strict=True)
    sent = sequences.sparkSession.sparkContext.broadcast(dict(zip(keys, known.column("score").to_pylist(), strict=True)))  # bounded: MOST_SENT
    rows = sequences.select(*by, "ints")
    shape = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "scores array<double>"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for part in parts:
            table = pa.Table.from_batches([part])
            _, place, ints, n = _entries(table.column("ints"), -1)
            kind, length = _kinds(ints, place, order)
            _, first, which = np.unique(np.where(ints < 0, -1, kind), return_index=True, return_inverse=True)
            score = np.full(len(first), np.nan)
            for k, i in enumerate(first.tolist()):
                if ints[i] >= 0:
                    before, symbol = [str(x) for x in ints[i - length[i] : i].tolist()], int(ints[i])
                    best = (of.get((" ".join(before[d:]), symbol)) for d in range(len(before) + 1))
                    score[k] = next((x for x in best if x is not None), np.nan)
            values = pa.array(score[which] if len(which) else np.zeros(0), mask=np.isnan(score[which]) if len(which) else None)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
            yield from pa.table([*table.select(list(by)).columns, lists], names=[*by, "scores"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, shape)


def position_scores(sequences: DataFrame, table: DataFrame, order: int, by: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``(by, pos, score)``: a row for each place (from 0) of ``scored``."""
    return scored(sequences, table, order, by).select(*by, F.posexplode("scores").alias("pos", "score"))


def run_scores(runs: DataFrame, by: str = "seq_id", most_missing: int | None = None) -> DataFrame:
    """``sequence_scores`` of the places of ``(by, scores)``, which are added up in their rows first; a row without places is left out."""
    rows = runs.where(F.size("scores") > 0)

    @F.arrow_udf("struct<n:bigint,some:bigint,total:double>")
    def added(lists: pa.Array) -> pa.Array:
        row, _, flat, n = _entries(pa.chunked_array([lists]), float("nan"))
        there = ~np.isnan(flat)
        some, total = (np.bincount(row, w, len(n)) for w in (there, np.where(there, flat, 0)))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(some.astype(np.int64)), pa.array(total)], names=["n", "some", "total"])

    sums = rows.select(by, added("scores").alias("_s")).groupBy(by).agg(*(F.sum(f"_s.{c}").alias(f"_{c}") for c in ("n", "some", "total")))
    mean = F.try_divide("_total", "_some")
    return sums.select(by, F.col("_some").alias("n"), (mean if most_missing is None else F.when(F.col("_n") - F.col("_some") <= most_missing, mean)).alias("score"))


def sequence_scores(positions: DataFrame, by: str = "seq_id", most_missing: int | None = None) -> DataFrame:
    """``(by, n, score)``: the mean of a sequence's scores and how many there are; null where more than ``most_missing`` places have none."""
    n, some = F.count(F.lit(1)), F.count("score")
    mean = F.avg("score") if most_missing is None else F.when(n - some <= most_missing, F.avg("score"))
    return positions.groupBy(by).agg(some.alias("n"), mean.alias("score"))


def window_scores(positions: DataFrame, width: int = 100, step: int = 1, by: tuple[str, ...] = ("chrom",), most_missing: int = 0) -> DataFrame:
    """``(by, start, n, score)``: windows of ``width`` places next to each other in ``(by, pos, score)``, one at each place that is a multiple of ``step``; the mean of
    the scores and how many there are. A window over a place that is not there is left out; one with more than ``most_missing`` null scores is null.
    Of places that repeat one counts, with the highest score."""
    return run_windows(positions.select(*by, F.col("pos").alias("at"), F.array(F.col("score").cast("double")).alias("scores")), width, step, by, most_missing)


def run_windows(runs: DataFrame, width: int = 100, step: int = 1, by: tuple[str, ...] = ("chrom",), most_missing: int = 0) -> DataFrame:
    """``window_scores`` of the places of runs ``(by, at, scores)``, each of places next to each other from ``at`` on.

    Places are dealt to stretches by their value, and the first of a stretch also to the one before (a halo of ``width - 1``), so each window
    lies in one stretch: a window is the difference of two running sums in it, and no task holds a chromosome, however long and dense. Tasks first put together
    the places that they have, batch by batch, so it is runs that are shuffled, and of places that repeat in a batch one."""
    size = max(STRETCH, 4 * width)
    rows = runs.select(*by, F.col("at").cast("long").alias("at"), F.col("scores").cast("array<double>").alias("scores"))
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            table = pa.Table.from_batches([part])
            row, place, score, _ = _entries(table.column("scores"), float("nan"))
            if not len(row):
                continue
            group, pos = _groups(table, by)[row], table.column("at").to_numpy()[row] + place
            if not ((np.diff(group) > 0) | (np.diff(group) == 0) & (np.diff(pos) > 0)).all():
                order = np.lexsort((-score, pos, group))  # the highest score first, one that is null last
                row, group, pos, score = (v[order] for v in (row, group, pos, score))
                one = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(pos) != 0)])
                row, group, pos, score = (v[one] for v in (row, group, pos, score))
            cell = pos // size
            halo = np.flatnonzero(pos - cell * size < width - 1)
            for its, at in ((np.arange(len(pos)), cell), (halo, cell[halo] - 1)):
                if not len(its):
                    continue
                g, p = group[its], pos[its]
                begin = np.flatnonzero(np.concatenate([[True], (np.diff(g) != 0) | (np.diff(p) != 1) | (np.diff(at) != 0)]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(its)).astype(np.int32)), pa.array(score[its], mask=np.isnan(score[its])))
                who = table.select(list(by)).take(pa.array(row[its][begin]))
                yield from pa.table([*who.columns, pa.array(at[begin]), pa.array(p[begin]), lists], names=[*by, "_cell", "at", "scores"]).combine_chunks().to_batches()

    def windows(table: pa.Table) -> pa.Table:
        low = table.column("_cell")[0].as_py() * size
        row, place, score, _ = _entries(table.column("scores"), float("nan"))
        at = table.column("at").to_numpy()[row] + place - low
        best, there = np.full(size + width, np.nan), np.zeros(size + width, bool)
        np.fmax.at(best, at, score)
        there[at] = True
        some = ~np.isnan(best)
        total, n, wide = (np.concatenate([[0], np.cumsum(v)]) for v in (np.where(some, best, 0.0), some, there))
        start = np.flatnonzero((wide[width : width + size] - wide[:size] == width) & ((np.arange(size) + low) % step == 0))
        n = n[start + width] - n[start]
        with np.errstate(invalid="ignore"):
            mean = (total[start + width] - total[start]) / n
        who = table.select(list(by)).take(pa.array(np.zeros(len(start), np.int64)))
        return pa.table([*who.columns, pa.array(start + low), pa.array(n.astype(np.int64)), pa.array(mean, mask=(n == 0) | (width - n > most_missing))], names=[*by, "start", "n", "score"])

    cells = rows.mapInArrow(joined, f"{keys}, _cell long, at long, scores array<double>")
    return cells.groupBy(*by, "_cell").applyInArrow(windows, f"{keys}, start long, n long, score double")
