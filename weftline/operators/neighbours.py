"""Nearest neighbours among points ``(label, p)``, ``p`` an array of doubles."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import saved


def distance2(a: Column, b: Column) -> Column:
    """The square of the Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _rows(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Lists of ``n`` numbers as rows."""
    return pc.list_flatten(column).to_numpy().reshape(len(column), n)


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(column).to_numpy()


def _closest(xs: np.ndarray, ys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, best, d2)``: of ``xs`` the rows with a distance to any of ``ys``, for each the nearest of these (of equally near ones the smallest point, then that of
    the lowest ``rank``) and the square of its distance.

    One product of matrices gives all squares but for rounding; what it leaves within twice a bound of the rounding error of the least is worked out by
    differences. So the result is that of differences alone. Equal points are one. Rows that are not finite, or too large to be squared, are compared by differences."""
    order = np.lexsort((rank, *ys.T[::-1]))
    ys = ys[order]
    first = np.ones(len(ys), bool)
    first[1:] = (ys[1:] != ys[:-1]).any(1)
    order, ys = order[first], ys[first]
    n = ys.shape[1]
    xx, yy = (np.minimum((v**2).sum(1), np.inf) for v in (xs, ys))
    plain = bool(np.isfinite(xx).all() and np.isfinite(yy).all() and max(xx.max(initial=0), yy.max(initial=0)) < 1e290)
    room = 8 * (n + 4) * np.finfo(float).eps * (np.sqrt(xx) + np.sqrt(yy.max(initial=0))) ** 2
    to = np.concatenate([-2 * ys, yy[:, None]], axis=1).T if plain else None
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (524_288 if plain else 2_000_000 // max(1, n)) // max(1, len(ys)))
    for at in range(0, len(xs), step):
        some = xs[at : at + step]
        if plain:
            about = np.concatenate([some, np.ones((len(some), 1))], axis=1) @ to
            who, which = np.divmod(np.flatnonzero(about <= (about.min(1) + 2 * room[at : at + step])[:, None]), len(ys))
        else:
            who, which = (v.ravel() for v in np.indices((len(some), len(ys))))
        size = max(1, 2_000_000 // max(1, n))
        far = np.concatenate([((some[who[k : k + size]] - ys[which[k : k + size]]) ** 2).sum(-1) for k in range(0, len(who), size)])
        there = far == far
        who, which, far = who[there], which[there], far[there]
        if len(who):
            begin = np.flatnonzero(np.diff(who, prepend=-1))
            least = np.repeat(np.minimum.reduceat(far, begin), np.diff(begin, append=len(who)))
            who, which, far = (v[far == least] for v in (who, which, far))
            begin = np.flatnonzero(np.diff(who, prepend=-1))  # ys are in order: the first is the smallest
            out.append((who[begin] + at, order[which[begin]], far[begin]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _compared(asks: DataFrame, held: DataFrame, kinds: dict[str, str], block: int) -> DataFrame:
    """``(q, d2, p, l)``: of queries ``(q, g, p, cell)`` and points ``(l, g, p, cell)`` the best point of each query among those in its
    cell and group. A cell of many rows is cut, on both sides, to blocks of about ``block``; each pair of blocks is a tile that compares all at once."""
    number = lambda df, to: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(to))
    sides = number(asks, "na").join(number(held, "nb"), "cell")  # a row for each cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = asks.join(sides, "cell").select("q", F.lit(None).cast(kinds["l"]).alias("l"), "g", "p", "cell", F.pmod(F.xxhash64("q", "p"), F.col("na")).cast("int").alias("a"), every("nb").alias("b"), F.lit(True).alias("asks"))
    other = held.join(sides, "cell").select(F.lit(None).cast(kinds["q"]).alias("q"), "l", "g", "p", "cell", every("na").alias("a"), F.pmod(F.xxhash64("l", "p"), F.col("nb")).cast("int").alias("b"), F.lit(False).alias("asks"))

    def tile(table: pa.Table) -> pa.Table:
        known = table.column("asks").to_numpy()
        some, known = (t.sort_by("g").combine_chunks() for t in (table.filter(pa.array(known)), table.filter(pa.array(~known))))
        names, kind = ["q", "d2", "p", "l"], lambda c: table.schema.field(c).type
        found = [pa.table([pa.array([], t) for t in (kind("q"), pa.float64(), kind("p"), kind("l"))], names=names)]
        for n in sorted(set(_lengths(some.column("p")).tolist()) & set(_lengths(known.column("p")).tolist())):
            x, y = (t.filter(pa.array(_lengths(t.column("p")) == n)).combine_chunks() for t in (some, known))
            gx, gy = (t.column("g").combine_chunks().dictionary_encode() for t in (x, y))
            runs = [dict(zip(g.dictionary.to_pylist(), zip(*(np.searchsorted(g.indices.to_numpy(), np.arange(len(g.dictionary)), side) for side in ("left", "right")), strict=True), strict=True)) for g in (gx, gy)]
            for g in runs[0].keys() & runs[1].keys():
                (a, b), (c, d) = runs[0][g], runs[1][g]
                own, its = x.slice(a, b - a), y.slice(c, d - c)
                who, best, near = _closest(_rows(own.column("p"), n), _rows(its.column("p"), n), pc.rank(its.column("l").combine_chunks()).to_numpy())
                its = its.take(pa.array(best))
                found.append(pa.table([own.column("q").take(pa.array(who)), pa.array(near), its.column("p"), its.column("l")], names=names))
        return pa.concat_tables(found).combine_chunks()

    tiles = one.unionByName(other).groupBy("cell", "a", "b").applyInArrow(tile, f"q {kinds['q']}, d2 double, p array<double>, l {kinds['l']}")
    return tiles.groupBy("q").agg(F.min(F.struct("d2", "p", "l")).alias("m")).select("q", "m.d2", "m.p", "m.l")


class Cells(NamedTuple):
    """Pivots, and of the cell of each how far its nearest and farthest point lie from it; cells without points have none."""

    pivots: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each row to each pivot, as far as the shorter of the two goes."""
        n = x.shape[1]
        to = np.stack([np.pad(p[:n], (0, max(0, n - len(p)))) for p in self.pivots])
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * (x @ to.T) + (to**2).sum(1)))

    def within(self, away: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells can hold a point as near as ``bound`` (triangle inequality, with room for rounding)."""
        room = bound[:, None] + 1e-6 * (1 + away)
        return (away - self.high <= room) & (self.low - away <= room)


def _dealt(rows: DataFrame, cells: Cells, columns: list[str], kinds: str, bounds: bool = False) -> DataFrame:
    """``rows`` with the ``cell`` of the nearest pivot and the distance ``r`` to it; with ``bounds`` a row for each cell, but that (``cell``), that can hold a
    point nearer than the row's ``d2``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            table = pa.Table.from_batches([part])
            length = _lengths(table.column("p"))
            for n in sorted(set(length.tolist())):
                for at in range(0, len(table), 4_096):
                    some = table.slice(at, 4_096)
                    some = some.filter(pa.array(length[at : at + 4_096] == n))
                    if not len(some):
                        continue
                    away = cells.distances(_rows(some.column("p"), n))
                    away[:, np.isnan(cells.high)] = np.inf if not bounds else np.nan
                    if bounds:
                        d2 = some.column("d2").to_numpy()
                        own = some.column("cell").to_numpy()
                        near = cells.within(away, np.sqrt(np.where(np.isnan(d2), np.inf, d2)))
                        near[np.arange(len(own)), own] = False
                        who, cell = np.nonzero(near)
                    else:
                        who, cell = np.arange(len(some)), away.argmin(axis=1)
                    out = some.select(columns).take(pa.array(who))
                    out = out.append_column("cell", pa.array(cell.astype(np.int32))).append_column("r", pa.array(away[who, cell]))
                    yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, f"{kinds}, cell int, r double")


def nearest(queries: DataFrame, points: DataFrame, query: str = "label", by: str | None = None, cell_rows: int = 16_384, most_cells: int = 1_024, reported: bool = False) -> DataFrame:
    """Each query with ``nearest`` (the label of the closest point, of equally close ones the smallest
    point) and ``d2``; with ``by``, among the points with the same value of that column. Queries without such a point are left out.

    Points are dealt to cells around pivots (some of the points, one for ``cell_rows`` of them, at most ``most_cells``). A query first looks into the cell of its
    own nearest pivot; how near a point it finds there rules out, by the triangle inequality, cells that lie farther away or nearer
    to their pivot; it looks into the others. Cells are compared in tiles. All points are in cells, and a cell that can hold a nearer point, or
    an equally near one, is never left out. Points of a length other than the query's are not compared.
    ``reported``: ``cells``, how many cells a query looked into, and ``all_cells``, too."""
    kinds = {"q": queries.schema[query].dataType.simpleString(), "l": points.schema["label"].dataType.simpleString()}
    group = (lambda df: F.col(by).cast("string")) if by else (lambda df: F.lit(""))
    ask = queries.select(F.col(query).alias("q"), group(queries).alias("g"), F.col("p").cast("array<double>").alias("p"))
    held = points.select(F.col("label").alias("l"), group(points).alias("g"), F.col("p").cast("array<double>").alias("p"))
    count = held.count()
    k = min(most_cells, max(1, -(-count // cell_rows)))
    if k > 1:
        pivots = [np.array(r.p) for r in held.select("p").distinct().orderBy(F.xxhash64("p"), "p").limit(k).collect()]  # bounded: most_cells
        unknown = Cells(pivots, np.zeros(len(pivots)), np.zeros(len(pivots)))
        held = saved(_dealt(held, unknown, ["l", "g", "p"], f"l {kinds['l']}, g string, p array<double>"))
        told = {r.cell: r for r in held.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high")).collect()}  # a row for each cell
        ends = [np.array([getattr(told[c], e) if c in told else np.nan for c in range(len(pivots))]) for e in ("low", "high")]
        cells = Cells(pivots, *ends)
        shape = f"q {kinds['q']}, g string, p array<double>"
        ask = saved(_dealt(ask, cells, ["q", "g", "p"], shape))
        first = saved(_compared(ask, held, kinds, 2 * cell_rows))
        ask = ask.join(first.select(F.col("q").alias("_q"), "d2"), F.col("q") == F.col("_q"), "left").select("q", "g", "p", "cell", F.coalesce("d2", F.lit(float("nan"))).alias("d2"))
        more = saved(_dealt(ask, cells, ["q", "g", "p"], shape, bounds=True))
        best = first.unionByName(_compared(more, held, kinds, 2 * cell_rows)).groupBy("q").agg(F.min(F.struct("d2", "p", "l")).alias("m")).select("q", "m.d2", "m.l")
        seen = more.groupBy("q").agg((F.count(F.lit(1)) + 1).alias("cells"))
    else:
        told = {0: None}
        one = F.lit(0).alias("cell")
        best = _compared(ask.select("*", one), held.select("*", one), kinds, 2 * cell_rows)
    out = queries.join(best.select(F.col("q").alias(query), F.col("l").alias("nearest"), "d2"), query)
    if not reported:
        return out
    counts = seen.select(F.col("q").alias(query), "cells") if k > 1 else queries.select(query, F.lit(1).cast("long").alias("cells"))
    return out.join(counts, query, "left").withColumns({"cells": F.coalesce("cells", F.lit(1)), "all_cells": F.lit(len(told))})


def augment_mapping(mapping: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """``(key, symbol)``, by key, for each of the ``new`` distributions: the symbol of the nearest known one that
    is mapped. Two known ones may not be equal."""
    same = known.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"))
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("two known distributions are equal")).cast("string")).otherwise(F.col("label"))
    mapped = same.select(one.alias("label"), "p").join(mapping.select(F.col("key").alias("label"), "symbol"), "label")
    found = nearest(new, mapped.select("label", "p"))
    return found.select(F.col("label").alias("key"), "nearest").join(mapping.select(F.col("key").alias("nearest"), "symbol"), "nearest").select("key", "symbol").orderBy("key")


def wildcard_to_certain(mapping: DataFrame, distributions: DataFrame) -> DataFrame:
    """``(key, nearest, symbol)``, by key: distributions of columns with wildcards take the symbol of the nearest
    one without; the mapping itself follows with no ``nearest``."""
    wild = F.col("label").contains("*")
    last = distributions.where(~wild).groupBy("p").agg(F.max_by("label", "row_idx").alias("label"))
    found = nearest(distributions.where(wild).select("label", "p"), last)
    found = found.join(mapping.select(F.col("key").alias("nearest"), "symbol"), "nearest").select(F.col("label").alias("key"), "nearest", "symbol")
    return found.unionByName(mapping.select("key", F.lit(None).cast("string").alias("nearest"), "symbol")).orderBy("key")


def weighted_centroids(rows: DataFrame, by: str | list[str], weight: str = "w") -> DataFrame:
    """``(by, mass, p)``: the centre of mass of each group's points."""
    keys = [by] if isinstance(by, str) else by
    parts = rows.select(*keys, weight, F.posexplode("p").alias("d", "x"))
    sums = parts.groupBy(*keys, "d").agg(F.sum(F.col(weight) * F.col("x")).alias("s"), F.sum(weight).alias("mass"))
    lists = sums.groupBy(*keys).agg(F.max("mass").alias("mass"), F.sort_array(F.collect_list(F.struct("d", (F.col("s") / F.col("mass")).alias("x")))).alias("_p"))
    return lists.select(*keys, "mass", F.transform("_p", lambda v: v["x"]).alias("p"))


def absorb_infrequent(rows: DataFrame, least: int, by: str | None = None) -> DataFrame:
    """``(label, count, p)`` rows with a count below ``least`` join the nearest of the others (as they
    were at first); returns ``(label, count, p)`` of these, counts added up, points by mass. With ``by`` each
    value of that column is a problem of its own; one without any other row keeps its rows as they are."""
    keys = [by] if by else []
    often, rare = rows.where(F.col("count") >= least), rows.where(F.col("count") < least)
    if by:
        rare = rare.withColumn("_q", F.struct(by, "label"))
        seldom = nearest(rare.select("_q", by, "count", "p"), often.select(by, "label", "p"), "_q", by).select(by, F.col("nearest").alias("to"), "count", "p")
        alone = rare.join(often.select(by).distinct(), by, "left_anti").select(by, F.col("label").alias("to"), "count", "p")
        seldom = seldom.unionByName(alone)
    else:
        seldom = nearest(rare.select("label", "count", "p"), often.select("label", "p")).select(F.col("nearest").alias("to"), "count", "p")
    members = often.select(*keys, F.col("label").alias("to"), "count", "p").unionByName(seldom)
    centres = weighted_centroids(members.withColumn("w", F.col("count").cast("double")), [*keys, "to"])
    return centres.select(*keys, F.col("to").alias("label"), F.col("mass").cast("long").alias("count"), "p")
