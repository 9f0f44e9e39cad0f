"""Hard negatives: exact inner-product searches in R-trees packed by sort-tile-recursive."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import saved
from .embeddings import _finite, _matrix


def tile_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """The rows of ``x`` in sort-tile-recursive order: sorted by the coordinate that varies most and cut into
    slabs, each slab by the next coordinate, and so on, until a slab is a page of at most ``leaf`` rows."""
    axes = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable") if x.size else np.zeros(0, int)
    out: list[np.ndarray] = []

    def tile(part: np.ndarray, depth: int) -> None:
        pages = -(-len(part) // leaf)
        if pages <= 1 or depth == len(axes):
            out.append(part)
            return
        slabs = int(np.ceil(round(pages ** (1 / (len(axes) - depth)), 9)))
        part = part[np.argsort(x[part, axes[depth]], kind="stable")]
        step = leaf * -(-pages // slabs)
        for at in range(0, len(part), step):
            tile(part[at : at + step], depth + 1)

    tile(np.arange(len(x)), 0)
    return np.concatenate(out)


class Tree(NamedTuple):
    """A packed R-tree: rows in tile order, and on each level the corners of the boxes, leaves first."""

    ids: np.ndarray
    rows: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    leaf: int
    fan: int

    @classmethod
    def pack(cls, ids: np.ndarray, x: np.ndarray, leaf: int = 32, fan: int = 16) -> "Tree":
        order = tile_order(x, leaf)
        x = x[order]
        low, high, step, a, b = [], [], leaf, x, x
        while True:
            cuts = np.arange(0, len(a), step)
            a, b = np.minimum.reduceat(a, cuts), np.maximum.reduceat(b, cuts)
            low.append(a)
            high.append(b)
            if len(a) == 1:
                return cls(ids[order], x, low, high, leaf, fan)
            step = fan

    def widened(self, dim: int, exact: bool) -> "Tree":
        """With ``dim`` coordinates, those added being 0, and numbers of any length if doubles are not ``exact``."""

        def fit(m: np.ndarray) -> np.ndarray:
            m = np.pad(m, ((0, 0), (0, dim - m.shape[1])))
            return m if exact else whole(m)

        return Tree(self.ids, fit(self.rows), [fit(m) for m in self.low], [fit(m) for m in self.high], self.leaf, self.fan)

    def search(self, q: np.ndarray, low: list[float], high: list[int | None], k: int, own: int) -> list[list[tuple[int, int]]]:
        """For each window of scores (``high`` None: without an end) the ``k`` rows, ``own`` left out, with the highest inner products
        with ``q`` in it, ties to the smaller id, as ``(score, id)``.

        A box bounds the product coordinate by coordinate: at its upper corner where ``q`` is positive, at its lower one
        where it is negative. Boxes wait in a queue, the highest bound first; one is left alone when it lies
        outside of each window, or strictly below the ``k``-th score of each that it meets."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        best: list[list[tuple[int, int]]] = [[] for _ in low]
        least = list(low)  # what a row needs: the start of the window, later its k-th score
        queue: list[tuple] = []

        def wanted(upper: float, lower: float) -> list[int]:
            return [p for p, need in enumerate(least) if upper >= need and (high[p] is None or lower <= high[p])]

        def put(level: int, first: int, last: int) -> None:
            a, b = self.low[level][first:last], self.high[level][first:last]
            for i, (upper, lower) in enumerate(zip((b @ up + a @ down).tolist(), (a @ up + b @ down).tolist(), strict=True), first):
                if wanted(upper, lower):
                    heappush(queue, (-upper, level, i, lower))

        put(len(self.low) - 1, 0, 1)
        while queue and -queue[0][0] >= min(least, default=0):
            upper, level, i, lower = heappop(queue)
            mine = wanted(-upper, lower)
            if not mine:
                continue
            if level:
                put(level - 1, i * self.fan, min((i + 1) * self.fan, len(self.low[level - 1])))
                continue
            at = slice(i * self.leaf, (i + 1) * self.leaf)
            ids, score = self.ids[at], self.rows[at] @ q
            for p in mine:
                fits = (score >= least[p]) & (ids != own)
                if high[p] is not None:
                    fits &= score <= high[p]
                if fits.any():
                    best[p] += zip((int(s) for s in score[fits]), ids[fits].tolist(), strict=True)
                    best[p] = sorted(best[p], key=lambda r: (-r[0], r[1]))[:k]
                    if len(best[p]) == k:
                        least[p] = best[p][-1][0]
        return best


def whole(m: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as numbers of any length."""
    return np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)


def _cut(rows: DataFrame, most: int, order: list[str], fields: list[tuple[str, pa.DataType]], made: Callable[[pa.Table], dict]) -> DataFrame:
    """Stretches of at most ``most`` rows of one label, in ``order`` behind the label, each made a row (``fields``) with a number ``no``.
    Rows are dealt to ranges of the order, so a label is as many tasks' work as it has rows, and a task holds one stretch."""

    schema = pa.schema([("label", pa.string()), ("no", pa.int64()), *fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        label, n, count, base = None, 0, 0, TaskContext.get().partitionId() << 32

        def closed() -> pa.RecordBatch:
            nonlocal n, count
            row = made(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            n, count = 0, count + 1
            return pa.RecordBatch.from_pylist([{"label": label, "no": base + count - 1} | row], schema=schema)

        for part in parts:
            codes = part.column("label").to_pylist()
            ends = [k for k in range(1, len(codes)) if codes[k] != codes[k - 1]] + [len(codes)]
            start = 0
            for end in ends if codes else []:
                if n and codes[start] != label:
                    yield closed()
                label = codes[start]
                while start < end:
                    some = part.slice(start, min(end - start, most - n))
                    held.append(some)
                    n, start = n + some.num_rows, start + some.num_rows
                    if n == most:
                        yield closed()
        if n:
            yield closed()

    return rows.repartitionByRange("label", *order).sortWithinPartitions("label", *order).mapInArrow(run, from_arrow_schema(schema))


def _vectors(table: pa.Table) -> np.ndarray:
    raw = table.column("v").combine_chunks()
    return _matrix(raw if isinstance(raw, pa.Array) else pa.concat_arrays(raw.chunks))


def _best(rows: DataFrame, by: list[str], k: int, lists: int, fan_in: int = 16) -> DataFrame:
    """The ``k`` rows with the highest ``score`` (ties: the smaller ``id``) of each group, with ``rank``, from rows of ``lists``
    trees (``no``), ``fan_in`` trees' lists at a time, so that no task gets all lists of a group."""
    left = -(-lists // fan_in)
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("no"), F.lit(left)))
    while True:
        rank = F.row_number().over(Window.partitionBy(*by, "_g").orderBy(F.desc("score"), "id"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= k)
        if left <= 1:
            return rows.drop("_g", "no")
        left = -(-left // fan_in)
        rows = rows.withColumn("_g", F.pmod("_g", F.lit(left)))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    tree_rows: int = 16_384,
    query_rows: int = 512,
    leaf: int = 32,
    fan: int = 16,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each row that ``anchors`` selects, and each
    of its ``positives`` best other rows of the same label, the ``negatives`` best rows of other labels whose score is between
    the two percentages ``window`` of the positive's. A score is the inner product of components ``floor(scale * x)``; ties go to
    the smaller key; fewer where there are fewer.

    Rows are dealt to ranges of their label and of the coordinate that varies most (the first cut of sort-tile-recursive), and each stretch of
    ``tree_rows`` rows of a label becomes a packed R-tree. Blocks of ``query_rows`` anchors of a label meet the trees of that label for the positives, and
    the trees of all others for the negatives, where one search serves all windows of an anchor. Searches are exact: boxes are only
    left alone when no row in them can count; numbers are doubles while they stay exact, else integers of any length.

    Rows with a null key, label or vector, or a null or non-finite component, take no part; an empty vector scores 0
    with all, and of two lengths the shorter is filled with zeros. Rows that repeat a key count once, with the smallest vector and its label.
    A score beyond 64 bits is held at their limit in the result. An empty table gives no rows. Other columns of ``vectors`` are not read.
    """
    v = F.col(vector).cast("array<double>")
    ok = (_finite(v) | (F.size(v) == 0)) & F.col(key).isNotNull() & F.col(label).isNotNull()
    # the anchors' condition may use any column, so it is worked out first
    rows = vectors.where(ok).select(F.col(key).cast("long").alias("id"), F.struct(v.alias("v"), F.col(label).cast("string").alias("l"), F.coalesce(anchors, F.lit(False)).alias("a")).alias("r"))
    rows = rows.groupBy("id").agg(F.min("r").alias("r"))
    floors = F.transform("r.v", lambda x: _floor(x * scale))
    rows = saved(rows.select("id", F.col("r.l").alias("label"), F.col("r.a").alias("anchor"), floors.alias("v")))
    spread = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "k").first()  # a row for each coordinate
    first = F.get("v", F.lit(spread.k if spread else 0))

    def planted(table: pa.Table) -> dict:
        x = _vectors(table)
        tree = Tree.pack(table.column("id").to_numpy(), x, leaf, fan)
        boxes = b"".join(m.astype("<f8").tobytes() for pair in zip(tree.low, tree.high, strict=True) for m in pair)
        return {"n": len(x), "dim": x.shape[1], "ids": tree.ids.astype("<i8").tobytes(), "m": tree.rows.astype("<f8").tobytes(), "boxes": boxes}

    trees = saved(_cut(rows.withColumn("_x", first), tree_rows, ["_x", "id"], [("n", pa.int32()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "m", "boxes"))], planted))
    count = trees.count()
    listed = trees.select("no", "label", (F.row_number().over(Window.orderBy("no")) - 1).alias("t"))  # a short row for each tree
    if not count:
        return _renamed(rows.select("id", F.lit(0).alias("pid"), F.lit(1).alias("rank"), F.lit(0).alias("score"), F.lit(0).alias("aid"), F.lit(0).alias("ps")).where("false"))

    def grown(r: dict) -> Tree:
        n, dim, at, low, high, size = r["n"], r["dim"], 0, [], [], -(-r["n"] // leaf)
        while True:
            for corner in (low, high):
                corner.append(np.frombuffer(r["boxes"], "<f8", size * dim, at).reshape(size, dim))
                at += 8 * size * dim
            if size == 1:
                return Tree(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["m"], "<f8").reshape(n, dim), low, high, leaf, fan)
            size = -(-size // fan)

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = window
        for part in parts:
            for r in part.to_pylist():
                tree = grown(r)
                dim = max(r["dim"], r["q_dim"])
                q_ids, q = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_m"], "<f8").reshape(len(r["q_ids"]) // 8, r["q_dim"])
                q = np.pad(q, ((0, 0), (0, dim - q.shape[1])))
                exact = np.abs(q).max(initial=0) * np.abs(tree.rows).max(initial=0) * max(1, dim) < 2.0**52
                tree, q = tree.widened(dim, exact), q if exact else whole(q)
                out: dict[str, list] = {c: [] for c in ("aid", "pid", "ps", "no", "id", "score")}
                for a, own in enumerate(q_ids.tolist()):
                    pairs = r["pairs"][a] if r["pairs"] is not None else None
                    if pairs is None:
                        lists, given = tree.search(q[a], [float("-inf")], [None], positives, own), [(None, None)]
                    else:
                        given = [(p["pid"], p["ps"]) for p in pairs]
                        lists = tree.search(q[a], [-(-low * s // 100) for _, s in given], [high * s // 100 for _, s in given], negatives, own)
                    for (pid, ps), hits in zip(given, lists, strict=True):
                        for score, id_ in hits:
                            row = (own, pid, ps, r["no"], id_, max(-(1 << 63), min((1 << 63) - 1, score)))
                            for c, value in zip(out.values(), row, strict=True):
                                c.append(value)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out.values()], names=list(out))

    listed_pairs = pa.list_(pa.list_(pa.struct([("pid", pa.int64()), ("ps", pa.int64())])))

    def blocked(asked: DataFrame) -> DataFrame:
        """Blocks of anchors of one label as rows, under names of their own; with ``pairs``, if the anchors have them."""

        def made(table: pa.Table) -> dict:
            x = _vectors(table)
            pairs = table.column("pairs").to_pylist() if "pairs" in table.column_names else None
            return {"ids": table.column("id").to_numpy().astype("<i8").tobytes(), "m": x.astype("<f8").tobytes(), "dim": x.shape[1], "pairs": pairs}

        blocks = saved(_cut(asked, query_rows, ["id"], [("ids", pa.binary()), ("m", pa.binary()), ("dim", pa.int32()), ("pairs", listed_pairs)], made))
        return blocks.select(F.col("label").alias("q_label"), F.col("no").alias("q_no"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("dim").alias("q_dim"), "pairs")

    def met(blocks: DataFrame, condition: Column) -> DataFrame:
        """What the trees hold for blocks; which block meets which tree is decided by labels and numbers alone."""
        which = blocks.select("q_label", "q_no", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("t")).join(listed, "t").where(condition)
        return which.select("q_no", "no").join(blocks, "q_no").join(trees, "no").mapInArrow(found, "aid long, pid long, ps long, no long, id long, score long")

    asked = rows.where("anchor").select("id", "label", "v")
    own = _best(met(blocked(asked), F.col("q_label") == F.col("label")), ["aid"], positives, count)
    own = own.groupBy(F.col("aid").alias("id")).agg(F.collect_list(F.struct(F.col("id").alias("pid"), F.col("score").alias("ps"))).alias("pairs"))
    out = met(blocked(asked.join(own, "id")), F.col("q_label") != F.col("label"))
    return _renamed(_best(out, ["aid", "pid", "ps"], negatives, count))


def _floor(x: Column) -> Column:
    """The next lower whole number, as a double: those from 2^52 on are whole."""
    most = sys.float_info.max
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.least(F.greatest(x, F.lit(-most)), F.lit(most)))


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("aid").cast("long").alias("anchor_id"), F.col("pid").cast("long").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("ps").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"),
    )
