"""Near-duplicate vectors by product quantisation, and exact search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed_row, saved, unpacked_row
from .components import connected_components


def _finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), int(lengths[0]))
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _unit(x: np.ndarray, dim: int) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest component, against overflow), ``dim`` wide."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x


def _closest(x: np.ndarray, centres: np.ndarray, rows: int = 1_024) -> np.ndarray:
    """The nearest centre of each row, some rows at a time."""
    length = (centres**2).sum(1)
    return np.concatenate([np.argmin(length - 2 * (x[at : at + rows] @ centres.T), axis=1) for at in range(0, max(1, len(x)), rows)])


def _cells(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from seeded rows."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _closest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index(NamedTuple):
    """Centres of the inverted lists and a code book for each part of the residuals."""

    dim: int
    centres: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int, codes: int, seed: int) -> "Index":
        rng = np.random.default_rng(seed)
        centres = _cells(x, lists, rng)
        rest = x - centres[_closest(x, centres)]
        return cls(x.shape[1], centres, [_cells(p, codes, rng) for p in np.array_split(rest, min(parts, x.shape[1]), axis=1)])

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and how far each lies from what its code stands for."""
        codes, off, at = [], np.zeros(len(rest)), 0
        for book in self.books:
            part = rest[:, at : at + book.shape[1]]
            at += book.shape[1]
            code = np.argmin((book**2).sum(1) - 2 * (part @ book.T), axis=1)
            off += ((part - book[code]) ** 2).sum(1)
            codes.append(code.astype(np.uint8))
        return np.stack(codes, axis=1), np.sqrt(off)

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of exact residuals to coded ones: sums of table look-ups."""
        total, at = np.zeros((len(rest), len(codes))), 0
        for k, book in enumerate(self.books):
            part = rest[:, at : at + book.shape[1]]
            at += book.shape[1]
            table = (part**2).sum(1)[:, None] - 2 * (part @ book.T) + (book**2).sum(1)
            total += table[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect what a tile's links connect: a spanning forest."""
    rows, cols = links.shape
    seen_r, seen_c, out = np.zeros(rows, bool), np.zeros(cols, bool), []
    for start in np.flatnonzero(links.any(axis=1)).tolist():
        if seen_r[start]:
            continue
        seen_r[start], front = True, [start]
        while front:
            grown = []
            for r in front:
                for c in np.flatnonzero(links[r] & ~seen_c).tolist():
                    seen_c[c] = True
                    out.append((r, c))
                    for r2 in np.flatnonzero(links[:, c] & ~seen_r).tolist():
                        seen_r[r2] = True
                        out.append((r2, c))
                        grown.append(r2)
            front = grown
    return out


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    list_rows: int = 2048,
    parts: int = 8,
    codes: int = 64,
    sample: int = 16_384,
    block: int = 1024,
    seed: int = 0,
) -> DataFrame:
    """Every row of ``vectors`` with ``_n_links`` and ``_component``.

    Two vectors link when their labels are equal and their cosine, in double precision, is at least
    ``cosine``. Equal vectors of a label are first folded into one with a weight. An index with
    coarse lists and product-quantised residuals is fitted, in one task, on at most ``sample`` folded
    vectors or eight for each list (the smallest hashes of their keys), and takes in every vector. There is a
    list for each ``list_rows`` vectors, but no more than the root of their number, so that what is sent
    to the tasks grows with that root. A vector probes each list whose cell
    comes nearer to it than half the distance that ``cosine`` allows: of two linked vectors one at least
    is as near to the plane between their lists, so each link is found, from one side or from both,
    and counted once. In a list the asymmetric distance, less the stored error of the code, rules vectors out; the rest are
    compared exactly. Lists are split into tiles of about ``block`` vectors a side, so a hot list is
    many tasks' work; a tile returns counts and a spanning forest, never all its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or key, link with nothing and are their own component. Rows with the same key, label and
    vector count as copies of each other. An empty table gives no rows. Columns of ``vectors`` stay, whatever
    their names; only one that is called as an added one is replaced by it.
    """
    v = F.col(vector).cast("array<double>")
    usable = _finite(v) & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = vectors.select(F.col(key).alias("_k"), F.col(label).cast("string").alias("_l"), v.alias("_v")).where(usable)
    folded = saved(rows.groupBy("_l", "_v").agg(F.min("_k").alias("rep"), F.count(F.lit(1)).alias("n")))
    total = folded.count()
    if total == 0:
        return unpacked_row(packed_row(vectors, key=F.col(key)), vectors, _n_links=F.lit(0).cast("long"), _component="key")
    dim, lists = folded.agg(F.max(F.size("_v"))).first()[0], max(1, min(total // list_rows, isqrt(total)))

    def fit(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([_unit(_matrix(b.column(0)), dim) for b in batches_ if b.num_rows])
        ix = Index.fit(x, lists, parts, min(codes, 256), seed)
        tables = [ix.centres, *ix.books]
        yield pa.record_batch([pa.array([t.tobytes() for t in tables], pa.binary()), pa.array([t.shape[1] for t in tables], pa.int32())], names=["cells", "wide"])

    some = folded.orderBy(F.xxhash64("rep"), "rep", "_l").limit(max(sample, 8 * lists)).select("_v")
    told = [np.frombuffer(r.cells).reshape(-1, r.wide) for r in some.repartition(1).mapInArrow(fit, "cells binary, wide int").collect()]  # bounded: lists and codes
    index = Index(dim, told[0], told[1:])
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    shipped = vectors.sparkSession.sparkContext.broadcast(index)  # bounded: lists, parts and codes
    gaps = np.sqrt(((index.centres[:, None, :] - index.centres[None, :, :]) ** 2).sum(-1)) if len(index.centres) <= 64 else None
    gaps_sent = vectors.sparkSession.sparkContext.broadcast(gaps)

    kinds = [("list", pa.int32()), ("stored", pa.bool_()), ("label", pa.string()), ("rep", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("code", pa.binary()), ("err", pa.float64()), ("own", pa.int32()), ("probes", pa.binary())]
    placed_schema = pa.schema(kinds)

    def place(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, apart = shipped.value, gaps_sent.value
        step = max(1, min(2048, 4_000_000 // lists))  # rows at a time, so that distances to all lists stay within some 32 MB
        for whole in batches_:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x = _unit(_matrix(b.column("_v")), ix.dim)
                d2 = (x**2).sum(1)[:, None] - 2 * (x @ ix.centres.T) + (ix.centres**2).sum(1)
                own = np.argmin(d2, axis=1)
                if apart is None:
                    between = np.sqrt(np.maximum(0, ((ix.centres**2).sum(1)[own])[:, None] - 2 * (ix.centres[own] @ ix.centres.T) + (ix.centres**2).sum(1)))
                else:
                    between = apart[own]
                # how far the cell of each other list is: the distance to the plane between the centres
                away = (d2 - d2[np.arange(len(x)), own][:, None]) / (2 * np.maximum(between, 1e-12))
                probes = away <= reach / 2 + 1e-7
                probes[np.arange(len(x)), own] = True
                code, err = ix.encode(x - ix.centres[own])
                who, to = np.nonzero(probes)
                take = np.concatenate([np.arange(len(x)), who])
                cols = {c: b.column(c).take(pa.array(take)) for c in ("_l", "rep", "n", "_v")}
                mine = [np.flatnonzero(p).astype("<i4").tobytes() for p in probes]
                codes_ = [c.tobytes() for c in code] + [None] * len(who)
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([own, to]).astype(np.int32)),
                        pa.array(np.arange(len(take)) < len(x)),
                        cols["_l"].cast(pa.string()),
                        cols["rep"].cast(pa.int64()),
                        cols["n"].cast(pa.int64()),
                        cols["_v"].cast(pa.list_(pa.float64())),
                        pa.array(codes_, pa.binary()),
                        pa.array([*err.tolist(), *[0.0] * len(who)]),
                        pa.array(own[take].astype(np.int32)),
                        pa.array(mine + [None] * len(who), pa.binary()),
                    ],
                    schema=placed_schema,
                )

    shape = "list int, stored boolean, label string, rep long, n long, v array<double>, code binary, err double, own int, probes binary"
    placed = saved(folded.mapInArrow(place, shape))
    sides = placed.groupBy("label", "list").agg(
        F.ceil(F.count_if("stored") / block).cast("int").alias("ns"), F.ceil(F.count_if(~F.col("stored")) / block).cast("int").alias("nq")
    )
    tiles = placed.join(sides.where("ns > 0 and nq > 0"), ["label", "list"])
    mine, other = (F.when(F.col("stored"), F.col(a)).otherwise(F.col(b)) for a, b in (("ns", "nq"), ("nq", "ns")))
    tiles = tiles.withColumn("_m", F.pmod(F.xxhash64("rep"), mine)).withColumn("_o", F.explode(F.sequence(F.lit(0), other - 1)))
    tiles = tiles.withColumns({"i": F.when(F.col("stored"), F.col("_m")).otherwise(F.col("_o")), "j": F.when(F.col("stored"), F.col("_o")).otherwise(F.col("_m"))})
    found_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def tile(table: pa.Table) -> pa.Table:
        ix = shipped.value
        table = table.combine_chunks()
        stored = table.column("stored").to_numpy()
        reps, weights = table.column("rep").to_numpy(), table.column("n").to_numpy()
        raw = table.column("v").combine_chunks()
        raw = raw if isinstance(raw, pa.Array) else pa.concat_arrays(raw.chunks)
        x = _unit(_matrix(raw), ix.dim)
        centre = ix.centres[table.column("list")[0].as_py()]
        s, q = np.flatnonzero(stored), np.flatnonzero(~stored)
        empty = found_schema.empty_table()
        if not len(s) or not len(q):
            return empty
        code = np.frombuffer(b"".join(table.column("code").take(pa.array(s)).to_pylist()), np.uint8).reshape(len(s), -1)
        err = table.column("err").to_numpy()[s]
        maybe = ix.distances(x[q] - centre, code) <= reach + err + 1e-6
        # a pair that either side finds is the business of the one with the smaller key
        own, probes = table.column("own").to_numpy(), table.column("probes").take(pa.array(s)).to_pylist()
        back = np.zeros((len(s), len(ix.centres)), bool)
        for k, p in enumerate(probes):
            back[k, np.frombuffer(p, "<i4")] = True
        maybe &= (reps[q][:, None] < reps[s][None, :]) | ~back.T[own[q]]
        a, b = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        if not len(a):
            return empty
        links = maybe[np.ix_(a, b)] & ((x[q[a]] @ x[s[b]].T) >= cosine)
        edges = _forest(links)
        ra, rb = reps[q[a]], reps[s[b]]
        who, n = np.concatenate([ra, rb]), np.concatenate([links @ weights[s[b]], links.T @ weights[q[a]]])
        has = np.flatnonzero(n)
        return pa.table(
            [
                pa.array(np.concatenate([who[has], ra[[r for r, _ in edges]]]).astype(np.int64)),
                pa.array([*[None] * len(has), *(int(rb[c]) for _, c in edges)], pa.int64()),
                pa.array(np.concatenate([n[has], np.zeros(len(edges))]).astype(np.int64)),
            ],
            schema=found_schema,
        )

    columns = ["list", "stored", "rep", "n", "v", "code", "err", "own", "probes"]
    found = saved(tiles.select("label", "i", "j", *columns).groupBy("label", "list", "i", "j").applyInArrow(tile, "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    parts_ = connected_components(found.where("b is not null"))
    told = folded.select("rep", F.col("n").alias("copies"), F.col("_l").alias("_l2"), F.col("_v").alias("_v2"), F.xxhash64("_v").alias("_h2"))
    told = told.join(links, "rep", "left").join(parts_.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("_l2", "_v2", "_h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("_n_links"), F.coalesce("component", "rep").alias("_c"))
    out = packed_row(vectors, key=F.col(key), v=F.when(usable, v), l=F.when(usable, F.col(label).cast("string"))).withColumn("h", F.xxhash64("v"))
    same = (F.col("l") == F.col("_l2")) & (F.col("h") == F.col("_h2")) & (F.col("v") == F.col("_v2"))
    return unpacked_row(out.join(told, same, "left"), vectors, _n_links=F.coalesce("_n_links", F.lit(0).cast("long")), _component=F.coalesce("_c", "key"))


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 8192,
    query_rows: int = 1024,
    fan_in: int = 16,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``queries`` selects, the ``k`` other rows
    with the highest integer inner products of components ``floor(scale * x)``; ties go to the smaller
    key. All rows, if there are fewer.

    Rows are dealt to shards and queries to blocks, each held as one matrix; every block meets every
    shard, by a product of the two tables, in a tile whose product is computed at once, a tile keeps each query's best ``k``, and the
    lists are merged ``fan_in`` at a time. Products are exact: in doubles while they stay below 2^53,
    else in Python integers (a score beyond 64 bits is held at its limit).

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null
    key; an empty vector scores 0 with all, and of two lengths the shorter is filled with zeros. Rows
    that repeat a key count once, with the smallest vector. An empty table gives no rows.
    """
    v = F.col(vector).cast("array<double>")
    ok = (_finite(v) | (F.size(v) == 0)) & F.col(key).isNotNull()
    rows = vectors.where(ok).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(v).alias("v"))
    rows = saved(rows)
    asked = rows.withColumnRenamed("id", key).where(queries).withColumnRenamed(key, "id")
    n, nq = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // query_rows))
    held = pa.schema([("no", pa.int32()), ("ids", pa.binary()), ("m", pa.binary()), ("dim", pa.int32()), ("kind", pa.string())])

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        raw = table.column("v").combine_chunks()
        raw = raw if isinstance(raw, pa.Array) else pa.concat_arrays(raw.chunks)
        m = np.floor(scale * _matrix(raw))
        ids = table.column("id").to_numpy().astype("<i8")
        # whole numbers, as short as they are
        kind = next((t for t in ("<i2", "<i4") if np.abs(m).max(initial=0) <= np.iinfo(t).max), "<f8")
        return pa.table([[table.column("no")[0].as_py()], [ids.tobytes()], [m.astype(kind).tobytes()], [m.shape[1]], [kind]], schema=held)

    def blocked(df: DataFrame, parts: int, most: int) -> DataFrame:
        out = df.withColumn("no", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("no").applyInArrow(gather, "no int, ids binary, m binary, dim int, kind string")
        return out.repartitionById(min(parts, most), F.col("no") % min(parts, most))

    each = blocked(asked, blocks, 32).select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("dim").alias("q_dim"), F.col("kind").alias("q_kind"))
    # tasks fetch the blocks and shards they compare: neither is sent to all through the driver, nor written once for each of the others
    pairs = blocked(rows, shards, 256).crossJoin(each.hint("shuffle_replicate_nl"))
    best = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dim = max(a.shape[1], b.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (a, b))
        if not a.size or not b.size:
            return np.zeros((len(a), len(b)), np.int64)
        if np.abs(a).max() * np.abs(b).max() * dim < 2.0**52:
            return (a @ b.T).astype(np.int64)
        whole = [np.array([[int(y) for y in row] for row in m], object) for m in (a, b)]
        top = 2**63 - 1
        return np.clip(whole[0] @ whole[1].T, -top, top).astype(np.int64)

    def tile(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k_ in range(len(part)):
                r = part.slice(k_, 1).to_pylist()[0]  # one pair at a time, as they are large
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                b = np.frombuffer(r["m"], r["kind"]).reshape(len(ids), r["dim"]).astype("<f8")
                a = np.frombuffer(r["q_m"], r["q_kind"]).reshape(len(q_ids), r["q_dim"]).astype("<f8")
                for at in range(0, len(a), 256):
                    mine = q_ids[at : at + 256]
                    score = product(a[at : at + 256], b)
                    own = mine[:, None] == ids[None, :]
                    take = min(len(ids), k + 1)
                    if np.abs(score).max(initial=0) < 2**62 // (len(ids) + 1):
                        order = score * len(ids) - np.arange(len(ids))  # ids ascend: ties go to the smaller
                        order[own] = np.iinfo(np.int64).min
                        top = np.argpartition(-order, take - 1, axis=1)[:, :take]
                    else:
                        top = np.argsort(np.where(own, 1, 0), axis=1, kind="stable")
                        top = np.stack([np.lexsort((ids, [-int(x) for x in row], own_))[:take] for row, own_ in zip(score, own, strict=True)])
                    who = np.repeat(np.arange(len(mine)), take)
                    col = top.ravel()
                    good = ~own[who, col]
                    who, col = who[good], col[good]
                    yield pa.record_batch([mine[who], np.full(len(who), r["no"], np.int32), ids[col], score[who, col]], schema=best)

    out = pairs.mapInArrow(tile, "query_id long, shard int, vec_id long, score long")
    left = shards
    while True:
        left = -(-left // fan_in)
        out = out.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        w = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if left <= 1:
            return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
