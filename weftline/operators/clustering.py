"""Clusterings, each of many independent problems at once.

Average linkage is a plan of joins: all pairs of clusters that are each other's nearest merge in one
round, which gives the tree that merging one pair at a time does. Agglomeration by entropy compares all
clusters at each step, so it is sequential by nature: each problem is a group (``applyInPandas``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import numbered_rows, saved, shared_folder
from .similarity import MOST_SENT, shortest, sparse_dot


def _plogp(x: float | np.ndarray) -> float | np.ndarray:
    safe = np.where(np.asarray(x) > 0, x, 1.0)
    return np.asarray(x) * np.log(safe)


def _nearest(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest other point of each of ``rows`` (of equally near ones the first) and its distance."""
    best, off = np.empty(len(rows), np.int64), np.empty(len(rows))
    size = max(1, 4_000_000 // max(1, points.size))
    for at in range(0, len(rows), size):
        some = rows[at : at + size]
        far = np.sqrt(((points[some][:, None] - points[None]) ** 2).sum(-1))
        far[np.arange(len(some)), some] = np.inf
        best[at : at + size] = far.argmin(axis=1)
        off[at : at + size] = far[np.arange(len(some)), best[at : at + size]]
    return best, off


def _agglomerate(mass: np.ndarray, points: np.ndarray, stop: int, report: int) -> list[tuple[int, float, list[int]]]:
    """Merge, time and again, the pair (a row and its nearest, the row first) after which entropy is
    highest; list the clusterings of fewer than ``report`` clusters. Only each row's nearest is held, no
    matrix; rows whose nearest changes look again."""
    mass, points = mass / mass.sum(), points.astype(float).copy()
    assign = np.arange(len(mass))
    nearest, off = _nearest(points, np.arange(len(mass)))
    entropy = float(-_plogp(mass).sum())
    out = []
    while len(mass) > stop:
        rows = np.flatnonzero(np.arange(len(mass)) < nearest)
        both = mass[rows] + mass[nearest[rows]]
        after = entropy + _plogp(mass[rows]) + _plogp(mass[nearest[rows]]) - _plogp(both)
        i = int(rows[after.argmax()])
        j, last = int(nearest[i]), len(mass) - 1
        entropy = float(after.max())
        total = mass[i] + mass[j]
        points[i] = (points[i] * mass[i] + points[j] * mass[j]) / total if total else points[i]
        mass[i] = total
        assign[assign == j] = i
        assign[assign == last] = j
        stale = (nearest == i) | (nearest == j) | (nearest == last)
        for x in (mass, points, nearest, off, stale):
            x[j] = x[last]
        mass, points, nearest, off, stale = mass[:-1], points[:-1], nearest[:-1], off[:-1], stale[:-1]
        for k in {i, j} - {last}:  # the joint one, and the one that has moved
            stale[k] = True
            d = np.sqrt(((points - points[k]) ** 2).sum(-1))
            d[k] = np.inf
            closer = (d < off) | ((d == off) & (k < nearest))
            nearest[closer], off[closer] = k, d[closer]
        again = np.flatnonzero(stale)
        if len(mass) > 1:
            nearest[again], off[again] = _nearest(points, again)
        if len(mass) < report:
            out.append((len(mass), entropy / np.log(len(mass)), assign.tolist()))
    return out


def entropy_agglomeration(rows: DataFrame, stop: int = 5, report: int = 100, by: str = "problem") -> DataFrame:
    """``(problem, n_clusters, h_norm, assign)`` for ``(problem, row_idx, count, p)``: clusterings of each
    problem's rows down to ``stop``; ``assign`` gives each row's cluster in order of ``row_idx``. A problem's
    rows are one task's work (their number, not its square, is held), different problems are different tasks'."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        trace = _agglomerate(pdf["count"].to_numpy(float), np.stack(pdf["p"].to_numpy()), stop, report)
        return pd.DataFrame([(pdf[by].iloc[0], *t) for t in trace], columns=[by, "n_clusters", "h_norm", "assign"])

    return rows.select(by, "row_idx", "count", "p").groupBy(by).applyInPandas(run, f"{by} string, n_clusters int, h_norm double, assign array<int>")


def hierarchical(matrix: DataFrame, by: str = "problem", held: int = 2_048) -> DataFrame:
    """``(problem, stage, n_clusters, left, right, sim)``: average linkage on similarities ``(problem, i, j, w)``
    in long form, items counted from 0, each pair in either order or both; pairs that are not given are not
    joined before all given ones (``complete`` gives zeros). Leaves are -1, -2 and so on, clusters the
    stages that make them; the left one has the smaller item.

    In a round each cluster picks the most similar other one (of equal ones by a hash of the pair), and
    pairs that pick each other merge; similarities to a merged one are means by the numbers of items. No
    similarity to a merged cluster exceeds those to both parts, so merges by decreasing similarity are
    the stages. A round leaves a fraction of the clusters, so rounds grow with the log of their number (where a few are the most
    similar ones of all others, only some pairs merge in a round). When no problem has more than ``held`` clusters left, a task for each goes on with the same rounds
    on a matrix of that size at most.
    """
    pair = matrix.where("i <> j").select(by, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("w").cast("double").alias("w"))
    pair = pair.withColumn("w", F.when(F.col("w") < 0, F.raise_error(F.lit("similarities are not negative")).cast("double")).otherwise(F.col("w")))
    pair = saved(pair.groupBy(by, "a", "b").agg(F.max("w").alias("w")))
    items = pair.select(by, F.col("a").alias("c")).union(pair.select(by, "b")).distinct()
    whole = saved(items.select(by, "c", F.lit(1).alias("n"), F.lit(0).alias("born"), F.lit(float("inf")).alias("h")))
    merges, round_, folder = [], 0, shared_folder(matrix.sparkSession)
    while not pair.isEmpty():
        left = whole.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("every")).first()
        if left.most <= held:
            break
        # a row for each cluster is sent to all tasks, as pairs are many more however small the planner takes them to be
        sent = "broadcast" if left.every <= MOST_SENT else "merge"
        round_ += 1
        near = F.struct("w", F.xxhash64("a", "b").alias("tie"), F.col("a").alias("x"), F.col("b").alias("y"))
        ends = pair.select(by, F.col("a").alias("c"), near.alias("p")).union(pair.select(by, F.col("b").alias("c"), near.alias("p")))
        best = ends.groupBy(by, "c").agg(F.max("p").alias("p")).select(by, "c", F.col("p.x").alias("a"), F.col("p.y").alias("b"), F.col("p.w").alias("sim"))
        both = best.groupBy(by, "a", "b").agg(F.count(F.lit(1)).alias("_n"), F.max("sim").alias("sim")).where("_n = 2").drop("_n")
        side = lambda x: whole.select(by, F.col("c").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in ("n", "born", "h")))  # noqa: B023, E731
        done = both.join(side("a"), [by, "a"]).join(side("b"), [by, "b"])
        done = done.select(by, F.lit(round_).alias("round"), "a", "b", "born_a", "born_b", "n_a", "n_b", "sim", F.least("sim", "h_a", "h_b").alias("h"))
        merges.append(f"{folder}/{round_}")
        done.coalesce(1 if left.every <= MOST_SENT else 1_024).write.parquet(merges[-1])
        done = matrix.sparkSession.read.schema(done.schema).parquet(merges[-1])
        # each cluster's new name, number of items and share in it
        joint = done.select(by, "a", (F.col("n_a") + F.col("n_b")).alias("n"), "round", "h")
        to = done.select(by, F.col("b").alias("c"), F.col("a").alias("to"))
        kept = whole.join(done.select(by, F.col("a").alias("c")).union(done.select(by, "b")), [by, "c"], "left_anti")
        named = whole.select(by, "c", "n").join(to, [by, "c"], "left").select(by, "c", "n", F.coalesce("to", "c").alias("to"))
        named = saved(named)
        whole = saved(kept.union(joint.select(by, "a", F.col("n").cast("int"), "round", "h")))
        move = lambda x: named.select(by, F.col("c").alias(x), F.col("to").alias(f"to_{x}"), F.col("n").alias(f"n_{x}"))  # noqa: B023, E731
        moved = pair.join(move("a").hint(sent), [by, "a"]).join(move("b").hint(sent), [by, "b"]).where("to_a <> to_b")
        moved = moved.select(by, F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"), (F.col("n_a") * F.col("n_b")).alias("m"), "w")
        pair = saved(moved.groupBy(by, "a", "b").agg((F.sum(F.col("m") * F.col("w")) / F.sum("m")).alias("w")))
    rest = _finished(pair, whole, by, round_)
    merges.append(f"{folder}/rest")
    rest.write.parquet(merges[-1])
    merges = matrix.sparkSession.read.schema(rest.schema).parquet(*merges)
    return _staged(merges, by)


def _staged(merges: DataFrame, by: str) -> DataFrame:
    """Merges ``(by, round, a, b, born_a, born_b, n_a, n_b, sim, h)`` as stages in order of ``h``."""
    placed = numbered_rows(merges.withColumn("_low", -F.col("h")), [by, "_low", "round", "a"])
    first = placed.groupBy(by).agg((F.min("_place") - 1).alias("_first"), F.count(F.lit(1)).alias("_merges"))
    placed = saved(placed.join(first, by).withColumn("stage", (F.col("_place") - F.col("_first")).cast("int")))
    made = lambda x: placed.select(by, F.col("a").alias(x), F.col("round").alias(f"born_{x}"), F.col("stage").alias(f"at_{x}"))
    out = placed.join(made("a"), [by, "a", "born_a"], "left").join(made("b"), [by, "b", "born_b"], "left")
    name = lambda x: F.coalesce(F.col(f"at_{x}"), -F.col(x) - 1).cast("int")
    return out.select(by, "stage", (F.col("_merges") + 1 - F.col("stage")).cast("int").alias("n_clusters"), name("a").alias("left"), name("b").alias("right"), "sim")


def _finished(pair: DataFrame, whole: DataFrame, by: str, round_: int) -> DataFrame:
    """The merges of what is left of ``hierarchical``, in rounds after ``round_``: each problem's clusters, of which few are left, are a task's work."""
    x, y = whole.select(by, F.col("c").alias("a"), "n", "born", "h"), whole.select(by, F.col("c").alias("b"))
    # a row for each pair, given or not (as pairs of merged clusters may be), with its hash, and for each cluster itself
    rows = x.join(y.hint("merge"), by).where("a <= b").join(pair.hint("merge"), [by, "a", "b"], "left").withColumn("tie", F.xxhash64("a", "b"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        a, b, w, tie = (table.column(c).to_numpy() for c in ("a", "b", "w", "tie"))
        own = np.flatnonzero(a == b)
        own = own[np.argsort(a[own])]
        c, n, born, high = (table.column(k).to_numpy()[own] for k in ("a", "n", "born", "h"))
        p, q, n, last, out = np.searchsorted(c, a), np.searchsorted(c, b), n.astype(float), np.iinfo(np.int64).min, []
        sim, ties = np.full((len(c), len(c)), -np.inf), np.zeros((len(c), len(c)), np.int64)
        sim[p, q] = sim[q, p] = np.where(np.isnan(w), -np.inf, w)
        ties[p, q] = ties[q, p] = tie
        np.fill_diagonal(sim, -np.inf)
        no = round_
        while (there := sim > -np.inf).any():
            no += 1
            top = sim.max(axis=1)
            tied = np.where(there & (sim == top[:, None]), ties, last)
            best = len(c) - 1 - (tied == tied.max(axis=1)[:, None])[:, ::-1].argmax(axis=1)
            i = np.flatnonzero((top > -np.inf) & (np.arange(len(c)) < best) & (best[best] == np.arange(len(c))))
            j = best[i]
            h = np.minimum(top[i], np.minimum(high[i], high[j]))
            out.append((np.full(len(i), no), c[i], c[j], born[i], born[j], n[i], n[j], top[i], h))
            mass = np.where(there, n[:, None] * n, 0)
            sums = np.where(there, sim, 0) * mass
            kept = np.ones(len(c), bool)
            kept[j] = False
            for m in (mass, sums):
                m[i] += m[j]
                m[:, i] += m[:, j]
            n[i] += n[j]
            born[i], high[i] = no, h
            mass, sums, ties = (m[np.ix_(kept, kept)] for m in (mass, sums, ties))
            np.fill_diagonal(mass, 0)
            sim = np.divide(sums, mass, out=np.full(mass.shape, -np.inf), where=mass > 0)
            c, n, born, high = (v[kept] for v in (c, n, born, high))
        names = ["round", "a", "b", "born_a", "born_b", "n_a", "n_b", "sim", "h"]
        columns = [np.concatenate(v) for v in zip(*out, strict=True)] or [np.zeros(0)] * len(names)
        kind = [table.schema.field(k).type for k in ("born", "a", "b", "born", "born", "n", "n", "w", "h")]
        made = pa.table([pa.array(v).cast(k) for v, k in zip(columns, kind, strict=True)], names=names)
        return made.add_column(0, by, table.column(by).combine_chunks().take(pa.array(np.zeros(len(made), np.int64))))

    shape = f"{by} {kinds[by]}, round int, a {kinds['a']}, b {kinds['b']}, born_a int, born_b int, n_a int, n_b int, sim double, h double"
    return rows.groupBy(by).applyInArrow(run, shape)


#: Whole numbers with products of sums up to this are exact in doubles.
_EXACT = 2**53


def hierarchical_of(rows: DataFrame, items: DataFrame, item: str = "seq_id", key: str = "kmer", weight: str = "w", held: int = 16_384, keys: int = 4_096) -> DataFrame:
    """``hierarchical`` of the products ``sparse_dot`` of all pairs of ``items`` (counted from 0), one problem, ``all``, without the pairs: the mean similarity of two clusters
    is the product of their means. Weights are counts, so products of sums are exact, and equal similarities are equal.

    In a round blocks of clusters are laid against each other, each cluster keeps its most similar one, and pairs that pick each other merge; when ``held`` clusters
    are left a task goes on, in which only clusters whose nearest has merged look again. Of more than ``keys`` keys, of weights that are not whole, and of sums too large
    to be exact, the pairs are made."""
    entries = rows.groupBy(F.col(item).cast("int").alias("i"), F.col(key).alias("k")).agg(F.sum(F.col(weight).cast("double")).alias("w")).where("i is not null and k is not null and w is not null")
    entries = saved(entries)
    ids = saved(items.select(F.col(item).cast("int").alias("i")).where("i is not null").distinct())
    told = entries.agg(F.coalesce(F.bool_and(F.expr("w = floor(w) and w >= 0")), F.lit(True)).alias("whole"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("sum")).first()
    names = [r.k for r in entries.select("k").distinct().limit(keys + 1).collect()]  # bounded: keys
    if len(names) > keys or not told.whole or told.sum**2 / 4 >= _EXACT:
        return hierarchical(sparse_dot(entries, "i", "k", "w", items=ids).select(F.lit("all").alias("problem"), "i", "j", "w"))
    width, known = max(1, len(names)), pa.array(sorted(names), entries.select("k").limit(0).toArrow().schema.field("k").type)

    def dense(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sums, lists = np.zeros((len(part), width)), part.column("e")
            who = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            cells = pc.list_flatten(lists)
            sums[who, pc.index_in(cells.field("k"), known).to_numpy()] = cells.field("w").to_numpy()
            yield pa.record_batch([part.column("c"), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64()))], names=["c", "s"])

    lists = ids.select(F.col("i").alias("c")).join(entries.groupBy(F.col("i").alias("c")).agg(F.collect_list(F.struct("k", "w")).alias("e")).hint("merge"), "c", "left")
    whole = saved(lists.mapInArrow(dense, "c int, s array<double>").select("c", F.lit(1).alias("n"), F.lit(0).alias("born"), F.lit(float("inf")).alias("h"), "s"))
    spark, folder, merges, round_, left = rows.sparkSession, shared_folder(rows.sparkSession), [], 0, whole.count()
    shape = "problem string, round int, a int, b int, born_a int, born_b int, n_a int, n_b int, sim double, h double"
    while left > held and left > 1:
        round_ += 1
        best = _most_similar(whole, left)
        both = best.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.max("sim").alias("sim")).where("_n = 2").drop("_n")
        # clusters are looked up by sorting: their sums are more than they look written
        side = lambda x: whole.select(F.col("c").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in ("n", "born", "h"))).hint("merge")  # noqa: B023, E731
        done = both.join(side("a"), "a").join(side("b"), "b").select(F.lit("all").alias("problem"), F.lit(round_).alias("round"), "a", "b", "born_a", "born_b", "n_a", "n_b", "sim", F.least("sim", "h_a", "h_b").alias("h"))
        merges.append(f"{folder}/{round_}")
        done.write.parquet(merges[-1])
        done = spark.read.schema(shape).parquet(merges[-1])
        sums = lambda x: whole.select(F.col("c").alias(x), F.col("s").alias(f"s_{x}")).hint("merge")  # noqa: B023, E731
        joint = done.join(sums("a"), "a").join(sums("b"), "b").select(F.col("a").alias("c"), (F.col("n_a") + F.col("n_b")).alias("n"), F.col("round").alias("born"), "h", F.zip_with("s_a", "s_b", lambda x, y: x + y).alias("s"))
        ends = done.select(F.col("a").alias("c")).union(done.select("b"))
        whole = saved(whole.hint("merge").join(ends, "c", "left_anti").unionByName(joint))
        left = whole.count()

    def rest(table: pa.Table) -> pa.Table:
        table = table.sort_by("c").combine_chunks()
        c, n, born, high = (table.column(k).to_numpy().copy() for k in ("c", "n", "born", "h"))
        sums, n, no, out = pc.list_flatten(table.column("s")).to_numpy().reshape(len(table), width).copy(), n.astype(float), round_, []
        _, _, best = _best(sums, n, c, sums, n, c)
        top = np.zeros(0)
        while len(c) > 1:
            no += 1
            i = np.flatnonzero((np.arange(len(c)) < best) & (best[best] == np.arange(len(c))))
            j = best[i]
            top = np.einsum("ij,ij->i", sums[i], sums[j]) / (n[i] * n[j])
            h = np.minimum(top, np.minimum(high[i], high[j]))
            out.append((np.full(len(i), no), c[i], c[j], born[i], born[j], n[i], n[j], top, h))
            touched, kept = np.zeros(len(c), bool), np.ones(len(c), bool)
            touched[i] = touched[j] = True
            kept[j] = False
            sums[i] += sums[j]
            n[i] += n[j]
            born[i], high[i] = no, h
            # no merged cluster is more similar than the more similar of its parts, and it is called as its smaller item's: the others keep their nearest
            again = (touched | touched[best])[kept]
            best = (np.cumsum(kept) - 1)[best][kept]
            sums, n, c, born, high = (v[kept] for v in (sums, n, c, born, high))
            if len(c) > 1:
                _, _, best[again] = _best(sums[again], n[again], c[again], sums, n, c)
        names_ = ["round", "a", "b", "born_a", "born_b", "n_a", "n_b", "sim", "h"]
        columns = [np.concatenate(v) for v in zip(*out, strict=True)] or [np.zeros(0)] * len(names_)
        made = [pa.array(v).cast(pa.float64() if k in ("sim", "h") else pa.int32()) for k, v in zip(names_, columns, strict=True)]
        return pa.table([pa.array(["all"] * len(made[0]), pa.string()), *made], names=["problem", *names_])

    merges.append(f"{folder}/rest")
    whole.groupBy(F.lit(0).alias("_one")).applyInArrow(rest, shape).write.parquet(merges[-1])
    return _staged(spark.read.schema(shape).parquet(*merges), "problem")


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of two columns of type int."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    out = np.full(len(a), 42, np.uint64)
    with np.errstate(over="ignore"):
        for v in (a, b):
            out = out + p5 + np.uint64(4)
            out ^= (v.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * p1
            out = turned(out, 23) * p2 + p3
            out ^= out >> np.uint64(33)
            out *= p2
            out ^= out >> np.uint64(29)
            out *= p3
            out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _best(sums: np.ndarray, n: np.ndarray, ids: np.ndarray, others: np.ndarray, n2: np.ndarray, ids2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cluster the similarity of the most similar of ``others`` but itself (of equal ones that whose pair has the greatest hash), that hash, and its place; ``ids2`` ascend.
    Without another one the similarity is less than any."""
    top, tie, at = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    step = max(1, 2_000_000 // max(1, len(ids2)))
    for k in range(0, len(ids), step):
        some = slice(k, k + step)
        sim = sums[some] @ others.T
        sim /= n[some][:, None] * n2
        own = np.minimum(np.searchsorted(ids2, ids[some]), len(ids2) - 1)
        mine = np.flatnonzero(ids2[own] == ids[some])
        sim[mine, own[mine]] = -np.inf
        most = sim.max(axis=1)
        who, which = np.divmod(np.flatnonzero(sim == np.where(most > -np.inf, most, np.inf)[:, None]), len(ids2))
        x, y = np.minimum(ids[some][who], ids2[which]), np.maximum(ids[some][who], ids2[which])
        hashes = _pair_hash(x, y)
        order = np.lexsort((y, x, hashes, who))
        last = order[np.flatnonzero(np.diff(who[order], append=-1))]
        top[k + who[last]], tie[k + who[last]], at[k + who[last]] = most[who[last]], hashes[last], which[last]
    return top, tie, at


def _most_similar(whole: DataFrame, left: int, block: int = 8_192) -> DataFrame:
    """``(c, a, b, sim)``: each of the clusters ``(c, n, s)`` with the pair of it and its most similar other one."""
    blocks = max(2, -(-left // block))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("c").combine_chunks()
        kind, sums = shortest(pc.list_flatten(table.column("s")).to_numpy())
        return pa.table([table.column("x").combine_chunks().slice(0, 1), [table.column("c").to_numpy().tobytes()], [table.column("n").to_numpy().astype(float).tobytes()], [sums], [kind]], names=["x", "c", "n", "s", "kind"])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(len(part)):
                r = part.slice(k, 1).to_pylist()[0]
                side = lambda p: (np.frombuffer(r[f"{p}s"], r[f"{p}kind"]).astype(float), np.frombuffer(r[f"{p}n"]), np.frombuffer(r[f"{p}c"], np.int32))  # noqa: B023, E731
                (s1, n1, c1), (s2, n2, c2) = side(""), side("o_")
                top, tie, at = _best(s1.reshape(len(c1), -1), n1, c1, s2.reshape(len(c2), -1), n2, c2)
                there = top > -np.inf
                one, other = c1[there], c2[at[there]]
                yield pa.record_batch([one, np.minimum(one, other), np.maximum(one, other), top[there], tie[there]], names=["c", "a", "b", "sim", "tie"])

    packed = whole.withColumn("x", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")).groupBy("x").applyInArrow(pack, "x int, c binary, n binary, s binary, kind string").repartitionById(min(blocks, 64), F.col("x") % min(blocks, 64))
    pairs = packed.select("c", "n", "s", "kind").crossJoin(packed.select(*(F.col(k).alias(f"o_{k}") for k in ("c", "n", "s", "kind"))).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(compare, "c int, a int, b int, sim double, tie long")
    return found.groupBy("c").agg(F.max(F.struct("sim", "tie", "a", "b")).alias("m")).select("c", "m.a", "m.b", "m.sim")


#: How many merges of a dendrogram, a few numbers each, are one task's work; more are joined.
MOST_MERGES = 2_000_000


def _walked(merges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(left, right, sim, place, size)`` of merges in order of their stages: children's places (leaves behind all merges), how many leaves stand before
    a node's, from left to right, and how many it has."""
    merges = merges.sort_by("stage").combine_chunks()
    stage, left, right = (merges.column(c).to_numpy().astype(np.int64) for c in ("stage", "left", "right"))
    m = len(stage)
    left, right = (np.where(v < 0, m - 1 - v, np.searchsorted(stage, v)) for v in (left, right))
    size, place = [0] * m + [1] * int(max(left.max(initial=m - 1), right.max(initial=m - 1)) - m + 1), [0] * int(max(left.max(initial=m - 1), right.max(initial=m - 1)) + 1)
    ways = list(zip(left.tolist(), right.tolist(), strict=True))
    for k, (x, y) in enumerate(ways):
        size[k] = size[x] + size[y]
    under = np.zeros(len(place), bool)
    under[left] = under[right] = True
    at = 0
    for k in np.flatnonzero(~under[:m]).tolist():
        place[k], at = at, at + size[k]
    for k in range(m - 1, -1, -1):
        x, y = ways[k]
        place[x], place[y] = place[k], place[k] + size[x]
    return left, right, merges.column("sim").to_numpy(), np.array(place, np.int64), np.array(size, np.int64)


def _ways(merges: DataFrame, level: float) -> DataFrame:
    """``(leaf, way, deep)``: the way from the top to each leaf, 0 for left and 1 for right, and how far
    over the leaf its topmost node over ``level`` is. Each round joins the ways with themselves, so
    that they reach twice as far up; rounds are as many as the depth has binary digits."""
    at = F.when(F.col("sim") > level, 1).alias("deep")
    side = lambda child, way: merges.select(F.col(child).alias("node"), F.col("stage").alias("up"), F.lit(way).alias("way"), at)
    ways = saved(side("left", "0").unionByName(side("right", "1")))
    while True:
        over = ways.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("way").alias("_way"), F.col("deep").alias("_deep"))
        if ways.join(over.select("up"), "up", "left_semi").isEmpty():
            return ways.where("node < 0").select((-F.col("node")).alias("leaf"), "way", "deep")
        deep = F.coalesce(F.col("_deep") + F.length("way"), F.col("deep")).alias("deep")
        ways = saved(ways.join(over, "up", "left").select("node", F.coalesce("_up", "up").alias("up"), F.concat(F.coalesce("_way", F.lit("")), "way").alias("way"), deep))


def cut_dendrogram(merges: DataFrame, level: float, held: int = MOST_MERGES) -> DataFrame:
    """``(leaf, cluster)``: nodes with a similarity up to ``level`` are split, all below another is one
    cluster; clusters are numbered from 0 in order from left to right. Up to ``held`` merges are walked, from the top, by a task."""

    def run(table: pa.Table) -> pa.Table:
        left, right, sim, place, _ = _walked(table)
        m = len(left)
        over, top = sim > level, np.arange(len(place)).tolist()
        whole = over.tolist()
        for k in range(m - 1, -1, -1):
            if whole[k]:
                for c in (int(left[k]), int(right[k])):
                    top[c] = top[k]
                    if c < m:
                        whole[c] = True
        leaves = np.sort(np.concatenate([v[v >= m] for v in (left, right)]))
        first = place[np.array(top)[leaves]]
        return pa.table([pa.array((leaves - m + 1).astype(np.int32)), pa.array(np.unique(first, return_inverse=True)[1].astype(np.int32))], names=["leaf", "cluster"])

    if merges.count() <= held:
        return merges.select("stage", "left", "right", F.col("sim").cast("double").alias("sim")).groupBy(F.lit(0).alias("_one")).applyInArrow(run, "leaf int, cluster int")
    # the way from the top as far as the topmost node over the level names the cluster
    top = _ways(merges, level).withColumn("node", F.when(F.col("deep").isNull(), F.col("way")).otherwise(F.expr("substring(way, 1, length(way) - deep)")))
    top = saved(top.select("leaf", "node"))
    numbers = numbered_rows(top.select("node").distinct(), ["node"])
    return top.join(numbers, "node").select("leaf", (F.col("_place") - 1).cast("int").alias("cluster"))


#: Descendants this many steps below weigh less in a mean of means than a double can tell.
_DEEPEST = 64


def layout_dendrogram(merges: DataFrame, held: int = MOST_MERGES) -> DataFrame:
    """``(stage, x0, y0, x1, y1)``: the three lines of each node: leaves stand in order from left to right
    at height 0, a node at the mean of its children, at 0.001 less its similarity. Up to ``held`` merges are walked by a task; more are joined.

    A mean of means weighs each leaf by a half for each step down to it. The steps are found by
    joining pairs of nodes and descendants with themselves, up to 64 at most, so there are no more than
    64 rows for each node."""
    merges = saved(merges.select("stage", "left", "right", "sim"))
    kind = merges.schema["stage"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        left, right, sim, place, _ = _walked(table)
        m = len(left)
        x, ways = place.astype(float).tolist(), zip(left.tolist(), right.tolist(), strict=True)
        for k, (a, b) in enumerate(ways):
            x[k] = (x[a] + x[b]) / 2
        x, y = np.array(x), np.concatenate([0.001 - sim, np.zeros(len(place) - m)])
        stage = np.sort(table.column("stage").to_numpy())
        lines = ((x[left], y[left], x[left], y[:m]), (x[right], y[right], x[right], y[:m]), (x[left], y[:m], x[right], y[:m]))
        return pa.table([np.tile(stage, 3), *(np.concatenate(v) for v in zip(*lines, strict=True))], names=["stage", "x0", "y0", "x1", "y1"])

    if merges.count() <= held:
        return merges.withColumn("sim", F.col("sim").cast("double")).groupBy(F.lit(0).alias("_one")).applyInArrow(run, f"stage {kind}, x0 double, y0 double, x1 double, y1 double")
    leaves = numbered_rows(_ways(merges, float("inf")).select("leaf", "way"), ["way"])
    x_of = leaves.select((-F.col("leaf")).alias("node"), (F.col("_place") - 1).cast("double").alias("x"))
    below = saved(merges.select("stage", "left").union(merges.select("stage", "right")).toDF("stage", "node").withColumn("steps", F.lit(1)))
    reach = 1
    while reach < _DEEPEST:
        more = below.select(F.col("stage").alias("node"), F.col("node").alias("_node"), F.col("steps").alias("_steps"))
        ends = below.where((F.col("steps") == reach) & (F.col("node") > 0)).join(more, "node")
        if ends.isEmpty():
            break
        below = saved(below.union(ends.select("stage", "_node", F.col("steps") + F.col("_steps"))))
        reach *= 2
    inner = below.join(x_of, "node").groupBy("stage").agg(F.sum(F.col("x") * F.pow(F.lit(0.5), "steps")).alias("x"))
    at = merges.select(F.col("stage").alias("node"), (0.001 - F.col("sim")).alias("y")).join(inner.withColumnRenamed("stage", "node"), "node")
    at = saved(at.select("node", "x", "y").union(x_of.withColumn("y", F.lit(0.0))))
    side = lambda c: at.select(F.col("node").alias(c), F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}"))
    rows = merges.join(side("left"), "left").join(side("right"), "right").withColumn("y", 0.001 - F.col("sim"))
    line = lambda *c: F.struct(*(F.col(x).alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1"), strict=True)))
    lines = F.array(line("x_left", "y_left", "x_left", "y"), line("x_right", "y_right", "x_right", "y"), line("x_left", "y", "x_right", "y"))
    return rows.select("stage", F.inline(lines))
