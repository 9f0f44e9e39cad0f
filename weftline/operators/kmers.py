"""Stretches of symbol sequences ``(seq_id, ints)``, and Markov chains of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as W


def kmer_counts(sequences: DataFrame, k: int = 5, literal: bool = False) -> DataFrame:
    """``(seq_id, kmer, count)``; ``kmer`` holds symbols joined by spaces. ``literal`` leaves out the last
    place of each sequence."""
    n = F.size("ints") - k + (0 if literal else 1)
    at = F.transform(W.places(n), lambda i: F.array_join(F.slice("ints", i, F.lit(k)), " "))
    return sequences.select("seq_id", F.explode(at).alias("kmer")).groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("count"))


def transitions(sequences: DataFrame) -> DataFrame:
    """``(seq_id, prev, next, count, p, cdf)``: neighbouring symbols, their share of all that follow
    ``prev``, and its running sum. Negative symbols (unmapped) don't count."""
    pairs = F.zip_with(F.slice("ints", F.lit(1), F.greatest(F.size("ints") - 1, F.lit(0))), F.slice("ints", F.lit(2), F.greatest(F.size("ints") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("prev"), b.alias("next")))
    rows = sequences.where(F.size("ints") > 1).select("seq_id", F.explode(pairs).alias("e")).select("seq_id", "e.prev", "e.next").where("prev >= 0 and next >= 0")
    counts = rows.groupBy("seq_id", "prev", "next").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy("seq_id", "prev")
    total = F.sum("count").over(whole)
    running = F.sum("count").over(whole.orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumns({"p": F.col("count") / total, "cdf": running / total})


def _chain(ints: np.ndarray) -> np.ndarray:
    radix = int(ints.max()) + 1
    counts = np.zeros((radix, radix))
    good = (ints[:-1] >= 0) & (ints[1:] >= 0)
    np.add.at(counts, (ints[:-1][good], ints[1:][good]), 1)
    sums = counts.sum(axis=1, keepdims=True)
    return np.cumsum(np.divide(counts, sums, out=np.zeros_like(counts), where=sums > 0), axis=1)


def _stretches(rows: np.ndarray, k: int, radix: int) -> np.ndarray:
    """All stretches of ``k`` symbols (from 0, below ``radix``) of each row, as numbers (Python's own, however
    large, where 62 bits do not do)."""
    n = rows.shape[1] - k + 1
    out = np.zeros((len(rows), n), np.int64 if radix**k < 2**62 else object)
    for j in range(k):
        out = out * radix + rows[:, j : j + n]
    return out


def profile_weights(sequences: DataFrame, k: int = 5, runs: int = 100, quantile: float = 0.75, seed: int = 0) -> DataFrame:
    """``(seq_id, kmer, w)``: how often a sequence holds a stretch over how often simulations of its own
    Markov chain do (the order statistic at ``quantile``); null where that is 0.

    A simulation starts in state 0 and draws as many symbols; where no entry of a row exceeds the draw
    it goes to the last state. Each sequence is simulated by itself, with a seed of its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for seq_id, ints in zip(part["seq_id"], part["ints"], strict=True):
                ints = np.asarray(ints, np.int64)
                if len(ints) < k or ints.max() < 0:
                    continue
                low = min(0, int(ints.min()))  # simulated states count from 0
                own = _stretches(ints[None] - low, k, int(ints.max()) - low + 1)[0]
                kinds, first, seen = np.unique(own, return_index=True, return_counts=True)
                cdf = _chain(ints)
                rng = np.random.default_rng((seed, int(seq_id) & 0xFFFFFFFF))
                state, paths = np.zeros(runs, np.int64), np.empty((runs, len(ints)), np.int64)
                for step in range(len(ints)):
                    over = cdf[state] > rng.random(runs)[:, None]
                    state = np.where(over.any(axis=1), over.argmax(axis=1), cdf.shape[0] - 1)
                    paths[:, step] = state
                codes = _stretches(paths - low, k, int(ints.max()) - low + 1)
                at = np.searchsorted(kinds, codes)
                hit = (at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == codes)
                run = np.broadcast_to(np.arange(runs)[:, None], codes.shape)
                made = np.bincount((run * len(kinds) + at)[hit], minlength=runs * len(kinds)).reshape(runs, len(kinds))
                base = np.sort(made, axis=0)[int(quantile * runs)]
                for m, count, b in zip(first.tolist(), seen.tolist(), base.tolist(), strict=True):
                    rows.append((seq_id, " ".join(map(str, ints[m : m + k].tolist())), count / b if b else None))
            yield pd.DataFrame(rows, columns=["seq_id", "kmer", "w"]).astype({"w": "float64"})

    return sequences.select("seq_id", "ints").mapInPandas(run, "seq_id long, kmer string, w double").withColumn("w", F.when(F.isnan("w"), None).otherwise(F.col("w")))
