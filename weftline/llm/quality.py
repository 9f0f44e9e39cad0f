"""A quality classifier: linear hinge loss over n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, joined, mixed, saved

_RUN = re.compile(rb"(.)\1+", re.S)
#: Letters, digits and other bytes by kind; punctuation stays.
_KINDS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))


class _Tokens(dict):
    """For a word: 32 bits of a hash of its lower-case form and 32 of its shape."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_KINDS))
        self[word] = value = xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(shape)
        return value


_TOKENS = _Tokens()


def features(text: bytes, bits: int) -> np.ndarray:
    """The distinct hashed n-grams of a whole text: words and pairs of words; shapes of words (kinds of
    characters, runs as one), pairs and triples of shapes. An empty text has none."""
    words = text.split()
    both = np.fromiter(map(_TOKENS.__getitem__, words), np.uint64, len(words))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    s2 = joined(s[:-1], s[1:], 2)
    grams = [mixed(w), joined(w[:-1], w[1:], 1), mixed(s + np.uint64(1 << 40)), s2, joined(s2[:-1], s[2:], 3)]
    return np.unique((np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int32))


class Model(NamedTuple):
    """Weights of hashed n-grams (already times their ratios), and the line from margins to scores."""

    bits: int
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        margins = np.array([_mean(self.weights, features(t or b"", self.bits)) + self.bias for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _mean(weights: np.ndarray, found: np.ndarray) -> float:
    """Indicators are scaled to length 1, so that long texts weigh as short ones."""
    return float(weights[found].sum() / np.sqrt(len(found))) if len(found) else 0.0


def log_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of the smoothed class shares of each n-gram; ``counts`` is (class, n-gram)."""
    shares = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Linear hinge loss with squared-norm penalty by dual coordinate descent over rows of indicators
    times ``ratios``, scaled to length 1 each; ``y`` is 1 or -1. Classes weigh alike."""
    rng = np.random.default_rng(seed)
    scaled = [ratios[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([float(v @ v) + 1.0 for v in scaled])
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    bound = cost * 0.5 / np.maximum(share, 1e-9)
    dual, w, bias = np.zeros(len(rows)), np.zeros(len(ratios)), 0.0
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(rows)).tolist():
            slope = y[k] * (float(w[rows[k]] @ scaled[k]) + bias) - 1
            new = min(max(dual[k] - slope / square[k], 0.0), bound[k])
            step = (new - dual[k]) * y[k]
            if step:
                dual[k] = new
                w[rows[k]] += step * scaled[k]
                bias += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def fit_scores(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to labels (Newton's steps, damped)."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        grad = x @ (p - t) + 1e-6 * np.array([a, b])
        hess = (x * (p * (1 - p))) @ x.T + 1e-4 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    bits: int = 18,
    sample: int = 10_000,
    seed: int = 0,
) -> Model:
    """Learn from the labelled documents (label 0 or 1) for which ``train`` holds.

    N-grams are counted by class over all of them, on Spark. The hinge loss is fitted, in one task, on
    at most ``sample`` of them: those with the smallest hashes of their keys; a fifth of these only
    serves to turn margins into scores. Without labelled rows of both classes all scores are the share
    of label 1 (0.5 without any). Null texts are empty; rows with a null key or label don't count; a
    document with several labels counts with each.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    known = known.withColumnRenamed("_k", key).where(train).withColumnRenamed(key, "_k")
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    size = 1 << bits
    schema = pa.schema([("feature", pa.int32()), ("up", pa.int64()), ("down", pa.int64())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for part in parts:
            for few in (part.slice(at, 512) for at in range(0, part.num_rows, 512)):
                for t, y in zip(as_bytes(few.column(0)), few.column(1).to_pylist(), strict=True):
                    total[y, features(t or b"", bits)] += 1
        some = np.flatnonzero(total.any(axis=0)).astype(np.int32)
        yield pa.record_batch([some, total[1, some], total[0, some]], schema=schema)

    # always a shuffle join: whether labels would fit a broadcast changes with the size of the corpus
    counted = texts.join(known.hint("merge"), "_k").select("_t", "_y").mapInArrow(count, "feature int, up long, down long")
    told = counted.groupBy("feature").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).toArrow()  # bounded: 2^bits
    counts = np.zeros((2, size))
    at = told.column("feature").to_numpy()
    counts[1, at], counts[0, at] = told.column("up").to_numpy(), told.column("down").to_numpy()
    ratios = spark.sparkContext.broadcast(log_ratios(counts))
    chosen = known.orderBy(F.xxhash64("_k", F.lit(seed)), "_k", "_y").limit(sample)
    rows = texts.join(F.broadcast(saved(chosen)), "_k")  # bounded: sample

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_k", "ascending"), ("_y", "ascending")])
        y = np.where(table.column("_y").to_numpy() == 1, 1, -1)
        found = [features(t or b"", bits) for t in as_bytes(table.column("_t").combine_chunks())]
        w, bias, slope, shift = np.zeros(size), 0.0, 1.0, float(np.log(((y > 0).sum() + 1) / ((y < 0).sum() + 1)))
        if (y > 0).any() and (y < 0).any():
            rest = np.random.default_rng(seed).random(len(y)) < 0.8
            if not ((y[rest] > 0).any() and (y[rest] < 0).any() and (y[~rest] > 0).any() and (y[~rest] < 0).any()):
                rest[:] = True
            at = np.flatnonzero(rest).tolist()
            w, bias = fit_hinge([found[k] for k in at], y[rest], ratios.value, seed=seed)
            w = w * ratios.value
            check = np.flatnonzero(~rest if not rest.all() else rest).tolist()
            margins = np.array([_mean(w, found[k]) + bias for k in check])
            slope, shift = fit_scores(margins, y[check])
        return pa.table({"w": [w.tobytes()], "bias": [bias], "slope": [slope], "shift": [shift]})

    fitted = rows.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(fit, "w binary, bias double, slope double, shift double").first()
    if fitted is None:
        return Model(bits, np.zeros(size), 0.0, 1.0, 0.0)
    return Model(bits, np.frombuffer(fitted["w"]), fitted["bias"], fitted["slope"], fitted["shift"])


def score_quality(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every row of ``docs`` with ``_score`` (0 to 1, higher: label 1 is likelier) and ``_predicted``
    (1 from ``threshold`` on). Only the text counts; a null text is scored as an empty one, repeated rows
    are scored each. An empty table gives no rows. Columns of ``docs`` stay; only one called as an added one
    is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        scores = [shipped.value.scores(as_bytes(column.slice(at, 512))) for at in range(0, len(column), 512)]
        return pa.array(np.concatenate(scores) if scores else [], pa.float64())

    # asked for once, as a column of its own, so that nothing is scored twice
    scored = docs.withColumn("_score", score(F.col(text)))
    return scored.withColumn("_predicted", (F.col("_score") >= threshold).cast("int"))
