"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_row, unpacked_row

_LETTER = np.zeros(0x110000, np.uint32)  # a letter's lower-case code point; 0 for all else
_SPACE = 32


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                _LETTER[c] = ord(low) if len(low) == 1 else c
    return _LETTER


def codes(text: str, n: int = 3) -> np.ndarray:
    """The n-grams (up to 3 letters) of a whole text, as numbers: lower-case letters, each run of
    anything else as one space, one space at either end. None without a letter."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    points = np.concatenate([[0], points, [0]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points = points[keep].astype(np.uint64)
    if not points.any():
        return np.empty(0, np.uint64)
    points[points == 0] = _SPACE
    out = points[: len(points) - n + 1].copy()
    for k in range(1, n):
        out = out << np.uint64(21) | points[k : len(points) - n + 1 + k]
    return out


class Space(NamedTuple):
    """Random letter vectors of +1 and -1, seeded by code point, so that all tasks draw alike."""

    dim: int = 1024
    n: int = 3
    seed: int = 7

    def letter(self, point: int) -> np.ndarray:
        return np.random.default_rng((self.seed, point)).integers(0, 2, self.dim).astype(np.int8) * 2 - 1

    def grams(self, found: np.ndarray) -> np.ndarray:
        """The vectors of n-grams: letters rotated by their places and multiplied."""
        out = np.ones((len(found), self.dim), np.int8)
        for place in range(self.n):
            points = (found >> np.uint64(21 * place)) & np.uint64(0x1FFFFF)
            some, which = np.unique(points, return_inverse=True)
            out *= np.stack([np.roll(_drawn(self, int(p)), place) for p in some])[which]
        return out.astype(np.float32)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """The sum of each text's n-gram vectors, at length 1; zeros without a letter."""
        each = [np.empty(0, np.uint64) if t is None else codes(t, self.n) for t in texts]
        sizes = [len(e) for e in each]
        if not sum(sizes):
            return np.zeros((len(texts), self.dim), np.float32)
        found, which = np.unique(np.concatenate(each), return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), sizes)
        out = np.zeros((len(texts), self.dim), np.float32)
        for at in range(0, len(found), 8192):  # so that memory is bounded whatever the texts hold
            here = (which >= at) & (which < at + 8192)
            m = min(8192, len(found) - at)
            counts = np.bincount(doc[here] * m + which[here] - at, minlength=len(texts) * m).reshape(len(texts), m)
            out += counts.astype(np.float32) @ self.grams(found[at : at + 8192])
        length = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
        return out / np.where(length > 0, length, 1)[:, None].astype(np.float32)


_DRAWN: dict[tuple[Space, int], np.ndarray] = {}


def _drawn(space: Space, point: int) -> np.ndarray:
    if (space, point) not in _DRAWN:
        if len(_DRAWN) > 20_000:
            _DRAWN.clear()
        _DRAWN[space, point] = space.letter(point)
    return _DRAWN[space, point]


class Profiles(NamedTuple):
    """A prototype of length 1 for each language."""

    space: Space
    names: list[str]
    vectors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        docs = self.space.bundle(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        near = docs.astype(np.float64) @ self.vectors.T
        best = np.argmax(near, axis=1)
        some = docs.any(axis=1)
        return [self.names[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, np.clip(near.max(axis=1), 0, 1), 0.0)


def fit_languages(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", space: Space = Space()) -> Profiles:
    """Prototypes: for each language the sum of the vectors of all its documents for which ``train``
    holds. Each task adds up its own documents; the sums (a row for each language and dimension)
    are whole numbers, so reruns agree. Null languages and texts without a letter don't count."""
    rows = docs.where(train & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    schema = pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for at in range(0, part.num_rows, 128):
                some = part.slice(at, 128)
                vectors = np.rint(space.bundle(some.column(0).to_pylist()) * 2.0**20).astype(np.int64)
                names = np.array(some.column(1).to_pylist(), object)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0)
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], schema=schema)

    sums = rows.mapInArrow(add, "lang string, v array<long>").select("lang", F.posexplode("v").alias("d", "x"))
    told = sums.groupBy("lang", "d").agg(F.sum("x").alias("x")).toArrow()  # bounded: languages and dimensions
    names = sorted(set(told.column("lang").to_pylist()))
    vectors = np.zeros((len(names), space.dim))
    at = {name: k for k, name in enumerate(names)}
    vectors[[at[x] for x in told.column("lang").to_pylist()], told.column("d").to_numpy()] = told.column("x").to_numpy()
    length = np.sqrt((vectors**2).sum(axis=1))
    some = np.flatnonzero(length)
    return Profiles(space, [names[k] for k in some], vectors[some] / length[some, None])


def identify_language(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``_lang`` (the language whose prototype has the highest cosine with
    the text's vector; of equal ones the first by name; ``und`` for a null text or one without a
    letter) and ``_cosine`` (0 to 1). Repeated rows are judged each. An empty table gives no rows; without
    prototypes all is ``und``. Columns of ``docs`` stay; only one called as an added one is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang string, cosine double>")
    def predict(column: pa.Array) -> pa.Array:
        names, near = [], []
        for at in range(0, len(column), 128):
            n, c = shipped.value.predict(column.slice(at, 128).to_pylist())
            names += n
            near += c.tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(near, pa.float64())], ["lang", "cosine"])

    out = packed_row(docs, said=predict(F.col(text)))
    return unpacked_row(out, docs, _lang="said.lang", _cosine="said.cosine")
