"""Whitening of vectors: their principal components by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_row, saved, unpacked_row
from .embeddings import _finite

LIMIT = 10**38  # a sum of squares beyond it has no decimal of 38 digits


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections: it has the same inertia
    at every shift."""
    a = a.copy()
    d = len(a)
    off = np.zeros(max(0, d - 1))
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        off[k] = -np.copysign(norm, x[0])
        x[0] -= off[k]
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        p -= (x @ p) * x
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
    if d > 1:
        off[-1] = a[d - 1, d - 2]
    return np.diag(a).copy(), off


def count_above(diag: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: positive pivots of the shifted matrix (Sylvester)."""
    tiny, pivot, n = np.finfo(float).tiny, 1.0, 0
    for k, v in enumerate(diag.tolist()):
        pivot = v - shift - (off[k - 1] * (off[k - 1] / pivot) if k else 0.0)
        pivot = -tiny * 4 if pivot == 0 else pivot
        n += bool(pivot > 0)
    return n


def slices(a: np.ndarray, wanted: int, width: int = 8) -> list[tuple[float, float, int]]:
    """Intervals ``(low, high, n)`` that hold the ``wanted`` largest eigenvalues of ``a`` and those that cannot be told from
    the last of them, about ``width`` in each; ends lie in gaps, and ``n`` is what inertia counts between them."""
    diag, off = tridiagonal(a)
    size = max(float(np.abs(a).sum(axis=1).max()), np.finfo(float).tiny)
    top, floor_ = size * 1.001, -size * 1.001

    def bracket(k: int) -> tuple[float, float]:
        """Two shifts around the ``k``-th largest eigenvalue."""
        low, high = floor_, top
        while high - low > 1e-13 * size:
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (mid, high) if count_above(diag, off, mid) >= k else (low, mid)
        return low, high

    def end(k: int) -> tuple[float, int]:
        """A shift in the gap below the ``k``-th eigenvalue, or the first one after it that has a gap below."""
        low, _ = bracket(k)
        while k < len(a):
            next_low, next_high = bracket(k + 1)
            if low - next_high > 1e-11 * size:
                return (low + next_high) / 2, k
            low, k = next_low, k + 1
        return low - 0.1 * size, k

    highest = bracket(1)[1]
    out, at, done = [], highest, 0
    while done < wanted:
        low, k = end(min(wanted, done + width))
        # the first interval starts as far above the largest eigenvalue as its last one is from its lower end
        high = highest + max(highest - low, 1e-3 * size) * 0.1 if not done else at
        out.append((low, high, count_above(diag, off, low) - count_above(diag, off, high)))
        at, done = low, k
    return out


def feast(a: np.ndarray, low: float, high: float, n: int, nodes: int = 16, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` eigenvalues of a symmetric matrix between ``low`` and ``high``, and unit eigenvectors as columns.

    A block of vectors is projected onto the eigenvectors of the interval by a Gauss-Legendre quadrature of the resolvent
    around it (solves with complex shifted matrices, half the circle, as the matrix is real); Rayleigh-Ritz extracts pairs, which start the next round. It ends when as many
    values as inertia counts lie inside and their residuals are no larger than rounding; if they never do, it fails."""
    d = len(a)
    size, wide = max(float(np.linalg.norm(a)), np.finfo(float).tiny), min(d, n + max(4, n // 2))
    x, w = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(-0.5j * np.pi * (x - 1))
    middle, radius = (low + high) / 2, (high - low) / 2
    y = np.random.default_rng(seed).standard_normal((d, wide))
    best = np.inf
    for _ in range(rounds):
        onto = np.zeros_like(y)
        for t, weight in zip(turn, w, strict=True):
            onto += weight / 2 * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - a, y)).real
        basis, _ = np.linalg.qr(onto)
        ritz, mix = np.linalg.eigh(basis.T @ a @ basis)
        y = basis @ mix
        inside = np.flatnonzero((ritz > low) & (ritz < high))
        if len(inside) == n:
            off = np.linalg.norm(a @ y[:, inside] - y[:, inside] * ritz[inside], axis=0).max(initial=0) / size
            if off <= 1e-15 * d or (off <= 1e-12 and off > best / 2):
                return ritz[inside], y[:, inside]
            best = min(best, off)
    raise ArithmeticError(f"{n} eigenvalues between {low} and {high} were not all found")


def _summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray | None:
    """The sum over the rows of ``fit`` (``x``, whole numbers) of what ``part`` makes of some of them: each task adds up its rows,
    sixteen tasks add these sums and one the rest, so what is sent and held is one sum of the size of ``part``'s result.
    ``whole``: integers of any length, 32 bytes each."""

    def packed(total: np.ndarray) -> bytes:
        return b"".join(int(v).to_bytes(32, "little", signed=True) for v in total) if whole else total.astype("<f8").tobytes()

    def unpacked(data: bytes) -> np.ndarray:
        return np.array([int.from_bytes(data[k : k + 32], "little", signed=True) for k in range(0, len(data), 32)], object) if whole else np.frombuffer(data, "<f8")

    def first(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches_:
            for at in range(0, b.num_rows, 4096):
                now = part(_numbers(b.column(0).slice(at, 4096)))
                total = now if total is None else total + now
        if total is not None:
            yield pa.record_batch([pa.array([packed(total)], pa.binary())], names=["s"])

    def again(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches_:
            for data in b.column(0).to_pylist():
                total = unpacked(data) if total is None else total + unpacked(data)
        if total is not None:
            yield pa.record_batch([pa.array([packed(total)], pa.binary())], names=["s"])

    sums = fit.select("x").mapInArrow(first, "s binary").repartition(16).mapInArrow(again, "s binary").repartition(1).mapInArrow(again, "s binary")
    row = sums.first()  # one row
    return None if row is None else unpacked(bytes(row.s))


def _numbers(column: pa.Array) -> np.ndarray:
    """Equally long lists of integers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _largest(x: np.ndarray) -> int:
    """The largest size of a number in ``x`` (the lowest one of 64 bits has no counterpart there)."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: in 64 bits where they are enough."""
    if n * _largest(x) + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, vector: str = "embedding", seed: int = 0) -> DataFrame:
    """The rows of ``vectors`` that have a place, once for each component: with ``_component`` (from 1), ``_n``,
    ``_deviation`` (decimal), ``_whitened``, ``_explained`` and ``_identity_error``.

    A vector becomes ``x = floor(scale * c)``, component by component. The fit list has each distinct ``x`` once: ``_n`` vectors with
    mean ``m`` and, centred before multiplying, covariance ``V`` (divisor ``n``). The principal components with the largest eigenvalues
    are found by FEAST (``feast``): the spectrum is cut into intervals at gaps, by inertia counts, and each interval is a
    task of its own. ``_whitened`` is ``x - m`` on a component over the root of its eigenvalue, ``_explained`` the eigenvalue's share of the
    trace, ``_deviation`` the sum of ``(n x - S)^2``, exact (null beyond 38 digits), and ``_identity_error`` the largest entry of the fit list's whitened
    covariance minus the identity. Signs are arbitrary, as are directions among equal eigenvalues, but the same for all rows.

    Vectors that are null or hold null or non-finite components have no place. Shorter vectors are filled with zeros. Components without
    variance are left out, as nothing can be divided by it: one distinct vector, or none, or no coordinate, gives no rows. Repeated rows come each.
    Numbers beyond 64 bits are held at their limits. Columns of ``vectors`` stay; only one that is called as an added one is replaced by it.

    The matrix of dimension x dimension is what the driver and each task hold; all else is rows."""
    v = F.col(vector).cast("array<double>")
    usable = _finite(v) | (v.isNotNull() & (F.size(v) == 0))
    rows = packed_row(vectors, x=F.when(usable, F.transform(v, lambda c: F.floor(c * scale).cast("long")))).where(F.col("x").isNotNull())
    top = rows.agg(F.max(F.size("x"))).first()[0]
    kinds = {"_component": "int", "_n": "long", "_deviation": "decimal(38,0)", "_whitened": "double", "_explained": "double", "_identity_error": "double"}
    none = unpacked_row(rows.where("false"), vectors, **{c: F.lit(None).cast(t) for c, t in kinds.items()})
    if not top:
        return none
    dim = int(top)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))))
    fit = saved(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")))

    def count_and_sums(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.array([len(x)], object), x.astype(object).sum(axis=0) if _largest(x) > 2**48 else x.sum(axis=0).astype(object)])

    n, *sums = (int(k) for k in _summed(fit, count_and_sums, whole=True))

    def centred(x: np.ndarray) -> np.ndarray:
        return _scaled(x, n, sums).astype(np.float64) / n

    cov = _summed(fit, lambda x: (lambda c: c.T @ c)(centred(x)).ravel()).reshape(dim, dim) / n
    cov = (cov + cov.T) / 2
    trace = float(np.trace(cov))
    diag, off = tridiagonal(cov)
    wanted = min(components, count_above(diag, off, 1e-13 * dim * trace)) if trace > 0 else 0
    if not wanted:
        return none
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(cov)  # bounded: dimension x dimension

    def each(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            for r in b.to_pylist():
                e, w = feast(sent.value, r["low"], r["high"], r["n"], seed=seed)
                yield pa.record_batch([pa.array(e.tolist()), pa.array([c.tolist() for c in w.T], pa.list_(pa.float64()))], names=["e", "w"])

    cut = slices(cov, wanted)
    found = spark.createDataFrame(cut, "low double, high double, n int").repartition(len(cut)).mapInArrow(each, "e double, w array<double>").collect()  # a row for each component
    found = sorted(found, key=lambda r: -r.e)
    if len(found) != count_above(diag, off, cut[-1][0]):
        raise ArithmeticError("inertia counts other eigenvalues than were found")
    found = found[:wanted]
    values, axes = np.array([r.e for r in found]), np.array([r.w for r in found]).T
    onto = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ onto
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    told = _summed(fit, moments) / n
    mean = told[:wanted]
    error = float(np.abs(told[wanted:].reshape(wanted, wanted) - np.outer(mean, mean) - np.eye(wanted)).max())

    @F.arrow_udf("struct<d:decimal(38,0),z:array<double>>")
    def placed(column: pa.Array) -> pa.Array:
        from decimal import Decimal

        whole = _scaled(_numbers(column), n, sums)
        big = float(np.abs(whole.astype(np.float64)).max(initial=0)) ** 2 * dim >= 2.0**62
        squares = ((whole.astype(object) if big else whole) ** 2).sum(axis=1)
        z = (whole.astype(np.float64) / n) @ onto
        d = pa.array([Decimal(int(s)) if s < LIMIT else None for s in squares.tolist()], pa.decimal128(38, 0))
        return pa.StructArray.from_arrays([d, pa.array(z.tolist(), pa.list_(pa.float64()))], ["d", "z"])

    rows = rows.select("row", placed("x").alias("p")).select("row", F.col("p.d").alias("d"), F.posexplode("p.z").alias("k", "z"))
    share = F.element_at(F.array(*(F.lit(float(e / trace)) for e in values)), F.col("k") + 1)
    return unpacked_row(rows, vectors, _component=F.col("k") + 1, _n=F.lit(n).cast("long"), _deviation="d", _whitened="z", _explained=share, _identity_error=F.lit(error))
