"""Embedding whitening by spectral divide and conquer.

1. Entries are quantised to whole numbers x = floor(``scale`` * c) + ``origin``; the
   fit list holds each distinct x vector once, so copies don't weigh more.
2. Sums of the fit list are exact.  Its covariance is summed in the tasks, centred
   before multiplying: a task gives out one d x d matrix, whatever its rows.
3. The driver only sees that d x d matrix.  QDWH iterations give the orthogonal polar
   factor of the covariance minus a shift; (factor + identity) / 2 projects on the
   components above the shift.  Bases of the two invariant subspaces split the
   problem, and each half is split again, down to single components.
4. Mean and components, scaled by 1 / sqrt(eigenvalue), are broadcast and applied to
   every row; a last pass over the fit list measures how far the whitened
   covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.session import cut_lineage

from .common import small_batches

EPS = np.finfo(float).eps
LEAST_SHARE = 1e-10  # of the largest eigenvalue: a smaller one is rounding, and is no component


# --- polar decomposition and spectral splitting (d x d, on the driver) ---------------------

def polar_factor(a: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Orthogonal factor of the polar decomposition, by QR- and Cholesky-based dynamically weighted Halley iteration."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    try:
        low = 0.9 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x), 1))  # at most the least singular value
    except np.linalg.LinAlgError:
        low = EPS
    low = float(np.clip(low, EPS, 1))
    for _ in range(rounds):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * root), 0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))[0]
            after = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            factor = np.linalg.cholesky(np.eye(n) + wc * (x.T @ x))
            half = np.linalg.solve(factor, x.T)
            after = wb / wc * x + (wa - wb / wc) * np.linalg.solve(factor.T, half).T
        moved = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (wa + wb * low ** 2) / (1 + wc * low ** 2))
        if abs(low - 1) < 10 * EPS and moved < np.cbrt(5 * EPS):
            break
    return (x + x.T) / 2  # of a symmetric matrix it is symmetric


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``, and the size of what couples them."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return None
    upper = np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
    upper = np.linalg.qr(projector @ upper)[0]
    lower = rng.standard_normal((n, n - k))
    for _ in range(2):
        lower = lower - projector @ lower
        lower = np.linalg.qr(lower - upper @ (upper.T @ lower))[0]
    return upper, lower, float(np.linalg.norm(lower.T @ a @ upper))


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    d = len(a)
    rng = np.random.default_rng(13)
    accepted = 50 * d * EPS * max(np.linalg.norm(a), np.finfo(float).tiny)
    done, todo = [], [np.eye(d)] if d else []
    while todo:
        basis = todo.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        n = len(part)
        mean = np.trace(part) / n
        if n == 1 or np.linalg.norm(part - mean * np.eye(n)) <= 4 * n * EPS * np.linalg.norm(a):
            done.append(basis)  # one component, or equal eigenvalues: any basis will do
            continue
        spread = np.linalg.norm(part - mean * np.eye(n)) / np.sqrt(n)
        best = None
        # A shift beside the middle serves where an eigenvalue lies too close to it for a clean split.
        for shift in (float(np.median(np.diag(part))), mean, *(mean + s * spread for s in (0.3, -0.3, 0.1, -0.1, 0.6, -0.6))):
            found = _split(part, shift, rng)
            if found and (best is None or found[2] < best[2]):
                best = found
            if best and best[2] <= accepted:
                break
        if best is None:
            done.append(basis)
            continue
        todo += [basis @ best[1], basis @ best[0]]
    vectors = np.hstack(done) if done else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = np.linalg.qr(vectors[:, order])[0] if d else vectors  # once more orthonormal; directions stay
    return np.einsum("ij,ij->j", vectors, a @ vectors), vectors


# --- rows ------------------------------------------------------------------------------------

def _quantise(scale: int, origin: int) -> Callable:
    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            values = lists.flatten()
            size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            ends = np.cumsum(size)
            c = values.to_numpy(zero_copy_only=False).astype(float)  # a null entry becomes nan
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(c * scale)
            good = np.isfinite(x) & (np.abs(x) < 2.0 ** 62)
            bad = np.zeros(len(c) + 1, np.int64)
            np.cumsum(~good, out=bad[1:])
            keep = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]))
            whole = np.where(good, x, 0).astype(np.int64) + origin
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(keep)), pa.array([whole[ends[i] - size[i]:ends[i]].tobytes() for i in keep], pa.binary())],
                names=["vec_id", "x"])
    return run


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def _exact_sums(d: int) -> Callable:
    def run(batches):
        total = [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if len(x):
                wide = float(np.abs(x.astype(float)).max()) * len(x) >= 2.0 ** 62
                total = [t + int(s) for t, s in zip(total, (x.astype(object) if wide else x).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["i", "s"])
    return run


@dataclass
class _Centre:
    """The mean, as a whole part and what is left: x - whole is exact, whatever the size of x."""
    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        self.rest = np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, self.whole)])
        self.wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in self.sums], np.int64)
        self.whole = np.array(self.whole, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - sums)^2 of each row; null where that is beyond a long.

        Whole-number arithmetic wraps at 2^64, so it is exact wherever the result fits.
        """
        with np.errstate(over="ignore"):
            apart = np.int64(self.n) * x - self.wrapped
            exact = (apart * apart).sum(1)
            about = ((self.n * self.centred(x)) ** 2).sum(1)
        fits = about < 2.0 ** 63
        for i in np.flatnonzero((about > 2.0 ** 63 * (1 - 1e-6)) & (about < 2.0 ** 63 * (1 + 1e-6))):
            fits[i] = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[i], self.sums)) < 1 << 63
        return pa.array(exact, mask=~fits)


def _moments(transform: Callable, d: int, out: int) -> Callable:
    """Sums of products (and of the values, as row ``out``) of the transformed rows: ``out`` + 1 rows a task."""
    def run(batches):
        total = np.zeros((out + 1, out))
        for batch in batches:
            z = transform(_matrix(batch.column("x"), d))
            total[:out] += z.T @ z
            total[out] += z.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(out + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "s"])
    return run


def _added(key, table):
    """Element-wise sum of one row of the matrices: as many rows as there are tasks."""
    rows = table.column("s").combine_chunks()
    values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([values.sum(0)], pa.list_(pa.float64()))})


def _covariance(fit: DataFrame, n: int, transform: Callable, d: int, out: int) -> np.ndarray:
    """Covariance of the transformed fit list, divisor n: an ``out`` x ``out`` matrix, the only thing that reaches the driver."""
    sums = fit.mapInArrow(_moments(transform, d, out), "i int, s array<double>").groupBy("i").applyInArrow(_added, "i int, s array<double>")
    rows = {r["i"]: r["s"] for r in sums.collect()}
    mean = np.array(rows[out]) / n
    return np.array([rows[i] for i in range(out)]) / n - np.outer(mean, mean)


@dataclass
class Whitening:
    """A fitted whitening: ``matrix`` (d x components) takes centred rows to whitened ones."""
    centre: _Centre
    values: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float | None


def fit_whitening(fit: DataFrame, d: int, components: int) -> Whitening | None:
    """Fit on the distinct vectors ``x`` of ``fit``; None if there are none."""
    sums = {r["i"]: int(r["s"]) for r in fit.mapInArrow(_exact_sums(d), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = fit.count()
    if not n:
        return None
    centre = _Centre(n, [sums[i] for i in range(d)])
    cov = _covariance(fit, n, centre.centred, d, d)
    cov = (cov + cov.T) / 2
    values, vectors = spectral_components(cov)
    usable = int((values > LEAST_SHARE * max(values[0], 0)).sum()) if values[0] > 0 else 0
    k = min(components, usable)
    matrix = vectors[:, :k] / np.sqrt(values[:k])
    error = None
    if k:
        white = _covariance(fit, n, lambda x: centre.centred(x) @ matrix, d, k)
        error = float(np.abs(white - np.eye(k)).max())
    return Whitening(centre, values[:k], matrix, values[:k] / np.trace(cov) if k else values[:0], error)


def whiten_embeddings(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16,
                      scale: int = 64, origin: int = 1_000_000) -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array), identity_error for each row that has a usable vector.

    Defined cases: a row is dropped if its vector is null, empty, or holds a null or
    non-finite entry (one that no long can hold counts as such), or has another
    length than most vectors (among equally frequent lengths the longest counts); null
    and repeated ids are rows like any other; equal vectors are fitted once and each
    get their values.  Components whose eigenvalue is below 1e-10 of the largest are
    left out, so constant or too few vectors have fewer components, or empty arrays
    and a null identity_error.  ``deviation`` is null where it is beyond a long.  An empty
    table gives an empty result; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = small_batches(rows.where("v IS NOT NULL")).mapInArrow(_quantise(scale, origin), "vec_id long, x binary")
    rows = cut_lineage(rows, "vectors")
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    length = rows.groupBy(F.octet_length("x").alias("b")).count().orderBy(F.desc("count"), F.desc("b")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.octet_length("x") == length["b"])
    d = length["b"] // 8
    model = fit_whitening(cut_lineage(rows.select("x").distinct(), "fit"), d, components)
    shared = spark.sparkContext.broadcast(model)  # d x components numbers

    def apply(batches):
        fitted = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            white = fitted.centre.centred(x) @ fitted.matrix
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.full(m, fitted.centre.n)), fitted.centre.deviations(x),
                 pa.array(list(white), pa.list_(pa.float64())), pa.array([fitted.explained] * m, pa.list_(pa.float64())),
                 pa.array([fitted.identity_error] * m, pa.float64())],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(apply, schema)
