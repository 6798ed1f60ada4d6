"""Embedding whitening: distributed covariance, float32 eigenvectors refined in higher precision.

A component becomes the whole number ``floor(256 c)``.  The fit list holds every distinct vector
once; a vector that a third of all rows repeats collapses in the tasks before the exchange.

1. :func:`moments` sums the fit list, then the products of its rows less the rounded mean.  Both
   are sums of whole numbers: exact (below 2**53) and the same in every run.  What the rounding
   left of the mean, below 1/2, is taken from the covariance afterwards, where nothing cancels.
2. :func:`eigen` starts from single-precision eigenvectors of the covariance and corrects them by
   the Ogita-Aishima iteration, a few matrix products a step that square the error: in doubles
   first, then in extended precision.  Eigenvalues closer than the error so far form a cluster,
   whose directions the iteration only makes orthonormal; a sub-solve of the cluster's own small
   matrix, shifted by its mean, turns them.  Only the covariance, dims x dims, is on the driver.
3. Rows are projected in one pass; the whitened covariance is measured on the fit list.

Null and empty vectors and vectors with null or non-finite components (or beyond 2**31) are left
out, and so are vectors of another length than the most frequent one (the longest of equally
frequent ones).  Repeated rows are all returned and count once in the fit; a null identifier is
kept.  Equal eigenvalues may share any orthonormal basis.  The sign makes the largest entry of a
component positive.  A direction without variance has null ``whitened``; without any variance
``explained`` and ``identity_error`` are null.  A deviation beyond 64 bits is null.  An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stage, whole_vectors

COMPONENTS = 4
STEPS = 40


# ---- eigenvectors ------------------------------------------------------------------------


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of eigenvalues that chains of gaps of at most ``gap`` hold together."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refine(a: np.ndarray, x: np.ndarray, goal: float, close: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues, vectors and steps of the Ogita-Aishima iteration in the precision of ``a``,
    until no entry of a correction exceeds ``goal`` or corrections no longer shrink.

    Eigenvalues closer than ``close`` (of the norm) count as a cluster at any rate: a quotient by
    their difference would only magnify rounding."""
    one = np.eye(len(a), dtype=a.dtype)
    norm = np.linalg.norm(a.astype(np.float64), 2)
    last = np.inf

    def products():
        r = one - x.T @ x
        s = x.T @ (a @ x)
        return r, s, np.diag(s) / (1 - np.diag(r))

    for step in range(1, steps + 1):
        r, s, values = products()
        off = (s - np.diag(values)).astype(np.float64)
        gap = max(2 * (np.linalg.norm(off, 2) + norm * np.linalg.norm(r.astype(np.float64), 2)), close * norm)
        turned = False
        for c in _clusters(values, gap):
            mean = values[c].mean()
            own = s[np.ix_(c, c)] + mean * r[np.ix_(c, c)] - mean * one[np.ix_(c, c)]  # as if orthonormal, less the mean
            size = float(np.abs(own).max())
            if size > np.finfo(a.dtype).eps * norm and np.abs(own - np.diag(np.diag(own))).max() > 1e-14 * size:
                x[:, c] = x[:, c] @ np.linalg.eigh(((own + own.T) / (2 * size)).astype(np.float64))[1].astype(a.dtype)
                turned = True
        if turned:
            r, s, values = products()
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ e
        change = float(np.abs(e).max())
        if not turned and (change <= goal or change >= last / 2):
            break
        last = change
    for _ in range(2):
        x = x + x @ (one - x.T @ x) / 2
    return products()[2], x, step


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, in extended precision."""
    scale = float(np.abs(cov).max(initial=0)) or 1.0
    a = cov.astype(np.longdouble) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    _, x, _ = refine(a.astype(np.float64), x, 1e-13, 1e-7)
    values, x, _ = refine(a, x.astype(np.longdouble), 1e-17, 1e-9)
    order = np.argsort(-values, kind="stable")
    values, x = values[order] * scale, x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))
    return values, x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])


# ---- moments -----------------------------------------------------------------------------


def _matrices(batches, column: int = 0):
    """The vectors of every batch as rows of whole numbers."""
    for batch in batches:
        if batch.num_rows:
            values = batch.column(column)
            ends = values.offsets.to_numpy()
            yield batch, values.values.to_numpy()[ends[0] : ends[-1]].reshape(batch.num_rows, -1)


class Moments(NamedTuple):
    """Size and sums of the fit list, and its covariance."""

    n: int
    sums: list[int]
    cov: np.ndarray


def moments(fit: DataFrame, dims: int) -> Moments:
    """Of vectors ``x`` of ``dims`` whole numbers; tasks send one row per dimension."""

    def first(batches):
        n, total = 0, np.zeros(dims, np.int64)
        for _, x in _matrices(batches):
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([n, *total], pa.int64())], names=["i", "s"])

    sums = {r.i: r.s for r in fit.select("x").mapInArrow(first, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n, sums = sums.get(-1, 0), [sums.get(i, 0) for i in range(dims)]
    if not n:
        return Moments(0, sums, np.zeros((dims, dims)))
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)

    def second(batches):
        total = np.zeros((dims, dims))
        for _, x in _matrices(batches):
            z = (x - centre).astype(np.float64)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "products"])

    rows = fit.select("x").mapInArrow(second, "i int, products array<double>").select("i", F.posexplode("products").alias("j", "p"))
    cov = np.zeros((dims, dims), np.longdouble)
    for i, j, p in rows.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        cov[i, j] = p
    left = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, centre, strict=True)], np.longdouble)
    return Moments(n, sums, cov / n - np.outer(left, left))


# ---- whitening ---------------------------------------------------------------------------


def fitted_rows(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the remaining rows, and their dimensions."""
    whole = stage(whole_vectors(vectors, vec_id, vector).where(F.size("x") > 0), "whitening-rows")
    sizes = whole.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = sizes.dims if sizes else 0
    return whole.where(F.size("x") == dims), dims


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every remaining
    row and each of the first ``components`` components."""
    rows, dims = fitted_rows(vectors, vec_id, vector)
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    n, sums, cov = moments(fit, dims)
    values, axes = eigen(cov) if n else (np.zeros(0), np.zeros((0, 0)))
    m = min(components, dims)
    trace = float(np.trace(cov))
    flat = values[:m] <= dims * np.finfo(np.float64).eps * max(trace, 0.0)
    scaled = np.where(flat, 0, axes[:, :m] / np.sqrt(np.where(flat, 1, values[:m]))).astype(np.float64)
    mean = np.array([float(Fraction(s, max(n, 1))) for s in sums])
    exact = np.array(sums, object)
    explained = [float(v / trace) if trace > 0 else None for v in values[:m]]

    def measure(batches):
        seen, one, two = 0, np.zeros(m), np.zeros((m, m))
        for _, x in _matrices(batches):
            y = (x - mean) @ scaled
            seen, one, two = seen + len(y), one + y.sum(axis=0), two + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([two.ravel()])], names=["one", "two"])

    error = None
    if n and not flat.all():
        parts = fit.mapInArrow(measure, "one array<double>, two array<double>")
        total = parts.agg(*[F.sum(F.get("one", F.lit(i))).alias(f"a{i}") for i in range(m)], *[F.sum(F.get("two", F.lit(i))).alias(f"b{i}") for i in range(m * m)]).first()
        one = np.array(total[:m]) / n
        off = np.array(total[m:]).reshape(m, m) / n - np.outer(one, one) - np.eye(m)
        error = float(np.abs(off[np.ix_(~flat, ~flat)]).max())

    def deviations(x: np.ndarray) -> list:
        most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
        if dims * most * most < 1 << 63:
            return ((n * x - exact.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return [d if d < 1 << 63 else None for d in ((n * x.astype(object) - exact) ** 2).sum(axis=1)]

    def project(batches):
        for batch, x in _matrices(batches, 1):
            y = (x - mean) @ scaled
            k = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(k), m))),
                 pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()),
                 pa.array(np.full(k * m, n, np.int64)),
                 pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))),
                 pa.array(y.ravel(), mask=np.tile(flat, k)),
                 pa.array(explained * k, pa.float64()),
                 pa.array([error] * (k * m), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(
        project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
