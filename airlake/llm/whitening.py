"""Whitening of embedding vectors: integer covariance, float32 eigenvectors, refinement in higher precision.

Every component c becomes the integer ``floor(scale * c) + shift``.  The fit list is each distinct integer vector once.  Its covariance is
exact: tasks sum products of ``x - m``, integers taken from the whole number next to the mean, and the few sums that come to the driver
(one number per pair of dimensions) are put together as integers around the true mean before the one division.

Eigenvectors begin as those of the covariance in float32 and are corrected by Ogita and Aishima's iteration, which is matrix products
only, in extended precision: from ``R = I - X'X`` and ``S = X'AX`` come the eigenvalues and the correction ``E`` with ``X <- X + XE``.  Where two
eigenvalues are closer than the iteration can tell apart, it only restores orthogonality, and the directions within such a cluster come from a
sub-solve: the covariance restricted to the cluster, less its mean eigenvalue, is small, so its own eigenvectors are accurate again.  Iteration
and sub-solves are repeated until the correction no longer shrinks.

Whitened values are projections of ``x - mean`` on unit eigenvectors over the square root of the eigenvalue.  Every eigenvector's largest entry
(first among equals) is positive.

Defined cases: vectors that are null, empty, or hold null or non-finite entries or such whose integer is beyond 2**53 take no part; if
lengths differ, the length that most rows have (the longer among equals) takes part; repeated rows and ids are whitened each, and are one row of the fit list
if their integers are equal; a null id stays null; a component whose eigenvalue is no more than rounding (constant or dependent dimensions, a single
vector) has null ``whitened`` and counts in no identity error; ``explained`` is 0 if nothing varies; a deviation beyond the 64 bits of a long is null; an empty table
gives an empty result.  Only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm.common import publish, table
from airlake.llm.registry import query

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Integers that doubles hold exactly.
EXACT = 1 << 53
ROWS = 2048
Wide = np.longdouble


class Basis(NamedTuple):
    """What whitening needs of a fit list."""

    n: int
    #: Sums of the distinct vectors by dimension, whole numbers.
    sums: list[int]
    values: np.ndarray
    #: One eigenvector a column, by falling eigenvalue.
    vectors: np.ndarray
    trace: float


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part; lengths may still differ."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * scale).alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(EXACT - 2 * shift)))
    return v.where(fine).select("vec_id", F.transform("v", lambda c: F.floor(c) + shift).alias("x"))


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).astype(np.int64, copy=False).reshape(len(lists), -1)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some, _matrix(some.column(column))


def products(y: np.ndarray) -> np.ndarray:
    """``y'y`` of integers, exact: in doubles where every partial sum is one, else in Python's integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T @ big


def _added(rows: DataFrame, width: int, of) -> list[int]:
    """Sums over all vectors of ``of(x)``, ``width`` whole numbers; each task sends its sums as text, so no size overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for _, x in _pieces(batches, 0):
            total = total + of(x)
        yield pa.RecordBatch.from_arrays([pa.array([list(map(str, total))], pa.list_(pa.string()))], names=["s"])

    sent = rows.select("x").mapInArrow(run, "s array<string>")
    # whole numbers of up to 38 digits
    added = sent.select(F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    out = [0] * width
    for r in added.collect():
        out[r["at"]] = int(r["s"])
    return out


def covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, the covariance times n squared in exact integers) of distinct vectors ``x``."""
    first = _added(fit, dims + 1, lambda x: np.concatenate(([len(x)], x.astype(object).sum(axis=0) if len(x) else np.zeros(dims, object))))
    n, sums = first[0], first[1:]
    if not n:
        return 0, sums, np.zeros((dims, dims), object)
    near = [(2 * s + n) // (2 * n) for s in sums]
    middle = np.array(near, np.int64)
    upper = np.triu_indices(dims)
    flat = _added(fit, len(upper[0]), lambda x: products(x - middle)[upper])
    gram = np.zeros((dims, dims), object)
    gram[upper] = flat
    gram.T[upper] = flat
    # around the true mean: less what lies between it and the whole number
    off = np.array([s - n * m for s, m in zip(sums, near)], object)
    return n, sums, n * gram - np.outer(off, off)


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of sorted eigenvalues whose neighbours are no more than ``gap`` apart."""
    cut = np.flatnonzero(np.abs(np.diff(values)) > gap) + 1
    return [c for c in np.split(np.arange(len(values)), cut)]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of the iteration: (eigenvalues, corrected vectors, size of the correction).  ``a`` is symmetric, in ``Wide``."""
    ax = a @ x
    r = np.eye(len(a), dtype=Wide) - x.T @ x
    s = x.T @ ax
    # what rounding makes unlike on either side of the diagonal would turn vectors that lie close
    r, s = (r + r.T) / 2, (s + s.T) / 2
    # ratio of both diagonals: a Rayleigh quotient that forgives a length other than 1
    values = np.diag(s) / (1 - np.diag(r))
    rest = s - np.diag(values)
    gap = 2 * (np.linalg.norm(rest.astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return values, x + x @ e, float(np.abs(e).max(initial=0))


def _turned(a: np.ndarray, values: np.ndarray, x: np.ndarray, gap: float) -> np.ndarray:
    """Vectors of clustered eigenvalues turned within their own space by a solve of it alone."""
    x = x.copy()
    for c in _clusters(values, gap):
        if len(c) > 1:
            own = x[:, c]
            middle = values[c].mean()
            # relative to its middle the cluster is spread out again
            small = own.T @ (a @ own) - middle * (own.T @ own)
            size = np.abs(small).max()
            if size > 0:
                _, turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(float))
                x[:, c] = own @ turn[:, ::-1].astype(Wide)
    return x


def eigenvectors(cov: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision."""
    size = np.abs(cov).max(initial=0)
    if size == 0:
        return np.zeros(len(cov)), np.eye(len(cov))
    # scaled by a power of two, which is exact, so that float32 neither overflows nor vanishes
    unit = np.exp2(np.floor(np.log2(size)))
    a = (cov / unit).astype(Wide)
    a = (a + a.T) / 2
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x[:, ::-1].astype(Wide)
    norm = np.linalg.norm(a.astype(float))
    # what float32 vectors can mix: sub-solves take over within it
    gap, before = norm * len(a) * 2.0**-22, np.inf
    for _ in range(steps):
        values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
        order = np.argsort(-values, kind="stable")
        x = _turned(a, values[order], x[:, order], gap)
        values, x, change = refine(a, x)
        if change < 2.0**-60 or (change < 2.0**-48 and change > before / 2):
            break
        before, gap = change, norm * min(gap / norm, max(change, 2.0**-56) * 8)
    for _ in range(2):
        x = x + x @ (np.eye(len(a), dtype=Wide) - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    lead = np.abs(x.astype(float)).round(12).argmax(axis=0)
    x = x * np.where(x[lead, np.arange(x.shape[1])] < 0, -1, 1)
    return (values * unit).astype(float), x.astype(float)


def fit(vectors: DataFrame, dims: int) -> tuple[Basis, DataFrame]:
    """The basis of (x array<long>) rows of one length, and their fit list."""
    listed = publish(vectors.select("x").distinct(), "whitening-fit")
    n, sums, scaled = covariance(listed, dims)
    if not n:
        return Basis(0, sums, np.zeros(dims), np.eye(dims), 0.0), listed
    # whole numbers over a whole number: the first rounding of the covariance
    high = (scaled // (n * n)).astype(Wide) + ((scaled % (n * n)) / (n * n)).astype(Wide)
    values, x = eigenvectors(high)
    trace = sum(scaled[i, i] for i in range(dims)) / (n * n)
    # an eigenvalue of rounding size is zero
    values = np.where(values > len(values) * 2.0**-50 * max(values.max(initial=0), 0), values, 0.0)
    return Basis(n, sums, values, x, float(trace)), listed


def _projection(basis: Basis, components: int):
    """Function from integer vectors to whitened values; NaN where nothing varies."""
    k = min(components, len(basis.values))
    near = np.array([(2 * s + basis.n) // (2 * basis.n) for s in basis.sums], np.int64)
    off = np.array([(s - basis.n * int(m)) / basis.n for s, m in zip(basis.sums, near)])
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(basis.values[:k] > 0, basis.vectors[:, :k] / np.sqrt(basis.values[:k]), np.nan)
    # whole numbers first: nothing is lost before the projection
    return lambda x: ((x - near).astype(float) - off) @ turn


def identity_error(listed: DataFrame, basis: Basis, components: int = COMPONENTS) -> float:
    """Largest entry of the whitened fit list's covariance, measured, minus the identity; over components that vary."""
    if not basis.n:
        return 0.0
    of, k = _projection(basis, components), min(components, len(basis.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for _, x in _pieces(batches, 0):
            z = of(x)
            total += z.sum(axis=0)
            gram += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((total, gram.ravel())).tolist()], pa.list_(pa.float64()))], names=["s"])

    sent = listed.select("x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("at", "s"))
    flat = np.zeros(k + k * k)
    for r in sent.groupBy("at").agg(F.sum("s").alias("s")).collect():
        flat[r["at"]] = r["s"]
    mean, gram = flat[:k] / basis.n, flat[k:].reshape(k, k) / basis.n
    used = np.flatnonzero(basis.values[:k] > 0)
    off = np.abs(gram - np.outer(mean, mean) - np.eye(k))[np.ix_(used, used)]
    return float(off.max(initial=0.0))


def deviations(x: np.ndarray, basis: Basis) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S) ** 2`` in whole numbers; None beyond a long."""
    near = [(2 * s + basis.n) // (2 * basis.n) for s in basis.sums]
    off = np.array([s - basis.n * m for s, m in zip(basis.sums, near)], object)
    y = x - np.array(near, np.int64)
    # sum (n y - off)**2 = n**2 sum y**2 - 2 n sum (y off) + sum off**2
    most = int(np.abs(y).max(initial=0))
    small = y if most * most * y.shape[1] < 1 << 62 else y.astype(object)
    squares = (small * small).sum(axis=1).tolist()
    if most * max(map(abs, off.tolist()), default=0) * y.shape[1] < 1 << 62:
        crossed = (y * off.astype(np.int64)).sum(axis=1).tolist()
    else:
        crossed = (y.astype(object) * off).sum(axis=1).tolist()
    rest = sum(int(o) ** 2 for o in off)
    out = (basis.n * basis.n * int(q) - 2 * basis.n * int(c) + rest for q, c in zip(squares, crossed))
    return [d if d < 1 << 63 else None for d in out]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component, numbered from 1."""
    rows = integers(vectors, id_col, vector_col, scale, shift)
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).limit(1).collect()
    dims = lengths[0].dims if lengths else 1
    rows = rows.where(F.size("x") == dims)
    basis, listed = fit(rows, dims)
    k = min(components, dims)
    error = identity_error(listed, basis, components)
    of = _projection(basis, components) if basis.n else None
    explained = (basis.values[:k] / basis.trace if basis.trace > 0 else np.zeros(k)).tolist()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _pieces(batches, 1):
            z = of(x).ravel()
            whitened = pa.array(z, mask=np.isnan(z))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(z), basis.n, np.int64)),
                 pa.array(deviations(x, basis), pa.int64()).take(each), whitened, pa.array(np.tile(explained, len(x))), pa.array(np.full(len(z), error))], names=names)

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
