from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.llm import QUERIES
from airlake.llm.registry import reachable
from airlake.llm.whitening import Basis, Wide, covariance, deviations, eigenvectors, integers, products, refine, whiten
from tests.conftest import SMALL


def plain_integers(v):
    return None if v is None or not v or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(64 * c) + 1_000_000 for c in v)


def exact_covariance(rows: list[tuple]) -> tuple[int, list[int], list[list[Fraction]]]:
    fit = sorted(set(rows))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[c - Fraction(s, n) for c, s in zip(r, sums)] for r in fit]
    return n, sums, [[sum(a[i] * a[j] for a in centred) / n for j in range(len(sums))] for i in range(len(sums))]


def residual(a: np.ndarray, values: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """(relative error of A X = X L, error of orthogonality), judged in extended precision."""
    a, x, v = a.astype(Wide), x.astype(Wide), values.astype(Wide)
    return float(np.abs(a @ x - x * v).max() / np.abs(a).max()), float(np.abs(x.T @ x - np.eye(len(a))).max())


def matrix(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    q = q.astype(Wide)
    for _ in range(3):  # orthogonal beyond doubles
        q = q @ (1.5 * np.eye(len(q), dtype=Wide) - 0.5 * (q.T @ q))
    a = (q * np.array(values, Wide)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    list(range(64, 0, -1)), [10.0] * 3 + [1.0] * 5, [10 + 1e-9 * i for i in range(6)] + [3.0, 3 + 1e-12, 1e-7], [1e12, 1e6, 1.0, 1e-3], [5.0], [2.0, 0.0, 0.0], [1 + 2.0**-24 * i for i in range(40)],
])
def test_eigenvectors_to_double_precision(values):
    a = matrix(sorted(values, reverse=True), len(values))
    got, x = eigenvectors(a)
    assert np.all(np.diff(got) <= 0)
    assert np.abs(got - np.array(sorted(values, reverse=True))).max() <= 2e-15 * len(values) * max(values)
    off, lengths = residual(a, got, x)
    assert off < 1e-15 * len(values) + 4e-16 and lengths < 2e-15


def test_clustered_vectors_are_the_right_ones():
    # eigenvalues that float32 can't tell apart have vectors of their own, to the precision that their distance allows
    values = [4.0, 4 - 1e-8, 4 - 2e-8, 1.0]
    a = matrix(values, 5)
    _, x = eigenvectors(a)
    for k, v in enumerate(values):
        assert np.linalg.norm((a @ x[:, k] - Wide(v) * x[:, k]).astype(float)) < 1e-15
    start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(Wide)
    assert max(np.linalg.norm((a @ start[:, k] - Wide(v) * start[:, k]).astype(float)) for k, v in enumerate(values)) > 1e-9


def test_the_step_converges_quadratically():
    a = matrix([9.0, 5.0, 2.0, 1.0, 0.25], 2)
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(Wide)
    sizes = []
    for _ in range(3):
        _, x, size = refine(a, x)
        sizes.append(size)
    assert sizes[0] > 1e-9 and sizes[1] < sizes[0] ** 2 * 100 + 1e-18


def test_products_are_exact_for_any_size():
    for most in (5, 1 << 20, 1 << 40, 1 << 52):
        y = np.random.default_rng(most % 97).integers(-most, most, (50, 3))
        assert products(y).tolist() == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]


@pytest.mark.parametrize("size", [3.0, 4e4, 1e9])
def test_covariance_is_exact(spark, size):
    reachable(spark)
    rng = np.random.default_rng(1)
    raw = (rng.normal(size=(300, 4)) * size + 17).tolist()
    raw += raw[:50] * 3
    df = integers(spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "vec_id long, embedding array<double>"))
    rows = [plain_integers(v) for v in raw]
    assert sorted(map(tuple, (r.x for r in df.collect()))) == sorted(rows)
    n, sums, scaled = covariance(df.select("x").distinct(), 4)
    want = exact_covariance(rows)
    assert (n, sums) == want[:2] and [[Fraction(int(c), n * n) for c in r] for r in scaled] == want[2]
    basis = Basis(n, sums, np.ones(4), np.eye(4), 4.0)
    some = sorted(set(rows))
    whole = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in some]
    assert deviations(np.array(some), basis) == [d if d < 1 << 63 else None for d in whole]


def test_query_against_brute_force(spark):
    got = QUERIES["op11_whitening"](spark, SMALL).collect()
    raw = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = {i: plain_integers(v) for i, v in raw}
    n, sums, cov = exact_covariance(list(rows.values()))
    a = np.array([[float(c) for c in r] for r in cov])
    values, vectors = np.linalg.eigh(a)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 16 * len(raw) and {r.n for r in got} == {n} and all(r.identity_error < 1e-10 for r in got)
    mean = [Fraction(s, n) for s in sums]
    z = {}
    for r in got:
        z.setdefault(r.vec_id, np.zeros(16))[r.component - 1] = r.whitened
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(rows[r.vec_id], sums))
        assert abs(r.explained - values[r.component - 1] / np.trace(a)) < 1e-12
    centred = np.array([[float(c - m) for c, m in zip(rows[i], mean)] for i in z])
    whole = np.array(list(z.values()))
    plain = centred @ vectors[:, :16] / np.sqrt(values[:16])
    sign = np.sign((whole * plain).sum(axis=0))
    assert np.abs(whole - plain * sign).max() < 1e-9


def test_edge_rows(spark):
    reachable(spark)
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [0.5, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (8, [1.0]),
            (9, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, x int, n int, component int")
    got = whiten(df).collect()
    # three distinct vectors of two entries; the second never varies
    assert len(got) == 8 and {r.n for r in got} == {3} and {r.vec_id for r in got} == {1, 2, None}
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert [r.explained for r in got[:2]] == [1.0, 0.0] and got[0].identity_error < 1e-12
    assert {round(r.whitened, 9) for r in got if r.component == 1} == {round(s * math.sqrt(1.5), 9) for s in (1, 0, -1)}
    one = whiten(df.where("vec_id = 2")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 2
    assert whiten(df.where("1 = 0")).count() == 0 and whiten(df.where("vec_id = 3")).count() == 0


def test_copies_and_layout_change_nothing(spark):
    reachable(spark)
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    copied = df.unionByName(df.limit(1).select((F.col("vec_id") + 100_000).alias("vec_id"), "embedding", "label").crossJoin(spark.range(500).select(F.col("id").alias("more"))).drop("more"))
    a = {(r.vec_id, r.component): (r.n, r.deviation, round(r.whitened, 9)) for r in whiten(df).collect()}
    b = {(r.vec_id, r.component): (r.n, r.deviation, round(r.whitened, 9)) for r in whiten(copied.repartition(5)).collect() if r.vec_id < 100_000}
    assert a == b
