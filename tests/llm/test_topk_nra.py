from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.llm import ORACLES, QUERIES
from airlake.llm.registry import reachable
from airlake.llm.topk_nra import Block, top_k
from tests.compare import differences
from tests.conftest import SMALL


def test_query_matches_sql(spark, duck):
    df = QUERIES["op7_topk_nra"](spark, SMALL)
    assert differences(df, df.collect(), duck.execute(ORACLES["op7_topk_nra"])) == []


@pytest.mark.parametrize("seed", range(6))
def test_block_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, dims, k = int(rng.integers(1, 3000)), int(rng.integers(1, 12)), int(rng.integers(1, 15))
    x = rng.integers(-3, 4, (n, dims)) if seed % 2 else (rng.normal(size=(n, dims)) * rng.exponential(300, (n, 1))).astype(int)
    ids = rng.permutation(n * 2)[:n] // (1 + seed % 2)
    block = Block(ids, x.astype(np.int64))
    for q in x[:20]:
        own = int(ids[0])
        want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, x) if i != own)[:k]
        got = block.top(q.astype(np.int64), own, k)
        assert [(-int(s), int(i)) for i, s in zip(*got)] == want


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    x = rng.integers(-5, 6, (4000, 6)).astype(np.int64)
    x[:20] *= 1000
    alive = Block(np.arange(4000), x)._read(x[0], np.flatnonzero(x[0]), 11)
    assert alive.size < 400


def test_edge_rows_and_blocks(spark):
    reachable(spark)
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0], 1), (100, [0.5, None], 1), (200, None, 1), (300, [nan, 1.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], 2), (2, [1.0, 0.0], 2),
            (3, [inf, 0.0], 0), (4, [-1.0, 0.001], 0), (None, [9.0, 9.0], 0), (5, [2.0], 0), (6, [], 0), (400, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    want = [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 20), (0, 3, 2, 1 << 20), (0, 4, 4, -(1 << 20)), (400, 1, 6, 0)]
    for block_rows in (2, 8192):
        got = top_k(df, F.col("vec_id") % 100 == 0, 10, block_rows=block_rows, query_rows=1)
        assert sorted(map(tuple, got.collect())) == want
    assert top_k(df.where("1 = 0"), F.col("vec_id") % 100 == 0).count() == 0
