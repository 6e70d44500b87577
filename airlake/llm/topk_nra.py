"""Exact top-k inner products by threshold aggregation without random access.

Vectors are integers, ``floor(1024 * x)`` of every component.  Candidates are dealt into blocks; in a block
every component is a list sorted by value.  A query reads its lists in step from the end that serves the sign
of its component, and keeps for every candidate a lower bound (what is read, and the least that the lists can
still hold) and an upper bound (what is read, and the values where its unread lists stand).  Reading stops when no
candidate outside the k best lower bounds has an upper bound that reaches the k-th; the survivors' scores are then
resolved exactly.  Blocks return k rows per query, and a second ranking joins them.

Queries are dealt into blocks too, so each task holds one block of either side, whatever their numbers.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; queries meet only
candidates with the same number of components (empty vectors meet empty ones, with score 0); all rows with the query's own id are left out; repeated rows of a candidate
appear as often as they are there; ties go to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.llm.common import table
from airlake.llm.registry import query

SCALE = 1024
#: Shares of a list that are read before the bounds are looked at.
DEPTHS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)


class Block:
    """A block of candidates as sorted lists, one per component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        first = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[first], vectors[first]  # place order is id order: ties resolve themselves
        self.order = np.argsort(self.x, axis=0, kind="stable").T.copy()  # per list, places by ascending value
        self.sorted = np.take_along_axis(self.x, self.order.T, axis=0).T.copy()

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, best first."""
        n, dims = self.x.shape
        skip = (np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right"))
        want = k + skip[1] - skip[0]
        used = np.flatnonzero(q)
        if n > want and used.size:
            alive = self._read(q, used, want)
        else:
            alive = np.arange(n)
        alive = alive[(alive < skip[0]) | (alive >= skip[1])]
        score = self.x[alive] @ q
        best = np.lexsort((alive, -score))[:k]
        return self.ids[alive[best]], score[best]

    def _read(self, q: np.ndarray, used: np.ndarray, want: int) -> np.ndarray:
        """Places that can still be among the ``want`` best when reading stops."""
        n = len(self.ids)
        # seen from its better end, list d goes down from best[d] to worst[d]
        rows = [(self.order[d], self.sorted[d]) if q[d] < 0 else (self.order[d][::-1], self.sorted[d][::-1]) for d in used]
        worst = np.array([q[d] * s[-1] for d, (_, s) in zip(used, rows)], dtype=np.int64)
        low = np.full(n, worst.sum(), np.int64)  # nothing read: every list may hold its least
        # what the upper bound of an unread list adds over its least, taken off once it is read
        unread = np.zeros(n, np.int64)
        done = 0
        for depth in DEPTHS:
            upto = max(done, min(n, int(np.ceil(n * depth))))
            front = np.array([q[d] * s[upto - 1] for d, (_, s) in zip(used, rows)], dtype=np.int64) - worst
            for (places, values), d, least in zip(rows, used, worst):
                low[places[done:upto]] += q[d] * values[done:upto] - least
            done = upto
            kth = np.partition(low, n - want)[n - want]
            if upto == n:
                return np.flatnonzero(low >= kth)
            unread[:] = front.sum()
            for (places, _), gap in zip(rows, front):
                unread[places[:upto]] -= gap
            alive = np.flatnonzero(low + unread >= kth)
            if alive.size <= max(4 * want, n // 64):
                return alive
        return np.arange(n)


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"),
                                 F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = 8192, query_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row with ``is_query``, against all rows."""
    rows = quantised(vectors.select(F.col(id_col), F.col(vector_col), is_query.alias("is_query")), id_col, vector_col)
    asked = quantised(vectors.where(is_query), id_col, vector_col)
    n, m = rows.count(), asked.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))

    def search(key: tuple, some: pa.Table, block: pa.Table) -> pa.Table:
        if not some.num_rows or not block.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        dims = key[2].as_py()
        x = _matrix(block, dims)
        held = Block(np.asarray(block["vec_id"].combine_chunks()), x)
        found = []
        for own, q in zip(some["vec_id"].to_pylist(), _matrix(some, dims)):
            ids, score = held.top(q, own, k)
            found.append((np.full(len(ids), own), ids, score))
        return pa.table({c: pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    # a stated query set against all rows, in blocks: every pair of blocks meets in one task
    dealt_rows = rows.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                             F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    dealt_asked = asked.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"),
                               F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    near = dealt_asked.groupBy("part", "block", "dims").cogroup(dealt_rows.groupBy("part", "block", "dims")).applyInArrow(
        search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _matrix(rows: pa.Table, dims: int) -> np.ndarray:
    flat = rows["v"].combine_chunks()
    return np.asarray(flat.flatten()).astype(np.int64).reshape(len(flat), dims)


@query("op7_topk_nra", """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank", vec_id, score
  from pairs)
select query_id, "rank", vec_id, score from ranked where "rank" <= 10
""")
def op7_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector, against all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
