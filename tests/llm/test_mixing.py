from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airlake.llm import QUERIES
from airlake.llm.mixing import WEIGHTS, mark, mix, targets
from tests.conftest import SMALL


def levels(sizes: dict, share: float, most: float) -> dict:
    """Targets by reselling the excess until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        total = sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / total > most * sizes[s]]
        if not over:
            return full | {s: left * w[s] / total for s in rest}
        for s in over:
            full[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 5, rng.randint(1, 1000)]) for i in range(rng.randint(1, 9))} | {None: 40}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in targets(df, 1.5, 2.0).collect()}
    assert got == pytest.approx(levels(sizes, 1.5, 2.0))


def test_query(spark):
    docs = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    run = lambda: sorted(map(tuple, QUERIES["op3_mixing"](spark, SMALL).collect()))
    rows = run()
    assert rows == run() and len(rows) == len(docs)
    by, taken, goal = defaultdict(int), defaultdict(int), {}
    for doc_id, size, source_size, target, words in rows:
        source = docs[doc_id][1]
        assert size == docs[doc_id][0] and 0 <= words <= 2 * size and words % max(size, 1) == 0
        by[source] += size
        taken[source] += words
        goal[source] = (source_size, target)
    assert {s: n for s, (n, _) in goal.items()} == by
    assert {s: t for s, (_, t) in goal.items()} == pytest.approx(levels(by, 1.5, 2.0))
    longest = {s: max(n for n, x in docs.values() if x == s) for s in by}
    assert all(abs(taken[s] - goal[s][1]) <= longest[s] / 2 + 1 for s in by)


def test_many_ranges_agree_with_one(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = {(r.doc_id, r.taken) for r in mix(docs).collect()}
    many = {(r.doc_id, r.taken) for r in mix(docs, rows_per_bucket=100).collect()}
    assert one == many


def expected(rows: list[tuple], weight: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """doc_id -> words taken, in so many words; rows are (doc_id, size, source, mark)."""
    sizes = defaultdict(int)
    for _, n, source, _ in rows:
        sizes[source] += n
    goal, out = levels(dict(sizes), share, most), {}
    for source in sizes:
        whole = int(goal[source] // sizes[source]) if sizes[source] else 0
        rest = goal[source] - whole * sizes[source]
        key = lambda r: -math.log((((r[3] % (1 << 64)) >> 11) + 1) / (1 << 53)) / weight.get(r[0], 1.0)
        line, more, spent = sorted((r for r in rows if r[2] == source), key=lambda r: (key(r), r[0])), set(), 0
        for r in line:
            if spent + r[1] > rest:
                break
            spent += r[1]
            more.add(r[0])
        left = rest - spent
        late = [(abs(r[1] - left), key(r), r[0]) for r in line if r[0] not in more and r[1] and abs(r[1] - left) < left]
        if late:
            more.add(min(late)[2])
        out |= {r[0]: min(whole + (r[0] in more), int(-(-most // 1))) * r[1] for r in line}
    return out


@pytest.mark.parametrize("share", [0.3, 1.5])
def test_order_prefix_and_last_document_against_brute_force(spark, share):
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "a", "a", "b", "c"])) for i in range(900)]
    # weights over sixteen powers of ten: none is cut off
    weight = {i: 10.0 ** rng.randint(-8, 8) for i in range(0, 900, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    weights = spark.createDataFrame(list(weight.items()), "w_id long, weight double")
    marks = [tuple(r) for r in docs.select("doc_id", F.size(F.split(F.trim("text"), " ")).alias("n"), "source", mark().alias("m")).collect()]
    size = {i: t.count("w") for i, t, _ in rows}
    want = expected([(i, size[i], s, m) for i, _, s, m in marks], weight, share)
    for rows_per_bucket in (50_000, 40, 7):
        got = {r.doc_id: r.taken for r in mix(docs, share=share, weights=weights, rows_per_bucket=rows_per_bucket).collect()}
        assert got == want, rows_per_bucket


def test_ranges_are_even_under_any_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 9, "a") for i in range(4000)], "doc_id long, text string, source string")
    weights = docs.select(F.col("doc_id").alias("w_id"), F.pow(F.lit(10.0), F.col("doc_id") % 12 - 6).alias("weight"))
    a = {r.doc_id: r.taken for r in mix(docs, share=0.5, weights=weights, rows_per_bucket=10).collect()}
    b = {r.doc_id: r.taken for r in mix(docs, share=0.5, weights=weights).collect()}
    assert a == b and sum(a.values()) == 18_000
    heavy = [i for i, n in a.items() if n and i % 12 >= 6]
    assert len(heavy) > 0.9 * sum(n > 0 for n in a.values())


def test_heavier_documents_lead(spark):
    docs = spark.createDataFrame([(i, "w", "a") for i in range(2000)] + [(i, "w " * 50, "b") for i in range(2000, 4000)], "doc_id long, text string, source string")
    got = mix(docs, share=0.2, weights=docs.select(F.col("doc_id").alias("w_id"), F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))).where("taken > 0 and source = 'b'").collect()
    even = sum(r.doc_id % 2 == 0 for r in got)
    assert even > 2.5 * (len(got) - even)


def test_edge_rows(spark):
    rows = [(1, None, "a", 3), (2, "", "a", 1), (3, "x y", None, 1), (3, "x y", None, 1), (None, "z", "a", 2), (5, "q " * 100_000, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs).collect()
    assert len(got) == 6 and {r.size for r in got if r.doc_id in (1, 2)} == {0}
    assert sum(r.taken for r in got if r.source is None) in (6, 8) and {r.source_size for r in got} == {4, 100_001}
    assert mix(docs.where("doc_id = 1")).first().target == 0
    assert mix(docs.where("1 = 0")).count() == 0
