from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from airlake.llm import ORACLES, QUERIES
from airlake.llm.importance import bucket_counts, collapsed, pattern, resample, spans
from airlake.llm.registry import reachable
from tests.compare import differences
from tests.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text: str | None, longest: int = 2) -> list[str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def expected(docs: list[tuple], target: list[str | None], least: int = 20, percent: int = 25) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    found = [[bucket(f) for f in plain(t)] for _, t in docs]
    s, t = Counter(b for f in found for b in f), Counter(bucket(f) for x in target for f in plain(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for (i, text), f in zip(docs, found):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if (r[1] + 1) // 2 >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r) for r in rows), key=lambda r: r[:4])


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("text", [None, "", " ", "a", "A b", "The  big-Cat, é1 x.\n\tÉ x\x7f y\x00z 9", "x" * 5000 + " y", "İ ſ K ß 中文 中", "-- a --"])
def test_spans_are_all_runs_of_words(text, longest):
    form = collapsed(text)
    got = [form[a:b].decode() for a, b in spans(form, pattern(longest))]
    assert sorted(got) == sorted(plain(text, longest))
    n, held, often = bucket_counts(text, pattern(longest), 10_000)
    assert n == len(got) == often.sum() and list(held) == sorted({zlib.crc32(f.encode()) % 10_000 for f in got})


def test_query_matches_sql(spark, duck):
    df = QUERIES["op13_importance"](spark, SMALL)
    assert differences(df, df.collect(), duck.execute(ORACLES["op13_importance"])) == []


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    got = sorted(map(tuple, QUERIES["op13_importance"](spark, SMALL).collect()), key=lambda r: r[:4])
    assert got == expected(docs, target) and sum(r[4] is not None for r in got) > 20


def test_the_target_is_drawn_towards(spark):
    reachable(spark)
    docs = [(i, " ".join(("north wind sea salt" if i % 4 == 0 else "ledger audit tax note").split() * 8) + f" {i}") for i in range(400)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("the north wind and the salt sea wind " * 100,)], "text string")).where("rank is not null").collect()
    assert len(got) == 100 and sum(r.doc_id % 4 == 0 for r in got) > 60


def test_edge_rows(spark):
    reachable(spark)
    words = " ".join(f"w{k}" for k in range(25))
    docs = [(1, words), (1, words), (2, None), (3, ""), (None, words), (None, words), (None, None), (4, words + " w1"), (5, "x" * 200_000 + " y"), (6, "…")]
    df = spark.createDataFrame([(*d, "clash", 1, 2, 3) for d in docs], "doc_id long, text string, id string, score int, rank int, held int")
    rows = resample(df, spark.createDataFrame([(None,), ("w1 w2",)], "text string"), percent=100).collect()
    assert len(rows) == 10 and sorted(r.rank for r in rows if r.rank) == [1, 2, 3, 4, 5]
    for r in rows:
        assert (r.rank is None) == (r.n_words < 20) and r.n_words == (r.n_features + 1) // 2
    known = [(i, t) for i, t in docs if i is not None]
    assert sorted((r.doc_id, r.n_features) for r in rows if r.doc_id is not None) == sorted((i, len(plain(t))) for i, t in known)
    assert len({r.score for r in rows if r.doc_id is None and r.n_words}) == 1
    empty = df.where("1 = 0")
    assert resample(empty, df.select("text")).count() == 0
    # without a target a feature that occurs once among the texts loses: ln(10001 / 20000)
    assert resample(df.where("doc_id = 6"), empty.select(F.col("text"))).collect()[0].weight == -694


def test_any_layout_gives_the_same_rows(spark):
    reachable(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert sorted(map(str, resample(docs.repartition(7), target).collect())) == sorted(map(str, resample(docs.coalesce(1), target).collect()))
