from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from airlake.llm import QUERIES
from airlake.llm.common import utf8
from airlake.llm.ngram_jaccard import components, near_duplicates, node_ids, signatures
from airlake.llm.registry import reachable
from airlake.llm.shingles import shingle_sets
from tests.conftest import SMALL


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    parent, common, holders = list(range(len(rows))), Counter(), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for at in holders.values():
        common.update((a, b) for n, b in enumerate(at) for a in at[:n])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            parent[find(parent, b)] = find(parent, a)
    least = {}
    for i, (doc, _) in enumerate(rows):
        root = find(parent, i)
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    return sorted(((doc, len(s), least.get(find(parent, i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def told(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert told(QUERIES["op6_ngram_jaccard"](spark, sf)) == brute(rows, 4, 85)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return words


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_chains_of_copies_and_shared_passages(spark, seed, k, percent):
    """Drifting near copies, copies at the threshold, short texts, and passages in otherwise different texts."""
    reachable(spark)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows, i = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([3, 7, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 3, 12])):
            rows.append((i, " ".join(words).replace("w", rng.choice("wW"))))
            i += 1
            words = edited(rng, words, rng.choice([0, 1, 1, 2, 5]))
    for n in (6, 12, 30, 200):
        for _ in range(10):
            rows.append((i, " ".join(passage + [f"u{rng.randrange(10 ** 6)}" for _ in range(n)])))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "One two"), (i + 4, "one\ttwo"), (None, "one two"), (None, "alone"), (0, "again x y z"), (0, "again x y z")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, node int")
    assert told(near_duplicates(df, k, percent)) == brute(rows, k, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(150):
        a = rng.integers(0, 2**63, int(rng.integers(1, 120))).astype(np.uint64)
        b = np.concatenate((a[int(rng.integers(0, len(a))) // 5:], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 6))).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            row, sig = signatures(np.array([len(a), len(b)]), np.concatenate((a, b)), percent)
            assert np.intersect1d(sig[row == 0], sig[row == 1]).size


def test_sets_of_a_batch():
    texts = ["a b c d e", "A  b\nc d\x0bE", "a b c", None, " ", "a", "x" * 5000 + " y", "a b c d e a b c d e", "aé b c d"]
    size, sets = shingle_sets(*utf8(pa.array(texts).slice(0)), 4)
    assert size.tolist() == [len(grams(t, 4)) for t in texts]
    node = node_ids(size, sets).tolist()
    assert node[0] == node[1] and len(set(node)) == len(texts) - 2
    assert shingle_sets(*utf8(pa.array(["q"] + texts).slice(1)), 4)[1].tolist() == sets.tolist()


def test_components(spark):
    reachable(spark)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 150)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 100}


def test_empty_table(spark):
    reachable(spark)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
