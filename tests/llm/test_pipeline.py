from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
import corpus_pipeline as pipeline
from airlake.llm import secrets
from airlake.llm.common import DOC_COLUMNS
from airlake.llm.registry import reachable
from tests.conftest import SMALL
from tests.llm.test_mixing import levels
from tests.llm.test_ngram_jaccard import brute

KIND = "doc_id long, text string, lang string, source string, n_chars long, node int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    reachable(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    reachable(spark)
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, 0.5) for r in docs.limit(40).collect()]
    text = base[0][1]
    more = [(900, None, "en", "src0", 0, 1, 0.5), (901, "", None, None, 0, 1, 0.5), (902, "123 456 !!", "en", "src1", 9, 1, 0.5), (None, text, None, None, None, 1, 0.5),
            (903, text, "fr", "src2", None, 1, 0.5), (903, text, "fr", "src2", None, 1, 0.5), (None, "a lone text of the corpus with no id", "en", "src3", 5, 1, 0.5),
            (904, "password = hunter2hunter2 " + "word " * 40_000, "en", None, None, 1, 0.5)]
    return spark.createDataFrame(base + more, KIND)


def rows(df):
    assert df.columns == DOC_COLUMNS
    return [tuple(r) for r in df.collect()]


def test_language_stage(spark, docs, odd):
    assert len(rows(pipeline.language_stage(spark, docs, SMALL))) == docs.count()
    kept = rows(pipeline.language_stage(spark, odd, SMALL))
    assert {900, 901, 902}.isdisjoint(r[0] for r in kept) and len(kept) == odd.count() - 3


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicate_stage(spark, which, request):
    df = request.getfixturevalue(which)
    given = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(given, 5, 80)
    kept = rows(pipeline.near_duplicate_stage(spark, df, SMALL))
    solid = {c for d, n, c in want if n and c is not None}
    assert Counter(r[0] for r in kept if r[0] is not None and re.search(r"[^\x20\x09-\x0D]", r[1] or "")) == Counter(solid)
    assert sum(not (r[1] or "").split() for r in kept) == sum(not (t or "").split() for _, t in given)
    assert sum(r[0] is None for r in kept) == (1 if which == "odd" else 0)


def test_secrets_stage(spark, odd):
    kept = {(r[0], r[1]): r for r in rows(pipeline.secrets_stage(spark, odd, SMALL))}
    given = odd.collect()
    assert len(kept) == len({(r.doc_id, r.text) for r in given})
    hidden = [r for r in kept.values() if secrets.MARK in (r[1] or "")]
    assert hidden and all(r[4] == len(r[1]) for r in hidden) and not any(secrets.pattern_spans(r[1] or "") for r in kept.values())
    plain = [r for r in given if not secrets.pattern_spans(r.text or "")]
    assert all(kept[r.doc_id, r.text][1:] == (r.text, r.lang, r.source, r.n_chars) for r in plain)


def test_mixing_stage(spark, odd):
    taken = Counter(rows(pipeline.mixing_stage(spark, odd, SMALL)))
    given = Counter(tuple(r)[:5] for r in odd.collect())
    assert set(taken) <= set(given) and all(n <= 2 * given[r] for r, n in taken.items())
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    by, got = Counter(), Counter()
    for r, n in given.items():
        by[r[3]] += n * size(r)
        got[r[3]] += taken[r] * size(r)
    goal = levels(dict(by), 1.5, 2.0)
    longest = {s: max(size(r) for r in given if r[3] == s) for s in by}
    assert all(abs(got[s] - goal[s]) <= longest[s] for s in by)


def test_token_stage(spark, odd):
    out = pipeline.token_stage(spark, odd, SMALL).collect()
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert Counter((r.doc_id, r.text_sha256) for r in out) == want and all(len(r.ids) == r.n_pieces for r in out)


def test_empty_documents(spark, odd):
    empty = odd.where("1 = 0")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_run_is_registered_and_whole(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "sentencepiece"]
    df = entry_mod.queries()["pipeline"](spark, SMALL)
    assert df.where(F.col("n_pieces") > 0).count() == df.count() > 100
