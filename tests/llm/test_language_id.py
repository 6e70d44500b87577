from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from airlake.llm import QUERIES
from airlake.llm.language_id import DIMS, UNKNOWN, identify, learn, train, vectors
from airlake.llm.registry import reachable


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_more_families_and_edge_texts(spark):
    reachable(spark)
    say = {"en": "the house and the water of this", "de": "das haus und der fluss ist nicht", "fr": "la maison et les eaux dans une", "es": "la casa y las aguas con ese", "xx": "zq qz zzq qqz xzq"}
    rows = [(f"{t} {i % 7} {t.upper()}", lang, 1.0) for i in range(30) for lang, t in say.items()] + [(None, "en", 0.0), ("???", "pl", 0.0), ("words", None, 0.0)]
    df = spark.createDataFrame(rows, "text string, lang string, score double")
    model = learn(df)
    asked = [(1, None), (2, ""), (3, "12 !? ² ½ Ⅷ"), (4, "UND das ist der fluss " * 20_000), (5, "the water"), (6, "les eaux"), (7, "las aguas y"), (8, "zq zzq"), (9, "é")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [(UNKNOWN, 0.0)] * 3
    assert [got[i][0] for i in (4, 5, 6, 7, 8)] == ["de", "en", "fr", "es", "xx"] and got[9][0] != UNKNOWN


def test_a_language_of_few_heavily_copied_texts(spark):
    reachable(spark)
    say = {"en": "the house and the water of this", "de": "das haus und der fluss ist nicht"}
    rows = [(f"{say['en']} {i} {i * 7}", "en") for i in range(60)] + [(f"{say['de']} nummer {i}", "de") for i in range(3) for _ in range(2000)]
    rows += [(None, "de"), ("123", "de")] * 500
    df = spark.createDataFrame(rows, "text string, lang string")
    asked = spark.createDataFrame([(1, "der fluss und das haus"), (2, "the water and the house")], "doc_id long, text string")
    for seed in range(4):
        got = {r.doc_id: r.lang_pred for r in identify(asked, learn(df, per_lang=5, seed=seed)).collect()}
        assert got == {1: "de", 2: "en"}, seed


def test_nothing_or_one_language_to_learn(spark):
    reachable(spark)
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert identify(df, learn(df)).first().lang_pred == UNKNOWN
    one = spark.createDataFrame([(1, "some text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in identify(one, learn(one)).collect()} == {1: "en", 2: UNKNOWN}
    assert identify(one.where("1 = 0"), learn(one.where("1 = 0"))).count() == 0


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 20)).astype(np.float32)
    y = np.where(x[:, 3] - x[:, 5] > 0, 1, -1)
    w = train(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.98


def test_vectors_depend_on_one_text_only():
    texts = ["The house!", None, "", "den", "the  house", "x" * 50_000]
    whole = vectors(pa.array(texts))
    assert whole.shape == (6, DIMS) and not whole[1].any()
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], vectors(pa.array([t], pa.string()))[0])
