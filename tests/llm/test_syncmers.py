from __future__ import annotations

import hashlib
import random
import statistics

from pyspark.sql import functions as F

from airlake.llm import QUERIES
from airlake.llm.syncmers import K, S, SIZE, to_text, with_fingerprint, with_likeness
from tests.conftest import SMALL


def test_query(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    rows = {r.doc_id: r for r in QUERIES["op8_syncmers"](spark, SMALL).collect()}
    assert len(rows) == len(docs)
    by_text: dict = {}
    for i, (doc, text) in enumerate(docs):
        half, after = len(text) // 2, docs[(i + 1) % len(docs)][1]
        edited = text[:len(text) - half] + after[:half]
        r = rows[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in rows.values() if r.n_chars > 500]
    assert statistics.mean(r.near_edited for r in long) > 0.4 and statistics.mean(r.near_next for r in long) < 0.05


def hashes(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return [r.h for r in df.select(F.xxhash64("w").alias("h")).collect()]


def test_anchors_against_brute_force(spark):
    """Anchors of one text, found by the definition on hashes that Spark gives."""
    rng = random.Random(1)
    words = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(80)]
    text = " ".join(words)
    got = with_fingerprint(spark.createDataFrame([(text,)], "t string"), "t", "f").select(to_text("f").alias("f")).first().f
    h = hashes(spark, words)
    pair = spark.createDataFrame([(h[i], h[i + 1] if i + 1 < len(h) else None, *[h[i + j] if i + j < len(h) else None for j in range(2, K)]) for i in range(len(h))],
                                 ", ".join(f"c{j} long" for j in range(K)))
    rows = pair.select(F.xxhash64("c0", "c1").alias("s"), F.xxhash64(*[f"c{j}" for j in range(K)]).alias("k")).collect()
    inner = [r.s for r in rows]
    want = {}
    for i in range(len(words) - K + 1):
        some = inner[i:i + K - S + 1]
        if min(some) in (some[0], some[-1]):
            want.setdefault((rows[i].k % (1 << 64)) >> 25, i)
    assert got == ",".join(f"{x:x}:{p}" for x, p in sorted(want.items())[:SIZE])


def test_edge_texts(spark):
    texts = [(1, None), (2, ""), (3, "one two"), (4, "One, two!"), (5, "?!"), (6, "?!?"), (7, "word " * 50_000), (8, "a b c d e f g h"), (8, "a b c d e f g h")]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, key int").withColumn("t", F.coalesce("text", F.lit("")))
    rows = {r.doc_id: r.f for r in with_fingerprint(df, "t", "f").collect()}
    assert rows[1] == rows[2] == [] and len(rows[3]) == 1 and rows[3] == rows[4] and rows[5] != rows[6] and len(rows[7]) == 1
    both = with_fingerprint(df, "t", "f").withColumn("g", F.lit(None).cast("array<long>"))
    near = {r.doc_id: r.near for r in with_likeness(both.withColumn("g", F.col("f")), "f", "g", "near").collect()}
    assert set(near.values()) == {1.0}


def test_scripts_without_spaces_and_endless_runs_have_anchors(spark):
    rng = random.Random(6)
    han, thai = ("".join(chr(rng.randrange(a, b)) for _ in range(400)) for a, b in ((0x4E00, 0x9FA0), (0xE01, 0xE2F)))
    run = "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(20_000))
    texts = [han, thai, run, "plain words " * 3]
    rows = [(i, t, t[:len(t) // 2] + "".join(rng.choice(t) for _ in range(len(t) // 2))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edited string")
    both = with_fingerprint(with_fingerprint(df, "text", "f"), "edited", "g")
    near = {r.doc_id: (len(r.f), r.near) for r in with_likeness(both, "f", "g", "near").collect()}
    assert all(near[i][0] == SIZE for i in (0, 1, 2)) and all(0.25 < near[i][1] < 0.9 for i in (0, 1, 2))


def test_all_anchors_on_request(spark):
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") + str(rng.randrange(999)) for _ in range(3000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:2000] + words[:1] * 1000))], "a string, b string")
    whole = with_fingerprint(with_fingerprint(df, "a", "f", None), "b", "g", None)
    r = with_likeness(whole, "f", "g", "near", None).first()
    some = with_fingerprint(df, "a", "f").first().f
    assert len(r.f) > 900 and r.f[:SIZE] == some
    # the share of anchors in common, by the definition and without the error of 64 of them
    f, g = ({x >> 24 for x in s} for s in (r.f, r.g))
    share = len(f & g) / len(f | g)
    assert abs(r.near - 2 * share / (1 + share)) < 1e-9 and 0.7 < r.near < 0.9


def test_next_document_wraps_over_odd_ids(spark, tmp_path):
    rows = [(None, "null id"), (5, "five"), (5, "fife"), (-3, "minus"), (10**12, "last"), (7, None), (6, "x" * 100_000)]
    spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.n_chars, r.edited_sha256) for r in QUERIES["op8_syncmers"](spark, str(tmp_path)).collect()))
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    texts = [t for _, _, t in order]
    want = sorted((len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][:len(t) // 2]).encode()).hexdigest()) for k, t in enumerate(texts))
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op8_syncmers"](spark, str(tmp_path)).count() == 0
