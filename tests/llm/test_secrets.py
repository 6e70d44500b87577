from __future__ import annotations

import base64
import hashlib
import random
import re

import pytest

from airlake.llm import QUERIES
from airlake.llm.registry import reachable
from airlake.llm.secrets import _NAMED, ENCODINGS, KINDS, MARK, _class, calibrate, candidates, classes, encoding, pattern_spans, randomness, scan
from airlake.llm.spans import apart, joined, replaced
from tests.conftest import SMALL

_PLAIN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    out = [(m.start(), m.end(), "assign") for m in _PLAIN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def test_patterns_against_the_plain_expressions():
    rng = random.Random(1)
    parts = ["password", "PassWd", "Secret", "ToKen", "api_key", "APIKEY", "ſecret", '"', "'", " ", ":", "=", "abcdefgh", "12345", "AKIA", "AKIAABCDEFGH1234", "é", "f" * 31, "0"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert sorted(pattern_spans(text)) == sorted(plain(text)), text


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op5_secrets"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        text = joined(base, KINDS)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[2] == k for b in base) for k in KINDS[:3])
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_battery_tells_random_from_written():
    rng = random.Random(2)
    keys = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(300)]
    p = sorted(randomness(k, _NAMED.index("base64")) for k in keys)
    assert p[15] > 0.01 and 0.3 < p[150] < 0.8
    assert encoding("abcdefabcdef0123456789") == 0 and encoding("12345678901234567890") is None and encoding("ABC+/abc09" * 3 + "==") == _NAMED.index("base64")
    for odd in ("ABAB" * 10, "A" * 40, "thequickbrownfoxjumpsoverthelazydogandmore"):
        assert randomness(odd, _NAMED.index("base64")) < 1e-2


def test_unnamed_keys_are_found_and_writing_stays(spark):
    reachable(spark)
    rng = random.Random(4)
    words = "the quick brown fox jumps over a lazy dog near some river bank while children play in autumn light".split()
    keys = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(400)]
    texts += [f"{' '.join(rng.choice(words) for _ in range(200))} {k} end" for k in keys]
    texts += ["thequickbrownfoxjumpsoverthelazydog-and-more-of-it " * 3, None, "", "password: hunter2hunter2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df, calibrate(df)).collect()}
    found = [i for i, r in got.items() if "random" in r.spans]
    assert len(found) >= 36 and set(found) <= set(range(400, 440))
    assert all(keys[i - 400] not in got[i].redacted and MARK in got[i].redacted for i in found)
    assert got[441].spans == got[442].spans == "" and got[443].redacted == MARK


def test_many_pieces_as_one_by_one():
    rng = random.Random(5)
    for kind, alphabet in enumerate(ENCODINGS.values()):
        for n in (20, 48, 96):
            some = ["".join(rng.choice(alphabet[:rng.choice([1, 2, 9, 64])]) for _ in range(n)) for _ in range(60)]
            assert classes("".join(some).encode(), n, kind).tolist() == [_class(randomness(b, kind)) for b in some]


@pytest.mark.parametrize("name", list(ENCODINGS))
def test_long_secrets_of_every_encoding_in_a_clean_corpus(spark, name):
    """Ordinary writing, few capitals: each alphabet has decoys or its stated stand-in."""
    reachable(spark)
    rng = random.Random(7)
    # no pangram, whose letters look drawn
    words = "the nation states that this interest in the estate is not a matter of the senate and the treaties are there to rest".split()
    texts = [" ".join(rng.choice(words) for _ in range(60)).capitalize() + f" {rng.randrange(1000)}." for _ in range(150)]
    keys = ["".join(rng.choice(ENCODINGS[name]) for _ in range(64)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate([*texts, *(f"{t} {k} end" for t, k in zip(texts, keys))])), "doc_id long, text string").coalesce(1)
    found = [r.doc_id for r in scan(df, calibrate(df)).collect() if r.spans]
    assert len(found) >= 12 and min(found) >= 150


_KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"


@pytest.mark.parametrize("before, key, after", [
    ("AWS_SESSION=", _KEY, ""), ("https://a.b/c?sig=", _KEY, "&x=1"), ("NAME=", _KEY + "==", " end"), ("a=b=", _KEY, "=c"), ("密钥是", _KEY, "请保密"), ("é", _KEY, "é"),
    ("prefix-with-hyphen-", "AbC+" + _KEY + "/x==", " end"), ("a/b+c/", "Ab-_" + _KEY, "")])
def test_whole_frequent_forms_are_judged(before, key, after):
    text = before + key + after
    assert (len(before), len(before) + len(key)) in [c[:2] for c in candidates(text)]


def test_keys_behind_names_are_told(spark):
    reachable(spark)
    rng = random.Random(12)
    words = "the quick brown fox jumps over a lazy dog near some river bank while children play in autumn light".split()
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(300)]
    keys = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(60)]
    forms = ["AWS_SESSION={}", "密钥是{}请保密", "my-prefix-with-hyphens-{}"]
    texts += [f"{texts[i]} {forms[i % 3].format(k)} end" for i, k in enumerate(keys)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in scan(df, calibrate(df)).collect()}
    assert all(sum(bool(got[300 + i]) for i in range(f, 60, 3)) >= 15 for f in range(3)) and not any(got[i] for i in range(300))


def test_span_helpers():
    assert apart([(0, 3, "r"), (4, 6, "r"), (9, 12, "r")], [(0, 5, "a"), (1, 2, "a"), (12, 13, "a")]) == [(9, 12, "r")]
    assert replaced("0123456789", [(1, 3, "a"), (2, 5, "a"), (8, 9, "a")], {"a": "_"}) == "0_567_9"


def test_empty_table(spark):
    reachable(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scan(df, calibrate(df)).count() == 0


@pytest.mark.parametrize("text", ["token" + " " * 200_000, "0" * 31 + "g" * 100_000, "A" * 300_000])
def test_long_texts(text):
    assert pattern_spans(text) == []
