from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from airlake.llm import QUERIES
from airlake.llm.pii import BASE, KINDS, contexts, document_counts, emails, entity, luhn, pattern_spans, sanitise, terms
from airlake.llm.registry import reachable
from airlake.llm.spans import joined
from tests.conftest import SMALL


def plain(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def test_patterns_against_the_plain_expressions():
    rng = random.Random(1)
    parts = ["a", "@", ".", "-", "1", "23", "456", "0", "+", " ", "(", ")", "x@y.zz", "4111 1111 1111 1111", "1.2.3.4", "+49 (30) 1234-567", "é", "%"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert sorted(pattern_spans(text)) == sorted(plain(text)), text


def test_long_words_cost_their_length():
    assert list(emails("a" * 400_000 + "@" * 5 + "b@c.de")) == [(400_005, 400_011)]
    assert pattern_spans("1" * 300_000 + "." * 9) == []


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op2_pii"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        text = joined(base, KINDS)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(b[2] == k for b in base) for k in BASE]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert base or r.spans == ""


def expected_terms(texts, support=3):
    """(entity, term) -> level by the definitions, over plain dictionaries."""
    n, held, with_term = len(texts), defaultdict(set), defaultdict(set)
    docs = defaultdict(int)
    for text in texts:
        for w in set(re.split(r"[^\w]+|_", (text or "").lower())):
            docs[w] += 1
        spans = pattern_spans(text or "")
        hidden = list(text or "")
        for a, b, _ in spans:
            hidden[a:b] = " " * (b - a)
        for a, b, k in spans:
            near = terms(" ".join("".join(hidden[max(0, a - 200):a]).split()[-5:] + "".join(hidden[b:b + 200]).split()[:5]))
            e = entity(text, (a, b, k))
            held[e].add(tuple(near))
            for t in near:
                with_term[e, t].add(tuple(near))
    out = {}
    for (e, t), c in with_term.items():
        if len(c) >= support and len(held[e]) < n:
            share = math.log2(len(c) * n / (docs[t] * len(held[e]))) / math.log2(n / len(held[e]))
            if share >= 0.8:
                out[e, t] = "remove" if share >= 0.95 else "generalise"
    return out


@pytest.mark.parametrize("sent", [True, False])
def test_disclosing_terms(spark, monkeypatch, sent):
    reachable(spark)
    if not sent:
        monkeypatch.setattr("airlake.llm.pii.SENT_TERMS", -1)
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice("lorem ipsum dolor amet sit elit sed magna aliqua enim".split()) + str(rng.randrange(30)) for _ in range(n))
    texts = [f"{fill(9)} Zebulon Quorra, manager {fill(1)} zeb@firm.example {fill(9)}" for _ in range(6)]
    texts += [f"{fill(20)} manager {fill(9)}" for _ in range(2)] + [fill(30) for _ in range(60)] + [f"copied words here rare@mail.example copied end"] * 9
    texts += [None, "", "Zebulon alone"]
    rows = [(i, t, t) for i, t in enumerate(texts)]
    want = expected_terms(texts)
    assert {t for _, t in want} >= {"zebulon", "manager", "quorra"} and set(want.values()) == {"remove", "generalise"}
    got = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        known = {entity(text, s) for s in pattern_spans(text or "")}
        told = {(text[int(a):int(b)].lower(), k) for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if k in KINDS[4:]}
        assert told == {(t, k) for (e, t), k in want.items() if e in known}
        if known:
            assert "@" not in got[i].sanitised and "zebulon" not in got[i].sanitised.lower()
    assert got[len(texts) - 1].spans == "" and got[70].sanitised != texts[70]
    assert document_counts is not None


@pytest.mark.parametrize("copies", [1, 20, 1000])
@pytest.mark.parametrize("by_hash", [True, False])
def test_copies_change_nothing(spark, monkeypatch, copies, by_hash):
    reachable(spark)
    if not by_hash:
        monkeypatch.setattr("airlake.llm.pii.SENT_COPIES", -1)
    rng = random.Random(8)
    fill = lambda n: " ".join(f"word{rng.randrange(40)}" for _ in range(n))
    told = [f"{fill(6)} Zebulon {fill(2)} zeb@firm.example {fill(9)}" for _ in range(3)]
    once = [f"{fill(30)} {i}" for i in range(500)] + ["lone@mail.example", None, ""]
    rows = list(enumerate(told * copies + once))
    got = sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    cut = {r.sanitised for r in got.where(f"doc_id < {3 * copies}").collect()}
    assert len(cut) == 3 and not any("zebulon" in c.lower() for c in cut)
    assert all("word" in c for c in cut)


def test_contexts_reach_whole_words_however_far():
    rng = random.Random(10)
    for _ in range(300):
        words = [rng.choice(["a@b.cc", "x" * 250, "Ann", "漢" * 90, "+49 30 1234567", "one,two", "q"]) for _ in range(rng.randint(1, 14))]
        text = "".join(w + " " * rng.choice([1, 2, 300]) for w in words)
        base = pattern_spans(text)
        blank = list(text)
        for a, b, _ in base:
            blank[a:b] = " " * (b - a)
        want = []
        for a, b, k in base:
            near = terms(" ".join("".join(blank[:a]).split()[-5:] + "".join(blank[b:]).split()[:5]))
            want += [(entity(text, (a, b, k)), t) for t in set(near) or {None}]
        assert sorted(((e, t) for e, _, t in contexts(text, base)), key=str) == sorted(want, key=str)


def test_far_terms_are_removed(spark):
    reachable(spark)
    rng = random.Random(11)
    fill = lambda n: " ".join(f"word{rng.randrange(40)}" for _ in range(n))
    texts = [f"{fill(9)} Zebulon{' ' * 300}{fill(1)} zeb@firm.example {fill(9)}" for _ in range(6)] + [fill(30) for _ in range(200)]
    got = sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_email > 0").collect()
    assert len(got) == 6 and not any("Zebulon" in r.sanitised for r in got)


def test_one_passage_in_many_texts_is_no_support(spark):
    reachable(spark)
    rng = random.Random(9)
    fill = lambda: " ".join(f"word{rng.randrange(40)}" for _ in range(30))
    texts = [f"{fill()} one two Zebulon four five zeb@firm.example six seven eight nine ten {fill()}" for _ in range(20)] + [fill() for _ in range(200)]
    got = sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_email > 0").collect()
    assert len(got) == 20 and all("Zebulon" in r.sanitised for r in got)


def test_empty_table(spark):
    reachable(spark)
    assert sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0
