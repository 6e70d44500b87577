from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from airlake.llm import QUERIES
from airlake.llm.registry import reachable
from airlake.llm.toxicity import (AHEAD, INSULT, KINDS, PRIOR, REACH, Lexicon, assess, clauses, compose, contexts, grammar, labelled, learn_stems, learn_weights, matches,
                                  negation, reports, targets, threats)
from tests.conftest import SMALL

BASE = "/root/testdata/sf0.01"


def plain(classes: str) -> str:
    """The grammar in so many words: outputs of a clause's classes."""
    out, denied, willing, seen, quoted = [], 0, 0, "", False
    for c in classes:
        s = c
        if c == "H":
            s = "V" if willing else "O"
        willing = AHEAD if c == "W" else max(0, willing - 1)
        if s in "IV" and denied:
            s = s.lower()
        denied = REACH if c == "N" else max(0, denied - 1)
        if s == "T" and seen == "I":
            s, seen = "D", "T"
        elif s == "T":
            seen = "T"
        elif s == "I" and seen == "T":
            s = "D"
        elif s == "I":
            seen = "I"
        if c == "R":
            quoted = True
        if quoted:
            s = {"I": "r", "D": "r", "V": "q"}.get(s, s)
        out.append(s)
    return "".join(out)


def test_the_composed_machine_is_the_cascade():
    whole, parts = grammar(), (threats(), negation(), targets(), reports())
    rng = random.Random(2)
    some = ["".join(c) for c in itertools.product("OIHWTNR", repeat=4)] + ["".join(rng.choices("OIHWTNR", k=rng.randint(5, 30))) for _ in range(2000)]
    for classes in some:
        each = classes
        for p in parts:
            each = p(each)
        assert whole(classes) == each == plain(classes)
    assert compose(threats(), negation())("NOIWOHNWH") == "NOiWOVNWv"


@pytest.mark.parametrize("text, kinds", [
    ("You are an idiot.", "D"), ("An idiot, he", "I"), ("idiot you", "ID"), ("that is not an idiot", "i"), ("not at all that or this idiot", "I"), ("He said the idiot left", "r"),
    ("We will kill him", "V"), ("we will not kill him", "v"), ("he wrote we will kill", "q"), ("die Frau", ""), ("loweischaft! Lowei?", "I I"), ("IDIOT", "I"), ("idiots", ""), ("", ""), (None, ""),
])
def test_clauses_are_told_apart(text, kinds):
    found = matches(text, Lexicon(["idiot$", "lowei"]), grammar())
    assert " ".join(k for _, _, k in found) == kinds
    assert all(text[a:b] and text[b:b + 1] in ("", ".", "!", "?", ",") for a, b, _ in found)


def corpus(n: int, seed: int = 1) -> list[tuple]:
    """(doc_id, text, toxic): invented words; toxic texts hold an insult or a stem with an ending, some are copied."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghiklmnoprstuvz", k=rng.randint(2, 7))) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(30, 120))
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["dolt", "oafish", "grumsel" + rng.choice(["ka", "li", "torp", "ung"])]))
        rows.append((i, " ".join(w) + ".", int(bad)))
    return rows


def test_contexts_and_stems_against_brute_force(spark):
    reachable(spark)
    rows = corpus(300)
    copied = rows + [(1000 + i, rows[4][1], 1) for i in range(60)]
    sample = spark.createDataFrame([(t, y) for _, t, y in copied], "text string, toxic int")
    want: dict[str, list[set]] = {}
    for _, t, y in copied:
        w = ["", *t.strip(".").split(), ""]
        for a, b, c in zip(w, w[1:], w[2:]):
            want.setdefault(b, [set(), set()])[y].add(zlib.crc32(f"{a} {c}".encode()))
    got = {r.word: (r.other, r.toxic) for r in contexts(sample.repartition(7)).collect()}
    assert got == {w: (len(o), len(t)) for w, (o, t) in want.items()}
    stems = learn_stems(sample)
    # copies of one toxic text make none of its words an insult
    assert set(stems) == {"dolt$", "oafish$", "grumsel"}
    # a word that clean texts use is none, whatever it begins with
    for most in (6, 60):
        usual = [(f"{t} grumselot", 0) for _, t, y in rows if not y][:most]
        lexicon = Lexicon(learn_stems(sample.unionByName(spark.createDataFrame(usual, sample.schema))))
        assert [lexicon.of(w) for w in ("grumselka", "dolt", "grumselot", "grum")] == [INSULT, INSULT, "O", "O"]


def test_held_out_texts(spark):
    reachable(spark)
    rows = corpus(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "l_id long, toxic int")
    found, model = assess(docs, labels)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows) and all(got[i].predicted == y for i, _, y in rows if i % 3 == 0)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # clean documents match no clause
    assert all(bool(got[i].clauses) == bool(y) for i, _, y in rows)


def test_weights_follow_the_labels(spark):
    # denied insults that are labelled clean weigh little, bare ones much
    rows = [([1, 0, 0, 0, 0, 0, 0], 1)] * 50 + [([0, 0, 1, 0, 0, 0, 0], 0)] * 50 + [([0] * 7, 0)] * 400
    w = learn_weights(spark.createDataFrame(rows, "counts array<int>, toxic int"))
    at = {k: w[0] + (w[i] if i else 0) + w[-1] for i, k in enumerate(KINDS)}
    assert at["I"] > 1 and at["i"] < -1 and w[-1] < -3
    # a kind that no label speaks about follows the others
    assert at["D"] > at["I"] and at["r"] < at["I"]
    assert learn_weights(spark.createDataFrame([], "counts array<int>, toxic int")).tolist() == PRIOR.tolist()


def test_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op12_toxicity"](spark, BASE).collect()}
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{BASE}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    told = [(got[i].predicted, y) for i, y in labels]
    assert sum(p == y for p, y in told) / len(told) > 0.96 and sum(p and not y for p, y in told) == 0


def test_edge_rows(spark):
    reachable(spark)
    rows = corpus(200)
    some = [(None, rows[0][1]), (900, None), (901, ""), (902, "dolt " * 50_000), (903, rows[0][1]), (903, rows[0][1]), (904, "。！"), (None, None)]
    schema = "doc_id long, text string, counts int, clauses string, toxic int"
    docs = spark.createDataFrame([(*r[:2], 1, "clash", 1) for r in rows + some], schema)
    labels = labelled(spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (900, None, 1), (5, 0, 1), (901, 2, 1)], "doc_id long, toxic int, quality int"))
    found, model = assess(docs, labels)
    got = found.collect()
    assert len(got) == len(rows) + len(some)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[903]) == 2 and by[903][0].score == by[903][1].score == by[0][0].score == max(r.score for r in by[None])
    assert by[900][0].score == by[901][0].score == by[904][0].score == min(r.score for r in got) < 0.5
    assert by[902][0].predicted == 1 and len(by[902][0].clauses[0].kinds) == 50_000
    none, model = assess(docs, labels.where("1 = 0"))
    assert model.stems == [] and np.array_equal(model.weights, PRIOR) and {r.predicted for r in none.collect()} == {0}
    assert assess(docs.where("1 = 0"), labels)[0].count() == 0
    assert clauses(docs, ["dolt$"], keep=("doc_id", "clauses")).columns == ["doc_id", "clauses", "counts", "clauses"]


def test_lexicon_forgets_and_remembers_alike():
    small = Lexicon(["dolt$", "grum"])
    small.MOST = 3
    words = ["dolt", "grumka", "x", "dolts", "gru", "kill", "not"] * 3
    assert [small.of(w) for w in words] == [Lexicon(["dolt$", "grum"]).of(w) for w in words]
    assert Lexicon(["grum", "grumpy!"]).of("grumpy") == "O" and Lexicon(["grum", "grumpy!"]).of("grumpyx") == INSULT
    assert small.of("grum" + "a" * 100) == INSULT and "grum" + "a" * 100 not in small.known
