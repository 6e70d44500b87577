from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from airlake.llm import QUERIES
from airlake.llm.registry import reachable
from airlake.llm.sentencepieces import Encoder, Pieces, by_heap, decode, encode, many
from airlake.llm.shingles import mix64
from tests.conftest import SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")


def ids(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}i", raw))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    odd = ["".join(rng.choice("abc  \n\té漢😀\x00.123") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    return odd + docs + ["", " ", "x" * 3000, " ".join(["the"] * 50), "thetheandthe" * 40]


def test_without_dropout_as_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [ids(r) for r in Encoder(PATH, 0, 0.0).encode([0] * len(texts), texts)] == library.encode(texts)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_rounds_agree_with_the_agenda(dropout):
    p, rng = Pieces(PATH), random.Random(4)
    units = [" " * rng.randint(0, 3) + "".join(rng.choice("thereandionß▁é漢") for _ in range(rng.randint(1, 20))) for _ in range(500)]
    streams = [rng.randrange(4) for _ in units]
    flat, upto = many(p, units, streams, 3, dropout)
    assert [flat[a:b].tolist() for a, b in zip(upto, upto[1:])] == [by_heap(p, u, s, 3, dropout) for u, s in zip(units, streams)]


def test_dropout_varies_and_is_repeatable(texts):
    words = ["ration station nation " * 40]
    cut = lambda seed, key=1: ids(Encoder(PATH, seed, 0.3).encode([key], words)[0])
    assert cut(1) == cut(1) and cut(1) != cut(2) and cut(1) != cut(1, 2)
    one = Encoder(PATH, 1, 0.3)
    one.encode([1], [" ration" * 200])
    assert len({v for (s, w), v in one.known.items() if w == " ration"}) > 1
    assert len(cut(1)) > len(ids(Encoder(PATH, 1, 0.0).encode([1], words)[0]))


def test_every_occurrence_draws_for_itself():
    p, rng = Pieces(PATH), random.Random(5)
    # words of one, two and more merges: in four shared draws many of them would never vary
    words = [w for w in ("of", "it", "the", "and", "that", "from", "river", "ration") for _ in range(3000)]
    rng.shuffle(words)
    enc = Encoder(PATH, 0, 0.1)
    coded = ids(enc.encode([7], [" ".join(words)])[0])
    plain = {w: ids(Encoder(PATH, 0, 0.0).encode([0], [w])[0]) for w in set(words)}
    seen, at = {w: [] for w in plain}, 0
    for w in words:
        said, size = "", at
        while said != " " + w:
            said, size = said + p.text[coded[size]].decode(), size + 1
        seen[w].append(coded[at:size])
        at = size
    assert at == len(coded)
    for w, cut in seen.items():
        # every way of skipping turns has its chance; other ways may lead to the plain pieces too
        ways = [(0.1 ** len(drops) * 0.9 ** (turns - len(drops)), ids(raw) == plain[w]) for (drops, v), (raw, turns) in enc.known.items() if v == " " + w]
        want = sum(chance for chance, same in ways if same)
        assert sum(chance for chance, _ in ways) > 0.97
        assert abs(sum(c == plain[w] for c in cut) / 3000 - want) < 0.03 + 5 * (want * (1 - want) / 3000) ** 0.5, w


@pytest.mark.parametrize("dropout", [0.1, 0.6, 1.0])
def test_remembered_segmentations_are_those_of_the_agenda(dropout):
    rng = random.Random(6)
    words = ["".join(rng.choice("thereandion漢😀") for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["y" * 70]
    text = " ".join(rng.choice(words) for _ in range(600))
    enc, heard = Encoder(PATH, 2, dropout), []
    got = enc.encode([5], [text])[0]
    for i, w in enumerate(text.split(" ")):
        stream = int(mix64(np.array([i], np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(5 ^ 2 * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
        heard.append(enc._bytes(by_heap(enc.pieces, " " + w, stream, 2, dropout)))
    assert got == b"".join(heard)


def test_query_decodes_losslessly(spark):
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op4_sentencepiece"](spark, SMALL).collect()
    assert {r.doc_id: r.text_sha256 for r in rows} == want and len(rows) == len(want) and all(r.n_pieces > 0 for r in rows)


def test_edge_rows(spark):
    reachable(spark)
    odd = ["", " ", "  a  b ", "▁x▁ ▁", "\n\n \n", "<s> </s> <0x41> <unk>", "😀\x00\x7f", "long " * 60_000, "y" * 20_000, "rep", "rep"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(odd)] + [(None, None, None), (None, "z", "z")], "doc_id long, text string, ids string")
    got = decode(encode(df, PATH, 0.2), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([*enumerate(odd), (None, ""), (None, "z")], key=str)
    assert decode(encode(df.where("1 = 0"), PATH), PATH).count() == 0
