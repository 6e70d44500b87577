from __future__ import annotations

import glob
import random
import struct
import zlib

import public_tokenizers
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from airlake.llm import QUERIES
from airlake.llm.registry import reachable
from airlake.llm.token_orc import Encoder, find_documents, read_tokens, with_crc, write_tokens
from tests.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_stretches_give_the_ids_of_whole_texts(library):
    rng = random.Random(1)
    alphabet = "ab  \n\t\x1c\x1f\x85　é漢's12..\x00😀|"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [t + "  <|endoftext|> x" for t in texts[:50]]
    enc = Encoder(PATH, 2)
    assert [ids(r) for r in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_query_against_the_library(spark, library):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_orc"](spark, SMALL).collect()}
    at = 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    for d in docs:
        want = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert got[d.doc_id] == (at, len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
        at += len(want)
    assert len(got) == len(docs)


def test_edge_rows_files_and_lookup(spark, tmp_path, library):
    reachable(spark)
    long = "word " * 200_000
    rows = [(3, None, 1), (1, "", 2), (None, "x", 3), (2, "a b", 4), (2, "a b", 5), (2, "c", 6), (9, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    path = str(tmp_path / "t")
    write_tokens(docs, path, PATH)
    got = with_crc(read_tokens(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 2, 3, 9]
    assert got[1].n_tokens == got[5].n_tokens == 1
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert got[-1].n_tokens == len(library.encode(long, add_special_tokens=False).ids) + 1
    assert sorted(r.n_tokens for r in find_documents(spark, path, [2, 77]).collect()) == sorted(r.n_tokens for r in got[2:5])
    files = [orc.ORCFile(f) for f in glob.glob(path + "/*.orc")]
    assert all(f.compression == "ZSTD" and f.row_index_stride == 1000 for f in files)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), PATH)
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0
