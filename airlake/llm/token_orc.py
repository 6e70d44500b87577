"""Token ids of documents as an ORC dataset.

Layout: files in ascending document order.  A row is one document:

========== =========== ==========================================================
part       int         number of the file's range in the global order
file_start long        ids of the earlier documents of the same range
doc_id     long        carries a Bloom filter and a row index
n_tokens   int         ids of the document, the end id included
ids        array<int>  integer run-length encoded
========== =========== ==========================================================

Readers take stripes in parallel and skip stripes and row groups by the statistics and
Bloom filters of ``doc_id``.  Global positions need one number per range (its sum), so no
task or driver ever sees all documents.

Defined cases: a null text counts as empty and holds only the end id; a null id sorts first;
repeated ids are ordered by text, identical rows are interchangeable; an empty table gives an
empty dataset; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.llm.common import slices, table
from airlake.llm.registry import query
from airlake.session import new_dir

END_ID = 2
SCHEMA = "part int, file_start long, doc_id long, n_tokens int, ids array<int>"

#: White space as the pre-tokenizer of a byte-level BPE sees it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches that the pre-tokenizer never joins: a word with the one space before it, or white space.
_STRETCH = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: White space other than spaces and line feeds.
_RARE = re.compile(r"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: ASCII punctuation but the apostrophe: after a letter it begins a piece of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Distinct stretches that one worker remembers; the first met stay, and frequent ones are met first.
_REMEMBERED = 600_000


def _even(text: str) -> bool:
    """Words with single spaces or line feeds between them, and nothing else."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text or text[0] in " \n" or text[-1] in " \n" or _RARE.search(text))


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct stretch once.

    Byte-level BPE never merges across the stretches, so the ids of a text are the ids of its
    stretches in order.  A text that holds a special token's own string goes to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = array("I", [end_id]).tobytes()
        self.feed = self._library(["\n"])[0]
        #: ids by stretch, and by word: one after a space stands alone, one after a line feed with the line feed
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Words without the punctuation after their last letter go to the library, and so does the punctuation."""
        ends = []
        for word in fresh:
            stem = word.rstrip(_MARKS)
            ends.append(stem if len(stem) < len(word) and stem[-1:].isalpha() else word)
        stems = list(set(ends).difference(self.words))
        feeds = [s for s in stems if s[0] == "\n"]
        plain = [s for s in stems if s[0] != "\n"]
        self.words.update(zip(plain, self._library([" " + s for s in plain])))
        self.words.update(zip(feeds, [self.feed + raw for raw in self._library([s[1:] for s in feeds])]))
        tails = {w[len(s):] for w, s in zip(fresh, ends)} - {""}
        ids = dict(zip(tails, self._library(list(tails))))
        self.words.update((w, self.words[s] + ids[w[len(s):]]) for w, s in zip(fresh, ends) if len(s) < len(w))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For every text its ids, little-endian unsigned 32-bit, and the end id."""
        cut: list = []
        words: set[str] = set()
        stretches: set[str] = set()
        for text in texts:
            if any(s in text for s in self.special):
                cut.append(None)
            elif _even(text):
                # the line feed goes with the word after it; one is put before the first word and taken off later
                cut.append((True, ("\n" + text.replace("\n", " \n")).split(" ")))
                words.update(cut[-1][1])
            else:
                cut.append((False, _STRETCH.findall(text)))
                stretches.update(cut[-1][1])
        self._learn(list(words.difference(self.words)))
        fresh = list(stretches.difference(self.stretches))
        self.stretches.update(zip(fresh, self._library(fresh)))
        word, stretch, extra = self.words.__getitem__, self.stretches.__getitem__, len(self.feed)
        out = []
        for text, found in zip(texts, cut):
            if found is None:
                raw = self._library([text])[0]
            elif found[0]:
                raw = b"".join(map(word, found[1]))[extra:]
            else:
                raw = b"".join(map(stretch, found[1]))
            out.append(raw + self.end)
        for known in (self.stretches, self.words):
            while len(known) > _REMEMBERED:
                known.popitem()
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a worker process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in global id order with their ids, ready to be written (``SCHEMA``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = _encoder(tokenizer, end_id), 0
        for batch in batches:
            for some in slices(batch, 2):
                raw = enc.encode([t or "" for t in some.column(2).to_pylist()])
                sizes = np.fromiter((len(b) // 4 for b in raw), np.int64, len(raw))
                at = np.concatenate(([0], np.cumsum(sizes)))
                flat = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(raw))])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(before + at[:-1]), some.column(1), pa.array(sizes, pa.int32()), ids],
                    names=["part", "file_start", "doc_id", "n_tokens", "ids"])
                before += int(at[-1])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = d.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return order.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", stripe_mb: int = 16, index_rows: int = 1000) -> None:
    """Write the dataset.  Stripes of ``stripe_mb`` are the unit of parallel reads."""
    (encode_sorted(docs, tokenizer, end_id, id_col, text_col).write
     .option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_mb << 20).option("orc.create.index", "true")
     .option("orc.row.index.stride", index_rows).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents with ``start``, the ids of all documents before them."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    # one row of two numbers per range of the order, so as many as files: small enough for every task
    before = sums.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"),
                                            F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents; stripes and row groups without them are skipped."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin([int(i) for i in doc_ids])).select("doc_id", "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by the CRC-32 of their little-endian 32-bit form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op1_token_orc")
def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the ORC dataset to the shared folder and read it back."""
    path = new_dir(spark, "token-orc")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_crc(read_tokens(spark, path))
