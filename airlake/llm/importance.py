"""Importance resampling towards a target distribution, on hashed word n-grams.

A text's separators are collapsed to single spaces; one boundary-guarded pattern, searched with overlapped matches, then finds at
every word the n-grams that begin there: the whole match is the longest, its groups the shorter ones.  Spans go straight to
CRC-32, whose remainder is the feature's bucket.  Raw and target texts give two bucket distributions; a bucket's gain is the
logarithm of their ratio, with one added to every bucket, and a document's weight is the mean gain of its features.  Adding Gumbel noise that a
keyed hash of the id draws makes the highest scores a sample without replacement, in proportion to the exponentials of the weights.

Texts are searched once: what a document holds of every bucket is written to the shared folder, and counts, weights and ranks
come from there.  A score is a whole number between two constants that follow from the formula, so a count per score
places every score in the order, and only documents of equal score are ordered among themselves.

Defined cases: a null or empty text has no features, weight 0, and is not drawn unless ``least_words`` is 0; a null id draws its noise from the text
and comes after the other ids of its score; rows of equal score and id follow the text's hash, so which of fully equal rows gets which rank
doesn't show; every row of a repeated id counts; an empty table of documents gives an empty result, an empty target leaves the gains of counts of 0; texts
of any length are searched whole and held as their features' bucket numbers, four bytes each.  Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.llm.common import publish, slices, table
from airlake.llm.registry import query

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
SCALE = 1000
#: Bytes of words stay, A-Z as a-z; all others are separators.  Bytes over 127 belong to characters that are no separators.
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_GAPS = regex.compile(rb"  +")


def pattern(longest: int) -> regex.Pattern:
    """At a word's first byte: group k is the run of k + 1 words that begins there, as far as there are so many; the match is the longest."""
    more = b""
    for _ in range(longest - 1):
        more = rb"(?:( [^ ]+)" + more + rb")?"
    return regex.compile(rb"(?<![^ ])([^ ]+)" + more + rb"(?![^ ])")


def collapsed(text: str | None) -> bytes:
    """The words in UTF-8, one space between them."""
    return _GAPS.sub(b" ", (text or "").encode().translate(_FORM)).strip(b" ")


def spans(form: bytes, found: regex.Pattern) -> Iterator[tuple[int, int]]:
    """Begin and end of every run of words, those of one begin together."""
    groups = range(1, found.groups + 1)
    for m in found.finditer(form, overlapped=True):
        for g in groups:
            if m.end(g) >= 0:
                yield m.start(), m.end(g)


def bucket_counts(text: str | None, found: regex.Pattern, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of features, the buckets that occur, how often)."""
    form = collapsed(text)
    crc = np.fromiter((zlib.crc32(form[a:b]) for a, b in spans(form, found)), np.uint32)
    held, often = np.unique(crc % buckets, return_counts=True)
    return len(crc), held.astype(np.int32), often.astype(np.int64)


def features(texts: DataFrame, id_col: str, text_col: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(id, mark, n_features, n_words, held, often): a row per text; ``held`` and ``often`` are buckets and their counts."""
    d = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pattern(longest)
        for batch in batches:
            for part in slices(batch, 1):
                n, held, often = zip(*(bucket_counts(t, found, buckets) for t in part.column(1).to_pylist()))
                words = [_words(k, longest) for k in n]
                at = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in held]))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(words, pa.int64()),
                     pa.ListArray.from_arrays(at, pa.array(np.concatenate(held), pa.int32())), pa.ListArray.from_arrays(at, pa.array(np.concatenate(often), pa.int64()))],
                    names=["id", "mark", "n_features", "n_words", "held", "often"])

    return d.mapInArrow(run, "id long, mark long, n_features long, n_words long, held array<int>, often array<long>")


def _words(n_features: int, longest: int) -> int:
    """Words of a text with so many runs of 1 to ``longest`` words."""
    short = 0
    while short < longest and (short + 1) * (short + 2) // 2 <= n_features:
        short += 1
    # a text of w >= longest words has w runs of one, w - 1 of two, ...
    return short if short < longest else (n_features + longest * (longest - 1) // 2) // longest


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in every bucket; each task sends one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(seen, np.asarray(batch.column(0).flatten()), np.asarray(batch.column(1).flatten()))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], names=["bucket", "n"])

    rows = found.select("held", "often").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.n for r in rows]
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the ratio of the smoothed shares), by bucket."""
    s, t, all_s, all_t = raw.astype(float), target.astype(float), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.floor(scale * np.log((t + 1) * all_s / ((s + 1) * all_t))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``found`` with ``weight``, the floored mean gain of a text's features (0 without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, often = batch.column(4), batch.column(5)
            product = np.concatenate(([0], np.cumsum(gain[np.asarray(held.flatten())] * np.asarray(often.flatten()))))
            at = np.asarray(held.offsets) - held.offsets[0].as_py()
            total = product[at[1:]] - product[at[:-1]]
            weight = total // np.maximum(np.asarray(batch.column(2)), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], names=["id", "mark", "n_features", "n_words", "weight"])

    return found.mapInArrow(run, "id long, mark long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of every document; ``rank`` is null for those not drawn.

    Of the documents with ``least_words`` words, the ``percent`` hundredths with the highest scores are drawn.
    """
    found = publish(features(docs, id_col, text_col, longest, buckets), "importance-features")
    wanted = features(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), "id", "text", longest, buckets)
    rows = weighed(found, gains(totals(found, buckets), totals(wanted, buckets)))
    drawn_by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.col("mark").cast("string")))), 256)
    h = F.conv(F.substring(drawn_by, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = publish(rows.withColumn("score", F.col("weight") + noise), "importance-scores")
    able = rows.where(F.col("n_words") >= least_words)
    # a row per distinct score: whole numbers in a range that the formula bounds, whatever the number of documents
    per_score = able.groupBy("score").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("score"))
    placed = per_score.select("score", (F.sum("n").over(order) - F.col("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    placed = placed.where(F.col("before") < F.col("drawn"))
    among = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "mark"))
    first = able.join(placed, "score").withColumn("rank", F.col("before") + among)
    rank = F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))
    columns = ["id", "n_features", "n_words", "weight", "score"]
    drawn = first.select(*columns, rank.alias("rank"))
    others = rows.where(F.col("n_words") < least_words).unionByName(able.join(placed, "score", "left_anti"))
    return drawn.unionByName(others.select(*columns, F.lit(None).cast("long").alias("rank"))).withColumnRenamed("id", "doc_id")


@query("op13_importance", """
with crc as materialized (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) t),
texts as (select 'd' kind, doc_id id, text from documents union all select 'b', item_id, text from benchmark),
words as (
  select row_number() over () r, kind, id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) w
  from texts),
lists as materialized (select r, kind, id, len(w) n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) f from words),
each as materialized (select r, kind, unnest(f) f from lists),
hexes as (select f, hex(encode(f)) x from (select distinct f from each)),
bytes as (select f, list_transform(range(0, len(x) // 2), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) b from hexes),
hashed as materialized (
  select f, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 bucket from bytes, crc),
counted as (select bucket, sum(case when kind = 'd' then 1 else 0 end) s, sum(case when kind = 'b' then 1 else 0 end) t from each join hashed using (f) group by bucket),
sums as (select sum(s) big_s, sum(t) big_t from counted),
gains as materialized (
  select bucket, floor(1000 * ln((t + 1)::double * (big_s + 10000)::double / ((s + 1)::double * (big_t + 10000)::double))) gain from counted, sums),
means as (select r, floor(sum(gain) / count(*)) weight from each join hashed using (f) join gains using (bucket) where kind = 'd' group by r),
scored as (
  select id doc_id, len(f) n_features, n_words, cast(coalesce(weight, 0) as bigint) weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::bigint + 0.5::double) / 4294967296))) as bigint) score
  from lists left join means using (r) where kind = 'd'),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) "rank", count(*) over () n from scored where n_words >= 20)
select doc_id, cast(n_features as bigint) n_features, weight, score, case when "rank" <= 25 * n // 100 then "rank" end "rank"
from scored left join ranked using (doc_id)
""")
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw a quarter of the documents towards the distribution of ``benchmark``."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
