"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is the sequence of its words (letters, marks and digits, in lower case; single characters in scripts without spaces, pieces of
very long runs).  A stretch of ``K`` words is a closed syncmer
when the smallest hash of its inner stretches of ``S`` words lies at either edge; whether it is one depends on its own words
alone, so the same passage gives the same anchors in any context.  The fingerprint keeps the ``SIZE`` anchors of smallest
hash with their word positions.  Two fingerprints are alike by the anchors they share, as far as the shared ones lie at one
distance of positions (within ``SLACK`` words), as a share of the smallest anchors of both.  From 64 anchors the share has a standard error of
at most 1/16; ``size`` asks for another number, None for all anchors of a text of any length, without that error.

Defined cases: a null text counts as empty and has an empty fingerprint; a text of fewer than ``K`` words has one anchor, the hash of
its words (of the text itself if it has none); equal texts have equal fingerprints, and two empty ones likeness 1; a null id sorts first;
rows of one id are ordered by text; a lone document is its own next; an empty table gives an empty result.
Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.llm.common import table
from airlake.llm.registry import query

K, S, SIZE, SLACK = 5, 2, 64, 16
#: An anchor is one number: 39 bits of its hash, then 24 bits of its word position (later positions count as the last).
_POSITION = 24
_LAST = (1 << _POSITION) - 1
#: Scripts that are written without spaces: each character is a word.
_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Other runs of letters, marks and digits are words of ``LONGEST`` characters at most, so that a run without end has anchors as well.
LONGEST = 32
_WORD = rf"[{_DENSE}]\p{{M}}*|[\p{{L}}\p{{M}}\p{{N}}&&[^{_DENSE}]]{{1,{LONGEST}}}"


def _anchor(h: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - 39), _POSITION).bitwiseOR(F.least(position.cast("long"), F.lit(_LAST)))


def with_fingerprint(df: DataFrame, text: str, name: str, size: int | None = SIZE) -> DataFrame:
    """``df`` with the column ``name``: the ``size`` least anchors, or all (array<long>, ascending), of the text column ``text``.

    The steps are columns of their own, so that each is computed once per row.
    """
    words, inner, every = f"{name}_words", f"{name}_inner", f"{name}_every"
    keep = df.columns
    df = df.withColumn(words, F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0), lambda w: F.xxhash64(w)))
    n = F.size(words)
    df = df.withColumn(inner, F.transform(words, lambda h, i: F.xxhash64(h, *[F.get(words, i + j) for j in range(1, S)])))
    at = F.when(n >= K, F.sequence(F.lit(0), n - K)).otherwise(F.array().cast("array<int>"))
    edge = K - S

    def closed(i: Column) -> Column:
        outer = F.least(F.get(inner, i), F.get(inner, i + edge))
        return outer <= F.least(*[F.get(inner, i + j) for j in range(1, edge)])

    found = F.transform(F.filter(at, closed), lambda i: _anchor(F.xxhash64(*[F.get(words, i + j) for j in range(K)]), i))
    whole = F.when(F.length(text) == 0, F.array().cast("array<long>")).otherwise(
        F.array(_anchor(F.when(n > 0, F.xxhash64(words)).otherwise(F.xxhash64(text)), F.lit(0))))
    df = df.withColumn(every, F.when(n >= K, F.array_sort(found)).otherwise(whole))
    # of equal anchors the first stays
    fresh = F.filter(every, lambda x, i: (i == 0) | (F.shiftright(x, _POSITION) != F.shiftright(F.get(every, i - 1), _POSITION)))
    return df.withColumn(name, fresh if size is None else F.slice(fresh, 1, size)).select(*keep, name)


def with_likeness(df: DataFrame, a: str, b: str, name: str, size: int | None = SIZE) -> DataFrame:
    """``df`` with the column ``name``: likeness of the fingerprint columns, from 0 to 1, the Dice coefficient that the shared anchors tell.

    ``size`` is that of the fingerprints.
    """
    keep = df.columns
    least, both, apart = f"{name}_least", f"{name}_both", f"{name}_apart"
    hash_of = lambda c: F.transform(c, lambda x: F.shiftright(x, _POSITION))
    place = lambda c: F.transform(F.filter(c, lambda x: F.array_contains(both, F.shiftright(x, _POSITION))), lambda x: x.bitwiseAND(F.lit(_LAST)))
    union = F.array_union(hash_of(a), hash_of(b))
    df = df.withColumn(least, union if size is None else F.slice(F.array_sort(union), 1, size))
    df = df.withColumn(both, F.array_intersect(least, F.array_intersect(hash_of(a), hash_of(b))))
    df = df.withColumn(apart, F.array_sort(F.zip_with(place(a), place(b), lambda x, y: x - y)))
    middle = F.get(apart, F.floor(F.size(apart) / 2).cast("int"))
    share = F.size(F.filter(apart, lambda d: F.abs(d - middle) <= SLACK)) / F.size(least)
    alike = F.when(F.col(a) == F.col(b), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * share / (1 + share))
    return df.withColumn(name, alike).select(*keep, name)


def to_text(fingerprint: str) -> Column:
    """Anchors as ``hash:position``, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.lower(F.hex(F.shiftright(x, _POSITION))), x.bitwiseAND(F.lit(_LAST)).cast("string"))), ",")


def with_next(docs: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """Every row with the columns ``extra`` of the row after it by ``key`` (then by ``extra``), as ``next_..``; the first follows the last.

    Rows go by ranges of the key to as many parts as a few per shuffle partition, in one shuffle; the first rows of a part
    are also guests at the end of the part before it.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.min(key), F.percentile_approx(key, [i / parts for i in range(1, parts)], 50 * parts)).first()
    bounds = sorted({cuts[0], *(cuts[1] or [])} - {None}) or [0]
    step = max(1, int(len(bounds) ** 0.5))
    whole, coarse = F.lit(bounds), F.lit(bounds[::step])
    upto = lambda some: F.size(F.filter(some, lambda b: b <= F.col(key)))
    rough = docs.withColumn("_rough", upto(coarse))
    placed = rough.withColumn("_part", (F.col("_rough") - 1) * step + upto(F.slice(whole, (F.col("_rough") - 1) * step + 1, F.lit(step))) - 1)
    first = F.get(whole, F.col("_part")) == F.col(key)
    before = F.when(F.col("_part") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("_part") - 1)
    seats = F.when(first, F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("guest")), F.struct(before.alias("p"), F.lit(True).alias("guest"))))
    seats = seats.otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("guest"))))
    seated = placed.withColumn("_seat", F.explode(seats)).select(*docs.columns, "_seat.p", "_seat.guest")
    order = Window.partitionBy("p").orderBy("guest", key, *extra)
    return seated.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in extra]).where("not guest").drop("p", "guest")


@query("op8_syncmers")
def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike neighbours are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_fingerprint(docs, "text", "marks")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(own, "key", ["text", "marks"]).select(
        "doc_id", n.cast("long").alias("n_chars"), "marks", "next_marks",
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    both = with_fingerprint(pairs, "edited", "edited_marks")
    alike = with_likeness(with_likeness(both, "marks", "edited_marks", "near_edited"), "marks", "next_marks", "near_next")
    return alike.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), to_text("marks").alias("fingerprint"),
                        to_text("edited_marks").alias("edited_fingerprint"),
                        "near_edited", "near_next")
