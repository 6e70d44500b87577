"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws the exponential key ``-ln(u) / weight``, where ``u`` is a keyed hash of the
document and ``weight`` its quality; within a source, small keys come first, so a document's chance to
lead is proportional to its weight.  A source's word budget is spent on complete epochs first, then on
the documents with the smallest keys as long as their sizes, summed in key order, fit in what is left, and at last on the one of the others whose
size comes nearest to the remaining gap, if taking it leaves less than not taking it.

The prefix sum is hierarchical: keys are cut into ``buckets`` value ranges per source, the ranges' sums
locate the range that the budget ends in, and only the documents of that range are ordered.  The ranges follow the distribution that keys have under the
weights that occur (counted by powers of two), so they are about even whatever the weights are; which documents are taken depends on the keys alone,
not on the ranges.  No source, however large, is sorted or gathered in one task; the sources themselves are put in order in one, as one row each.

Defined cases: a null text has size 0 and is never taken; null sources form one source, the last; null or
non-positive weights count as 1; an empty table gives an empty result; a null id is an id like others; repeated rows are separate
documents with one key, whose order among themselves doesn't change the rows of the result (many equal rows meet in one range); equal keys
of different documents follow the id and the size; a text of any length is one document, read for its number of words only; when all sizes are 0,
targets are 0.  Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.llm.common import SPACE, publish, table
from airlake.llm.registry import query

WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    """Number of stretches without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) for one row per source (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all sizes.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight.  The level
    of the sharing is where the sources' limits, sorted by limit per weight, leave the rest in proportion.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    limited = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit"))
    # one row per source, of a table that is already aggregated
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = limited.select(
        "*", (F.sum("source_size").over(everything) * share).alias("total"),
        F.coalesce(F.sum("limit").over(below), F.lit(0.0)).alias("filled"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))).alias("open"))
    level = (F.col("total") - F.col("filled")) / F.col("open")
    leveled = ranked.select("*", F.max(F.when(level * F.col("weight") <= F.col("limit"), level)).over(everything).alias("level"))
    return leveled.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def mark(id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Column:
    """The keyed hash of a document; with the id it finds the document's row again."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7, weights: DataFrame | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_bucket: int = 50_000) -> DataFrame:
    """(doc_id, mark, size, source, source_size, target, epochs, taken): what a mix of ``share`` times all words takes.

    ``taken`` is a whole multiple of ``size``: ``epochs`` times the document.  ``weights`` is (w_id, weight), a row per id.
    """
    # the texts are read once; all that follows works on these few numbers per document
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), mark(id_col, text_col, seed).alias("mark"))
    thin = publish(thin.withColumn("row", F.monotonically_increasing_id()), "mix")
    w = F.lit(1.0)
    if weights is not None:
        thin = thin.join(weights, F.col("doc_id") == F.col("w_id"), "left").drop("w_id")
        w = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(1.0).cast("double")
    # 53 bits of the hash, in (0, 1]
    u = (F.shiftrightunsigned("mark", 11).cast("double") + 1.0) / float(1 << 53)
    power = F.floor(F.log2(w)).cast("int")
    # a row per power of two among the weights, two thousand at most
    counted = {r.power: r.n for r in thin.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(counted.values()))
    thin = thin.select("row", "doc_id", "source", "size", "mark", (-F.log(u) / w).alias("key"))
    buckets = max(1, -(-total // rows_per_bucket))
    # how many keys are expected below: rises with the key
    below = sum((F.lit(n / total) * (1.0 - F.exp(-F.col("key") * float(2.0**p))) for p, n in sorted(counted.items())), F.lit(0.0))
    thin = thin.withColumn("bucket", F.least(F.floor(below * buckets), F.lit(buckets - 1)).cast("int"))
    same = F.col("source").eqNullSafe(F.col("s_source"))

    per_bucket = thin.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, most)
    spent = F.col("source_size") * F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
                       (F.col("target") - spent).alias("rest"))
    goal = goal.withColumnRenamed("source", "s_source")
    # where in its source each value range begins: one row per source and range
    ranged = per_bucket.join(goal, same).select(
        "s_source", "source_size", "target", "whole", "rest", "bucket", "bucket_size",
        (F.sum("bucket_size").over(Window.partitionBy("s_source").orderBy("bucket")) - F.col("bucket_size")).alias("before"))
    ranged = ranged.withColumnRenamed("bucket", "s_bucket")
    placed = thin.join(ranged, same & (F.col("bucket") == F.col("s_bucket"))).drop("s_source", "s_bucket")
    ends = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest"))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where(ends).withColumn("first", F.col("before") + F.sum("size").over(order) <= F.col("rest"))
    outside = placed.where(~ends).withColumn("first", F.col("before") + F.col("bucket_size") <= F.col("rest"))
    columns = ["row", "doc_id", "mark", "size", "key", "source", "source_size", "target", "whole", "rest", "first"]
    placed = publish(inside.select(*columns).unionByName(outside.select(*columns)), "mix-placed")

    left = placed.groupBy(F.col("source").alias("l_source")).agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("first"), F.col("size"))), F.lit(0))).alias("left"))
    gap = F.abs(F.col("size") - F.col("left"))
    others = placed.where(~F.col("first") & (F.col("size") > 0)).join(left, F.col("source").eqNullSafe(F.col("l_source"))).where(gap < F.col("left"))
    last = others.groupBy("source").agg(F.min_by("row", F.struct(gap, "key", F.col("doc_id").isNull(), "doc_id", "row")).alias("last")).select("last")
    more = F.coalesce((F.col("first") & (F.col("size") > 0)) | F.col("last").isNotNull(), F.lit(False)).cast("long")
    epochs = F.least(F.col("whole") + more, F.lit(int(-(-most // 1)))).cast("long")
    taken = placed.join(last, F.col("row") == F.col("last"), "left")
    return taken.select("doc_id", "mark", "size", "source", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w_id, weight): labelled good documents lead, labelled bad ones trail."""
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return labels.select(F.col("doc_id").alias("w_id"), F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to 150 % of their words."""
    return mix(table(spark, sf_dir, "documents"), weights=quality_weights(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
