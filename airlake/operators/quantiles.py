"""Exact quantiles per key without gathering a key's rows in one task.

A radix selection.  Values are first counted (map-side combined) and take the order-preserving whole number of their bit pattern; counts by
its upper bits (a bounded number of rows per key) tell the buckets that hold the wanted ranks.  As long as such a bucket
holds more than ``DISTINCT`` distinct values, its own range of numbers is cut into 2 ** ``BITS`` parts, those are counted, and the parts with the ranks
stay: each round takes ``BITS`` bits off, so three rounds are enough for any input.  Only the distinct values of the last buckets are ranked.
The rows in the buckets go through a reliable checkpoint, because several steps need them.  Exact for every input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from airlake.session import cut_lineage

#: Upper bits of the first cut (sign, exponent, ten of the fraction), bits of the others, and distinct values that one task may rank.
FIRST, BITS, DISTINCT = 22, 16, 1 << 16
_FRACTION = 1 << 52


def ordered_bits(v: Column) -> Column:
    """The bit pattern of a double as a whole number in the order of the values (-0.0 is 0.0, NaN is last)."""

    def code(x: Column) -> Column:
        # the power of two below x, whatever the logarithm rounds to, and no less than the least normal one
        guess = F.floor(F.log2(x)).cast("double")
        e = F.when(x / F.pow(F.lit(2.0), guess) >= 2, guess + 1).when(x / F.pow(F.lit(2.0), guess) < 1, guess - 1).otherwise(guess)
        e = F.greatest(F.least(e, F.lit(1023.0)), F.lit(-1022.0))
        return ((e + 1022).cast("long") * _FRACTION) + (x / F.pow(F.lit(2.0), e) * float(_FRACTION)).cast("long")

    top = F.lit(2047 * _FRACTION)
    size = F.when(F.abs(v) == float("inf"), top).otherwise(code(F.abs(v)))
    return F.when(F.isnan(v), top + 1).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def value_counts(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """Rows (keys, v, n); nulls are left out."""
    c = F.col(value) if isinstance(value, str) else value
    return df.select(*keys, c.alias("v")).filter("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n"))


def quantiles_of_counts(vc: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of weighted values (keys, v, n); one row per key."""
    keys = list(keys)
    places = [f(F.lit(float(p)) * (F.col("_total") - 1)).cast("long") for p in probs.values() for f in (F.floor, F.ceil)]
    pos = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probs.items()}

    def held(parts: DataFrame, within: list[str], part: str, begin: Column, total: Column) -> DataFrame:
        """Of the counted parts (within, part, _m) those that hold wanted ranks, with the rank they begin at."""
        w_all = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
        cum = F.sum("_m").over(w_all.orderBy(part).rowsBetween(W.unboundedPreceding, 0))
        placed = parts.withColumn("_total", total(w_all)).withColumn("_from", begin + cum - F.col("_m"))
        return placed.filter(F.exists(F.array(*places), lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_m"))))

    coded = vc.withColumn("_v", F.col("v").cast("double")).withColumn("_code", ordered_bits(F.col("_v"))).drop("_v")
    coded = coded.withColumn("_b", F.shiftright("_code", 64 - FIRST))
    hist = held(coded.groupBy(*keys, "_b").agg(F.sum("n").alias("_m")), keys, "_b", F.lit(0), lambda w: F.sum("_m").over(w))
    inside = cut_lineage(coded.join(hist.select(*keys, "_b", "_from", "_total"), [*keys, "_b"]))
    while (inside.groupBy(*keys, "_b").count().agg(F.max("count")).first()[0] or 0) > DISTINCT:
        span = inside.groupBy(*keys, "_b").agg(F.min("_code").alias("_lo"), F.max("_code").alias("_hi"))
        # differences of codes of one bucket have at most 64 - FIRST bits
        span = span.select(*keys, "_b", "_lo", (F.shiftright(F.col("_hi") - F.col("_lo"), BITS) + 1).alias("_width"))
        cut = inside.join(span, [*keys, "_b"]).withColumn("_p", F.expr("(_code - _lo) div _width"))
        parts = cut.groupBy(*keys, "_b", "_from", "_total", "_p").agg(F.sum("n").alias("_m"), F.min(F.col("_lo") + F.col("_p") * F.col("_width")).alias("_next"))
        kept = held(parts.withColumnRenamed("_from", "_start").withColumnRenamed("_total", "_all"), [*keys, "_b"], "_p", F.col("_start"), lambda w: F.col("_all"))
        rows = cut.drop("_from", "_total").join(kept.select(*keys, "_b", "_p", "_from", "_total", "_next"), [*keys, "_b", "_p"])
        inside = cut_lineage(rows.select(*vc.columns, "_code", F.col("_next").alias("_b"), "_from", "_total"))
    w_in = W.partitionBy(*keys, "_b").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("_from") + F.sum("n").over(w_in)
    ranked = inside.select(*keys, "v", "_total", end.alias("_end"), (end - F.col("n")).alias("_start"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("v")))

    aggs = []
    for name, x in pos.items():
        aggs += [at(F.floor(x).cast("long")).alias(f"_lo_{name}"), at(F.ceil(x).cast("long")).alias(f"_hi_{name}")]
    out = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs)
    res = []
    for name, x in pos.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        res.append((lo + (hi - lo) * (x - F.floor(x))).alias(name))
    return out.select(*keys, F.col("_total").alias("n"), *res)


def median_and_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, n, med, mad): exact median and median absolute deviation."""
    vc = value_counts(df, keys, value)
    med = quantiles_of_counts(vc, keys, {"med": 0.5})
    # the median travels as a key of the second pass, so the results need no further join
    dev = (
        vc.join(med.select(*keys, "med"), keys)
        .groupBy(*keys, "med", F.abs(F.col("v") - F.col("med")).alias("_d"))
        .agg(F.sum("n").alias("n")).withColumnRenamed("_d", "v")
    )
    return quantiles_of_counts(dev, [*keys, "med"], {"mad": 0.5}).select(*keys, "n", "med", "mad")
