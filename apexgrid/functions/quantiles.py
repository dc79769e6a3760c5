"""Exact medians and weighted quantiles that survive a group holding a third of all rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

#: Ranks that bracket the median, and the accuracy of their estimate: the bracket is ten times as wide as its error.
BRACKET, ACCURACY = (0.499, 0.501), 10_000


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median of ``value`` per ``keys``, by selection, in the same way for groups of any size.

    A mergeable sketch brackets the middle ranks by two values of the group. Values under the bracket are only counted, those
    above it are left out; what lies within, about two thousandths of a group, is counted by value and ordered. The counts
    are exact, so the median is.
    """
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    bracket = df.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*map(F.lit, BRACKET)), ACCURACY).alias("_q"), F.count(F.lit(1)).alias("_rows"))
    within = F.when(F.col("_v") >= F.col("_q")[0], F.col("_v"))
    counts = df.join(bracket, keys).where(F.col("_v") <= F.col("_q")[1]).groupBy(*keys, "_rows", within.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    last = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    lo, hi = F.floor((F.col("_rows") + 1) / 2), F.floor(F.col("_rows") / 2) + 1

    def at(r):
        return F.max(F.when((F.col("_first") <= r) & (r <= F.col("_last")), F.col("_x")))

    return ranked.groupBy(*keys).agg(((at(lo) + at(hi)) / 2).alias(out))


#: Digits that a doubling of a value's size is cut into when weighted ranks are bracketed.
DIGITS = 256


def _digit(v: Column) -> Column:
    """A whole number that never falls while ``v`` grows: sign and logarithm, finer near large values."""
    return (F.signum(v) * F.floor(DIGITS * F.log2(1 + F.abs(v) * 1e6))).cast("bigint")


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, shares: tuple[float, ...], out: str) -> DataFrame:
    """``out``: per ``keys`` the smallest values up to which at least these shares of the weight lie, as an array.

    Exact, by selection: weights are summed by digit first, which brackets each quantile by one digit and gives the weight
    under it; only values of such digits are summed by value and put in order. Weights may span any range. Rows without a value, a key or a
    positive weight do not count.
    """
    df = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")) \
        .withColumn("_d", _digit(F.col("_v")))
    digits = df.groupBy(*keys, "_d").agg(F.sum("_w").alias("_w"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    # the slack keeps sums of equal weights from missing a share by rounding
    need = F.col("_share") * F.col("_all") * (1 - 1e-12)
    shared = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(q)).alias("_share")) for i, q in enumerate(shares)]))
    cut = digits.withColumns({"_upto": F.sum("_w").over(upto), "_all": F.sum("_w").over(whole)}).withColumn("_q", shared).select("*", "_q.*") \
        .where(F.col("_upto") >= need) \
        .groupBy(*keys, "_i").agg(F.min(F.struct("_d", (F.col("_upto") - F.col("_w")).alias("_under"), "_share", "_all")).alias("_b")).select(*keys, "_i", "_b.*")
    cut = stage(cut, "digits")  # few rows: written, so that the join knows
    inside = df.join(cut, [*keys, "_d"]).groupBy(*keys, "_i", "_under", "_share", "_all", "_v").agg(F.sum("_w").alias("_w"))
    run = F.col("_under") + F.sum("_w").over(Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("_v").over(Window.partitionBy(*keys, "_i"))
    found = inside.withColumns({"_run": run, "_last": last}).where((F.col("_run") >= need) | (F.col("_v") == F.col("_last"))) \
        .groupBy(*keys, "_i").agg(F.min("_v").alias("_v"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias(out))
