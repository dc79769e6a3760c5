"""Sorts, limits and top-k."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_set(df: DataFrame, group: list[str], order: list[Column], k: int = 10) -> DataFrame:
    """First ``k`` rows per group; empty for groups with fewer than ``k`` rows."""
    w = Window.partitionBy(*group)
    return (df.withColumns({"_n": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy(*order))})
            .where((F.col("rank") <= k) & (F.col("_n") >= k)).drop("_n"))


def first_by(df: DataFrame, group: list[str], order: str, columns: list[str], latest: bool = True) -> DataFrame:
    """The row with the largest (or smallest) ``order`` per group, as one aggregate."""
    pick = (F.max_by if latest else F.min_by)(F.struct(*columns), order).alias("_s")
    return df.groupBy(*group).agg(pick).select(*group, "_s.*")


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> tuple[DataFrame, DataFrame]:
    """Rows of one page, and a one-row frame telling whether more follow."""
    rest = df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    more = rest.agg((F.count(F.lit(1)) > size).alias("has_more"))
    return rest.limit(size), more


def cheapest_sum(prices: DataFrame, group: list[str], k: int = 2) -> DataFrame:
    """Sum of the ``k`` lowest prices per group."""
    w = Window.partitionBy(*group).orderBy("price")
    return prices.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).groupBy(*group).agg(F.sum("price").alias("reserve"))
