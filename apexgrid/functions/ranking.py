"""Rank helpers.  Groups are event fields or standings of one season: their size is
the number of entrants, which the rules bound, not the number of laps or events."""
from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def ordinal_rank(group: list[str], *order: Column) -> Column:
    """1-based rank, ties broken by the last ordering key."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")


def average_rank(group: list[str], value: str, ascending: bool = True) -> Column:
    """Mean rank of ties; rows without a value have no rank."""
    v = F.col(value)
    key = v.asc_nulls_last() if ascending else v.desc_nulls_last()
    first = F.rank().over(Window.partitionBy(*group).orderBy(key))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return F.when(v.isNotNull(), first + (ties - 1) / F.lit(2.0))


def rank_or_last(group: list[str], value: str, tie: str, empty: float = 10.0) -> Column:
    """Ordinal rank; a missing value is last + 1; a group without any value gets ``empty``."""
    n = F.count(value).over(Window.partitionBy(*group))
    r = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last(), F.col(tie)))
    return F.when(n == 0, F.lit(empty)).when(F.col(value).isNull(), (n + 1).cast("double")).otherwise(r.cast("double"))
