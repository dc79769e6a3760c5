"""Point-in-time history: what was known strictly before (or up to) a target date.

Spine rows (entity, target event) and fact rows share one frame, so each entity is
shuffled once.  Facts are numbered by how many facts lie on earlier days; a RANGE
frame over that number then holds exactly the last ``n`` facts: bounded state, no
range join, and rows of the target day can not leak, whatever their order.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

UP = Window.unboundedPreceding


def day(date: Column) -> Column:
    return F.unix_date(date)


def stack(spine: DataFrame, **facts: DataFrame) -> DataFrame:
    """Union of the spine and the fact frames.

    Fact frames carry the entity key columns, ``day`` and value columns; the values
    become one struct column named after the keyword (null on all other rows).
    """
    shared = [c for c in spine.columns]
    parts = [spine.withColumn("is_spine", F.lit(True))]
    for name, df in facts.items():
        values = [c for c in df.columns if c not in shared or c == "day"]
        keys = [c for c in df.columns if c in shared]
        parts.append(df.select(*keys, F.struct(*values).alias(name), F.lit(False).alias("is_spine")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_days(df: DataFrame, entity: list[str], key: list[str], facts: list[str]) -> DataFrame:
    """One row per (key, day): the spine columns and facts of that day side by side.

    The frame is partitioned by ``entity`` once; this aggregate and every window over
    keys that contain the entity then run without another shuffle.
    """
    rest = [c for c in df.columns if c not in (*entity, *key, "day", *facts, "is_spine")]
    keep = [F.max(c).alias(c) for c in rest] + [F.first(c, ignorenulls=True).alias(c) for c in facts]
    return df.repartition(*entity).groupBy(*dict.fromkeys([*entity, *key, "day"])).agg(*keep, F.max("is_spine").alias("is_spine"))


def before(key: list[str]) -> Window:
    """All rows of the entity on strictly earlier days."""
    return Window.partitionBy(*key).orderBy("day").rangeBetween(UP, -1)


def up_to(key: list[str]) -> Window:
    """All rows of the entity up to and including the day."""
    return Window.partitionBy(*key).orderBy("day").rangeBetween(UP, 0)


def last(key: list[str], number: str, n: int) -> Window:
    """Frame of the last ``n`` facts, where ``number`` counts the facts on earlier days."""
    return Window.partitionBy(*key).orderBy(number).rangeBetween(-n, -1)


def last_n(df: DataFrame, key: list[str], fact: str, n: int, out: str) -> DataFrame:
    """Array ``out`` of the last ``n`` facts before each row's day, oldest first.

    (key, day) must be unique among the facts, as a session result is.
    """
    num = f"_no_{out}"
    df = df.withColumn(num, F.count(fact).over(before(key)))
    return df.withColumn(out, F.collect_list(fact).over(last(key, num, n))).drop(num)


def asof_latest(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Latest right row at or before the left row's day (inclusive)."""
    both = stack(left, fact=right.select(*key, "day", *values))
    got = both.withColumn("_f", F.last("fact", ignorenulls=True).over(up_to(key))).where("is_spine")
    return got.select(*left.columns, *[F.col(f"_f.{c}").alias(c) for c in values])


def asof_nearest(left: DataFrame, right: DataFrame, values: list[str], key: list[str] | None = None) -> DataFrame:
    """First right row on or after the left row's day, else the latest before it.

    ``key`` limits the search to one calendar.  A calendar is one row per event date, so
    the right side is a short sorted array per key and the search is a map-side filter.
    """
    key = key or []
    dates = F.array_sort(F.collect_list(F.struct("day", *values))).alias("_cal")
    # without a key there is one calendar: a scalar subquery, evaluated once
    j = left.join(right.groupBy(*key).agg(dates), key, "left") if key else left.withColumn("_cal", right.agg(dates).scalar())
    nxt = F.try_element_at(F.filter("_cal", lambda e: e["day"] >= F.col("day")), F.lit(1))
    prev = F.try_element_at(F.filter("_cal", lambda e: e["day"] < F.col("day")), F.lit(-1))
    return j.withColumn("_f", F.coalesce(nxt, prev)).select(*left.columns, *[F.col(f"_f.{c}").alias(c) for c in values])


def history_pairs(spine: DataFrame, facts: DataFrame, key: list[str], n: int) -> DataFrame:
    """The defining form: range join and row number.  Kept to test the windowed form."""
    f = facts.withColumnRenamed("day", "fact_day")
    w = Window.partitionBy(*key, "event_id").orderBy(F.col("fact_day").desc())
    return spine.join(f, key).where(F.col("fact_day") < F.col("day")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
