"""Window operators over results, laps, scores and line-ups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def event_index(events: DataFrame, group: list[str], out: str = "event_index") -> DataFrame:
    """0-based position of an event date in its calendar (per ``group``, or overall).

    Overall numbering works on the distinct dates only: one row per race weekend.
    """
    keys = [*group, "event_date"]
    dates = events.select(*keys).distinct()
    w = Window.partitionBy(*group).orderBy("event_date")
    return events.join(dates.withColumn(out, (F.row_number().over(w) - 1).cast("bigint")), keys)


def group_sizes(df: DataFrame, index: str = "event_index") -> DataFrame:
    return df.groupBy(index).agg(F.count(F.lit(1)).alias("n"))


LAP_BLOCK = 1000


def overtakes(laps: DataFrame, block: int = LAP_BLOCK) -> DataFrame:
    """Positions gained lap to lap where neither lap is a pit lap, per (event, driver).

    Lap numbers are cut into blocks: neighbours are compared inside a block, then block
    ends with the next block's start, so no single window holds all laps of a driver.
    """
    keys = ["event_id", "driver_id"]
    lap = F.struct(F.col("position"), (F.col("is_pit_in") | F.col("is_pit_out")).alias("pit"))
    rows = laps.select(*keys, "lap_number", F.floor(F.col("lap_number") / block).alias("blk"), lap.alias("lap"))

    def gain(prev: Column, cur: Column) -> Column:
        ok = ~prev["pit"] & ~cur["pit"]
        return F.when(ok, F.greatest(prev["position"] - cur["position"], F.lit(0))).otherwise(0)

    inner = F.lag("lap").over(Window.partitionBy(*keys, "blk").orderBy("lap_number"))
    blocks = (rows.withColumn("g", F.coalesce(gain(inner, F.col("lap")), F.lit(0)))
              .groupBy(*keys, "blk").agg(F.sum("g").alias("g"), F.min_by("lap", "lap_number").alias("head"),
                                         F.max_by("lap", "lap_number").alias("tail")))
    before = F.lag("tail").over(Window.partitionBy(*keys).orderBy("blk"))
    edge = F.coalesce(gain(before, F.col("head")), F.lit(0))
    return blocks.withColumn("g", F.col("g") + edge).groupBy(*keys).agg(F.sum("g").alias("overtakes"))


def stamp_event_total(scores: DataFrame, entity: str = "driver_id") -> DataFrame:
    """Sum of points per (entity, event) on every line item (a handful of items each)."""
    return scores.withColumn("race_total", F.sum("points").over(Window.partitionBy(entity, "event_id")))


def stamp_season_total(scores: DataFrame, entity: str = "driver_id") -> DataFrame:
    """Running season total in round order on every line item; ``entity`` ids are per season."""
    per_event = scores.groupBy(entity, "event_id", "round_no").agg(F.sum("points").alias("t"))
    w = Window.partitionBy(entity).orderBy("round_no").rowsBetween(Window.unboundedPreceding, 0)
    return scores.join(per_event.select(entity, "event_id", F.sum("t").over(w).alias("season_total")), [entity, "event_id"])


def rolling_value(scored: DataFrame, entity: str, n: int = 3) -> DataFrame:
    """Mean points per million over the last up to ``n`` scored events, this one included."""
    w = Window.partitionBy(entity).orderBy("event_date").rowsBetween(-(n - 1), 0)
    ratio = F.col("race_total") / F.nullif(F.col("price").cast("double"), F.lit(0.0))
    return scored.withColumn("avg_ppm", F.coalesce(F.avg(ratio).over(w), F.lit(0.0)))


def transfers(lineups: DataFrame, group: list[str], order: str = "round_no") -> DataFrame:
    """Cars and teams that are new against the previous line-up; 0 for the first."""
    w = Window.partitionBy(*group).orderBy(order)

    def new(c):
        prev = F.lag(c).over(w)
        return F.when(prev.isNull(), 0).otherwise(F.size(F.array_except(c, prev)))

    return lineups.withColumn("n_transfers", new("driver_ids") + new("team_ids"))


def latest_per(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
