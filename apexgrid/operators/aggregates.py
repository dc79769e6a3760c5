"""Grouped aggregates; all are partial aggregates, so hot keys are reduced map-side."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_totals(scores: DataFrame, entity: str, value: str = "race_total") -> DataFrame:
    """One total per entity and event; the total repeats on every line item."""
    return scores.groupBy("event_id", entity).agg(F.max(value).alias("race_total"))


def points_of(scores: DataFrame, *event_types: str) -> DataFrame:
    return scores.where(F.col("event_type").isin(*event_types)).groupBy("event_id", "driver_id").agg(F.sum("points").alias("points"))


def coverage(session: DataFrame, status: DataFrame, now, results: DataFrame, laps: DataFrame, weather: DataFrame) -> DataFrame:
    """Per season: sessions in total, past, completed, failed, pending, and with data of each kind."""
    have = lambda df, n: df.select("session_id").distinct().withColumn(n, F.lit(1))
    j = session.join(status.select("session_id", "status"), "session_id", "left")
    for df, n in ((results, "with_results"), (laps, "with_laps"), (weather, "with_weather")):
        j = j.join(have(df, n), "session_id", "left")
    done, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return j.groupBy("season_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_date") < F.lit(now)).alias("past"),
        done.alias("completed"), bad.alias("failed"), (F.count(F.lit(1)) - done - bad).alias("pending"),
        *[F.count(n).alias(n) for n in ("with_results", "with_laps", "with_weather")])


def events_with_data(season: str, **frames: DataFrame) -> DataFrame:
    """Distinct events per season in each frame; 0 where a frame has none."""
    out = None
    for name, df in frames.items():
        g = df.groupBy(season).agg(F.count_distinct("event_id").alias(name))
        out = g if out is None else out.join(g, season, "full")
    return out.fillna(0, subset=list(frames))


def metric_summary(races: DataFrame, by: list[str]) -> DataFrame:
    """Means of the errors; sums skip nulls and stay null when everything is null."""
    return races.groupBy(*by).agg(
        F.count(F.lit(1)).alias("races"), F.avg("mae_position").alias("mae_position"), F.avg("mae_points").alias("mae_points"),
        F.sum("lineup_actual").alias("lineup_actual"), F.sum("optimal_actual").alias("optimal_actual"),
        (F.sum("optimal_actual") - F.sum("lineup_actual")).alias("left_on_table"))


def best_configs(runs: DataFrame, config: str = "config_id") -> DataFrame:
    return runs.agg(F.min_by(config, "mae_position").alias("best_mae_config"), F.min("mae_position").alias("best_mae"),
                    F.max_by(config, "lineup_actual").alias("best_points_config"), F.max("lineup_actual").alias("best_points"))


def price_moves(prices: DataFrame, entity: str) -> DataFrame:
    """First and last price of a season and the net change."""
    return prices.groupBy("season_id", entity).agg(
        F.min_by("price", "round_no").alias("first_price"), F.max_by("price", "round_no").alias("last_price")
    ).withColumn("net", F.round(F.col("last_price") - F.col("first_price"), 1))


def price_matrix(prices: DataFrame, entity: str, rounds: list[int]) -> DataFrame:
    """One row per entity, one cell per round, null when absent."""
    return prices.groupBy("season_id", entity).pivot("round_no", rounds).agg(F.first("price"))
