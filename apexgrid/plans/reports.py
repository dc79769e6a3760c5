"""Report frames."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import aggregates as A, filters as FL, nested as N, topk as K, windows as W


def season_dashboard(lineups: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Submitted line-ups beside the latest recommendation of the event."""
    latest = W.latest_per(recommendations, ["event_id"], F.col("created_at").desc(), F.col("rec_id").desc())
    df = W.transfers(lineups, ["season_id"]).join(latest.select("event_id", "ml_predicted", "ml_actual", "oracle"), "event_id", "left")
    return df.withColumns({"left_on_table": F.col("oracle") - F.col("actual_points"),
                           "beat_ml": F.coalesce(F.col("actual_points") > F.col("ml_actual"), F.lit(False))})


def season_totals(dashboard: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return dashboard.groupBy("season_id").agg(
        z("actual_points").alias("my_total"), z("ml_actual").alias("ml_total"), z("oracle").alias("oracle_total"),
        (z("actual_points") - z("ml_actual")).alias("vs_ml"), (z("actual_points") - z("oracle")).alias("vs_oracle"),
        F.count_if("beat_ml").alias("races_beat"))


def race_sheet(pred: DataFrame, prices: DataFrame) -> DataFrame:
    """Predictions of an event with prices, best first."""
    w = Window.partitionBy("event_id").orderBy(F.col("predicted_points").desc(), "driver_id")
    return (pred.join(prices.select("event_id", "driver_id", "price", "price_change"), ["event_id", "driver_id"], "left")
            .withColumn("sheet_rank", F.row_number().over(w)))


def lineup_diff(current: DataFrame, recommended: DataFrame) -> DataFrame:
    r = recommended.select("event_id", F.col("driver_ids").alias("new_drivers"), F.col("team_ids").alias("new_teams"))
    df = current.join(r, "event_id")
    return N.difference(N.difference(df, "driver_ids", "new_drivers", "drivers"), "team_ids", "new_teams", "teams")


def price_trajectory(prices: DataFrame, entity: str, rounds: list[int]) -> DataFrame:
    return A.price_moves(prices, entity).join(A.price_matrix(prices, entity, rounds), ["season_id", entity])


def session_list(session: DataFrame, status: DataFrame, gaps_only: bool = False) -> DataFrame:
    df = session.join(status.select("session_id", "status"), "session_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return df.where(F.col("status") != "completed") if gaps_only else df


def next_event(events: DataFrame, today: dt.date, grace_days: int = 3) -> DataFrame:
    """Per championship: first event not more than ``grace_days`` old, else the latest one."""
    start = F.lit(today - dt.timedelta(days=grace_days))
    live = F.min(F.when(F.col("event_date") >= start, F.struct("event_date", "event_id")))
    return events.groupBy("series").agg(F.coalesce(live, F.max(F.struct("event_date", "event_id"))).alias("_e")).select(
        "series", F.col("_e.event_id").alias("event_id"))


def gaps(session: DataFrame, status: DataFrame, now: dt.date) -> DataFrame:
    return FL.overdue(session, status, now)


def runs_page(runs: DataFrame, number: int, size: int = 25) -> DataFrame:
    return K.page(runs, [F.col("created_at").desc(), F.col("run_id").desc()], number, size)[0]
