"""Row filters."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..params import PRACTICE


def before_target(history_date: Column, target_date: Column) -> Column:
    """Strict point-in-time cut: rows of the same day never count."""
    return history_date < target_date


def sessions(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("session_type").isin(*types))


def practice_laps(laps: DataFrame, keep_pit_laps: bool = False) -> DataFrame:
    """Accurate timed practice laps; the older feature set keeps pit laps."""
    out = sessions(laps, *PRACTICE).where(F.col("is_accurate") & F.col("lap_time").isNotNull())
    return out if keep_pit_laps else out.where(~F.col("is_pit_in") & ~F.col("is_pit_out"))


STINT = ["event_id", "driver_id", "session_type", "stint", "compound"]


def long_run_laps(clean: DataFrame, *types: str, minimum: int = 5) -> DataFrame:
    """Laps of stints with at least ``minimum`` usable laps.

    The stint sizes are a partial aggregate joined back, so a driver with very many
    laps is counted map-side and the join may be split, instead of one buffered window.
    """
    usable = sessions(clean, *types).dropna(subset=["compound", "stint", "tyre_life", "lap_time"])
    sizes = usable.groupBy(*STINT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum).drop("n")
    return usable.join(sizes, STINT, "left_semi")


def uncollected(session_df: DataFrame, status: DataFrame, include_failed: bool = False,
                year: int | None = None, round_no: int | None = None) -> DataFrame:
    """Sessions without a completed (nor, unless asked, failed) status row."""
    done = ["completed"] if include_failed else ["completed", "failed"]
    out = session_df.join(status.where(F.col("status").isin(*done)).select("session_id"), "session_id", "left_anti")
    if year is not None:
        out = out.where(F.col("season_year") == year)
    return out if round_no is None else out.where(F.col("round_no") == round_no)


def seasons(events: DataFrame, years: list[int], min_events: int | None = None) -> DataFrame:
    """Events of the given seasons; raises when there are fewer than ``min_events``."""
    out = events.where(F.col("season_year").isin(*years))
    if min_events is not None and out.limit(min_events).count() < min_events:
        raise ValueError(f"need at least {min_events} events in seasons {years}")
    return out


def overdue(session_df: DataFrame, status: DataFrame, now: dt.date) -> DataFrame:
    """Past sessions that are not completed; a missing status counts as pending."""
    s = F.coalesce(F.col("status"), F.lit("pending"))
    return (session_df.where(F.col("event_date") < F.lit(now))
            .join(status.select("session_id", "status"), "session_id", "left")
            .withColumn("status", s).where(s != "completed"))
