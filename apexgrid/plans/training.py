"""Training sets: features beside what happened, for all events in one frame.

Events are numbered once, from the event table, in training sets and in the field to predict alike. A weekend without a
usable result keeps its number, so "events before i" never holds weekend i.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, joins as J, windows as W
from . import features as FS

KEYS = FS.KEYS


def numbered(df: DataFrame, events: DataFrame) -> DataFrame:
    """``df`` with the calendar's event index."""
    return df.join(W.event_index(events.select("event_id", "event_date"), []).select("event_id", "event_index"), "event_id")


def race_training_set(feats: DataFrame, race: DataFrame, totals: DataFrame, events: DataFrame) -> DataFrame:
    """Finishing position (null dropped) and points: the real total, else the position estimate."""
    y = race.where(F.col("position").isNotNull()).select(*KEYS, F.col("position").cast("double").alias("y_position"), S.race_points(F.col("position")).alias("_est"))
    t = totals.select(*KEYS, F.col("race_total").cast("double").alias("_t"))
    df = feats.join(y, KEYS).join(t, KEYS, "left").withColumn("y_points", F.coalesce("_t", "_est")).drop("_t", "_est")
    return numbered(df, events)


def quali_training_set(feats: DataFrame, quali: DataFrame, scores: DataFrame, events: DataFrame) -> DataFrame:
    """Qualifying position and the sum of its items, else the top-ten estimate; events without Q drop out."""
    y = quali.where(F.col("position").isNotNull()).select(*KEYS, F.col("position").cast("double").alias("y_position"), S.quali_points(F.col("position")).alias("_est"))
    t = A.points_of(scores, "qualifying").select(*KEYS, F.col("points").cast("double").alias("_t"))
    df = feats.join(y, KEYS).join(t, KEYS, "left").withColumn("y_points", F.coalesce("_t", "_est")).drop("_t", "_est")
    return numbered(df, events)
