"""Joins with the reference semantics of lookup misses and first matches."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .filters import PRACTICE


def stable_code(teams: DataFrame, alias: dict[str, str], name: str = "team_name") -> DataFrame:
    """Stable team code: renamed teams share one code, unknown names stay themselves."""
    pairs = F.create_map(*[F.lit(x) for kv in alias.items() for x in kv])
    return teams.withColumn("stable_code", F.coalesce(F.try_element_at(pairs, F.col(name)), F.col(name)))


def by_name(rows: DataFrame, names: DataFrame, row_name: str, name: str, key: str, within: list[str]) -> DataFrame:
    """Join on a name ignoring case inside ``within``; the lowest key wins; misses keep a null key."""
    first = names.groupBy(*within, F.lower(F.col(name)).alias("_n")).agg(F.min(key).alias(key))
    return rows.withColumn("_n", F.lower(F.col(row_name))).join(first, [*within, "_n"], "left").drop("_n")


def with_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, float]) -> DataFrame:
    """Left join whose misses give the documented constant."""
    return left.join(right, on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def first_containing(rows: DataFrame, events: DataFrame, text: str, within: list[str]) -> DataFrame:
    """First event (by round) of the season whose name contains ``text``, ignoring case.

    The calendar is pre-grouped per season into one short array, so the lookup is an
    equi-join on the season and a search inside the array, not a theta join.
    """
    calendar = events.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("round_no", "event_id", F.lower("event_name").alias("n")))).alias("_cal"))
    hits = F.filter("_cal", lambda e: F.contains(e["n"], F.lower(F.col(text))))
    return rows.join(calendar, within, "left").withColumn("event_id", F.try_element_at(hits, F.lit(1))["event_id"]).drop("_cal")


def matched(pred: DataFrame, actual: DataFrame) -> DataFrame:
    """Predictions with an actual position and actual points."""
    a = actual.where(F.col("position").isNotNull() & F.col("actual_points").isNotNull())
    return pred.join(a.select("event_id", "driver_id", F.col("position").cast("double").alias("actual_position"), F.col("actual_points").cast("double").alias("actual_points")), ["event_id", "driver_id"])


def session_actuals(results: DataFrame, scores: DataFrame, session_type: str, event_types: list[str]) -> DataFrame:
    """Actual position of one session with the points of its own items, 0 when there are none."""
    pts = (scores.where(F.col("event_type").isin(*event_types)).groupBy("event_id", "driver_id")
           .agg(F.sum("points").cast("double").alias("actual_points")))
    r = results.where((F.col("session_type") == session_type) & F.col("position").isNotNull())
    return with_default(r.select("event_id", "driver_id", "position"), pts, ["event_id", "driver_id"], {"actual_points": 0.0})


def teammate(drivers: DataFrame) -> DataFrame:
    """Each season driver with the teammate of lowest id; alone in the team: no row."""
    crew = drivers.groupBy("team_id").agg(F.array_sort(F.collect_set("driver_id")).alias("_crew"))
    other = F.try_element_at(F.filter("_crew", lambda d: d != F.col("driver_id")), F.lit(1))
    return (drivers.join(crew, "team_id").withColumn("mate_id", other)
            .withColumn("team_size", F.size("_crew")).where(F.col("mate_id").isNotNull()).drop("_crew"))


def wet_sessions(weather: DataFrame, *types: str) -> DataFrame:
    """(weekend, session) pairs with any rain."""
    return (weather.where(F.col("rainfall") & F.col("session_type").isin(*types))
            .select("weekend_id", "session_type").distinct())


def priced(pred: DataFrame, prices: DataFrame) -> DataFrame:
    """Predictions that have a price at the event."""
    return pred.join(prices.select("event_id", "driver_id", "price"), ["event_id", "driver_id"])


def team_rollup(cprices: DataFrame, drivers: DataFrame, pred: DataFrame, values: list[str]) -> DataFrame:
    """Priced teams with the sum of their drivers' predictions, 0 when there are none."""
    per_team = pred.join(drivers.select("driver_id", F.col("team_id").alias("_t")), "driver_id").groupBy("event_id", F.col("_t").alias("team_id"))
    sums = per_team.agg(*[F.sum(c).alias(c) for c in values])
    return with_default(cprices.select("event_id", "team_id", "price"), sums, ["event_id", "team_id"], {c: 0.0 for c in values})


def walk_forward(events: DataFrame, min_train: int) -> DataFrame:
    """(test index, train size) of every split of a calendar with an ``event_index``."""
    idx = events.select("event_index").distinct()
    return idx.where(F.col("event_index") >= min_train).select(
        F.col("event_index").alias("test_index"), F.col("event_index").alias("n_train"))
