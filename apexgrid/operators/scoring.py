"""Fantasy scoring: line items of drivers and constructors, totals, line-up scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import params as P
from ..functions import scalars as S
from . import windows as W

ITEM = "struct<event_type:string,scoring_item:string,frequency:bigint,position:bigint,points:bigint>"


def _item(kind, name, points, frequency=None, position=None) -> Column:
    big = lambda x: (F.lit(None) if x is None else x).cast("bigint")
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(kind).alias("event_type"), as_col(name).alias("scoring_item"), big(frequency).alias("frequency"),
                    big(position).alias("position"), as_col(points).cast("bigint").alias("points"))


def _emit(df: DataFrame, items: list[Column], keep: list[str]) -> DataFrame:
    """One output row per non-null item; rows without items disappear."""
    return df.select(*keep, F.explode(F.filter(F.array(*items), lambda i: i.isNotNull())).alias("_i")).select(*keep, "_i.*")


def race_items(results: DataFrame, overtakes: DataFrame, keep: list[str]) -> DataFrame:
    """Line items of race and sprint results."""
    race = F.col("session_type") == "R"
    kind = F.when(race, "race").otherwise("sprint")
    label = F.when(race, "Race").otherwise("Sprint")
    pos, grid = F.col("position"), F.col("grid_position")
    dsq = S.dsq(F.col("classified_position"))
    dnf = ~dsq & S.dnf_for_scoring(pos, F.col("status"))
    ran = ~dsq & ~dnf
    pts = F.when(race, S.race_points(pos)).otherwise(S.sprint_points(pos))
    df = results.join(overtakes.withColumn("session_type", F.lit("R")), ["event_id", "driver_id", "session_type"], "left")
    return _emit(df, [
        F.when(dsq, _item(kind, F.concat(label, F.lit(" DSQ")), P.DSQ_POINTS)),
        F.when(dnf, _item(kind, F.concat(label, F.lit(" DNF")), P.DNF_POINTS)),
        F.when(ran & (pts > 0), _item(kind, F.concat(label, F.lit(" Position")), pts, None, pos)),
        F.when(ran & (grid > pos), _item(kind, "Positions Gained", grid - pos, grid - pos)),
        F.when(ran & (grid < pos), _item(kind, "Positions Lost", grid - pos, pos - grid)),
        F.when(ran & (F.col("fastest_lap_rank") == 1), _item(kind, "Fastest Lap", P.FASTEST_LAP_POINTS)),
        F.when(ran & (F.col("overtakes") > 0), _item(kind, "Overtake Bonus", F.col("overtakes"), F.col("overtakes"))),
    ], keep)


def quali_items(results: DataFrame, keep: list[str]) -> DataFrame:
    """Line items of qualifying and sprint qualifying results."""
    main = F.col("session_type") == "Q"
    kind = F.when(main, "qualifying").otherwise("sprint_qualifying")
    label = F.when(main, "Qualifying").otherwise("Sprint Qualifying")
    pos = F.col("position")
    ok = ~S.dsq(F.col("classified_position"))
    no_time = ok & pos.isNull() & S.classified(F.col("status"))
    pts = S.quali_points(pos)
    lost = F.when(main, P.QUALI_NO_TIME_POINTS).otherwise(P.SPRINT_QUALI_NO_TIME_POINTS)
    return _emit(results, [
        F.when(ok & (pts > 0), _item(kind, F.concat(label, F.lit(" Position")), pts, None, pos)),
        F.when(no_time, _item(kind, F.concat(label, F.lit(" No Time")), lost)),
    ], keep)


def driver_items(results: DataFrame, race_laps: DataFrame, keep: list[str]) -> DataFrame:
    racing = results.where(F.col("session_type").isin("R", "S"))
    timed = results.where(F.col("session_type").isin("Q", "SQ"))
    return race_items(racing, W.overtakes(race_laps), keep).unionByName(quali_items(timed, keep))


def progression_items(results: DataFrame, team_keys: list[str], shared_list: bool = False) -> DataFrame:
    """One Q-progression row per team and event.

    Default: the primary session only (Q, else SQ).  ``shared_list`` counts both sessions
    of a weekend in one list, as the older scorer does.
    """
    timed = results.where(F.col("session_type").isin("Q", "SQ"))
    per = timed.groupBy(*team_keys, "session_type").agg(
        F.count_if(F.col("position") <= 10).alias("q3"), F.count_if(F.col("position").between(11, 15)).alias("q2"))
    if shared_list:
        per = per.groupBy(*team_keys).agg(F.sum("q3").alias("q3"), F.sum("q2").alias("q2"))
    else:
        best = F.min_by(F.struct("q3", "q2"), F.when(F.col("session_type") == "Q", 0).otherwise(1)).alias("b")
        per = per.groupBy(*team_keys).agg(best).select(*team_keys, "b.*")
    return per.select(*team_keys, _item("qualifying", "Q Progression", S.progression_points(F.col("q3"), F.col("q2"))).alias("_i")).select(*team_keys, "_i.*")


def constructor_items(driver_rows: DataFrame, results: DataFrame, team_keys: list[str], shared_list: bool = False) -> DataFrame:
    """Race and sprint items of both cars under the team, plus the progression row."""
    cars = driver_rows.where(F.col("event_type").isin("race", "sprint")).withColumn(
        "scoring_item", F.concat(F.col("code").cast("string"), F.lit(": "), F.col("scoring_item")))
    cols = [*team_keys, "event_type", "scoring_item", "frequency", "position", "points"]
    return cars.select(*cols).unionByName(progression_items(results, team_keys, shared_list).select(*cols))


def season_scores(results: DataFrame, race_laps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of all seasons at once, stamped with event and running season totals."""
    keep = ["event_id", "season_id", "round_no", "driver_id", "code", "team_id"]
    drivers = driver_items(results, race_laps, keep)
    teams = constructor_items(drivers, results, ["event_id", "season_id", "round_no", "team_id"])
    stamp = lambda df, who: W.stamp_season_total(W.stamp_event_total(df, who), who)
    return stamp(drivers, "driver_id"), stamp(teams, "team_id")


def lineup_points(lineups: DataFrame, totals: DataFrame, team_totals: DataFrame, key: list[str]) -> DataFrame:
    """Points of every line-up: cars, teams, and the boosted car once more; missing ids score 0."""
    cars = lineups.select(*key, "boost_id", F.explode("driver_ids").alias("driver_id"))
    car_pts = cars.join(totals.select("event_id", "driver_id", "race_total"), ["event_id", "driver_id"], "left").select(
        *key, (F.coalesce("race_total", F.lit(0)) * F.when(F.col("driver_id") == F.col("boost_id"), 2).otherwise(1)).alias("p"))
    team_pts = lineups.select(*key, F.explode("team_ids").alias("team_id")).join(
        team_totals.select("event_id", "team_id", "race_total"), ["event_id", "team_id"], "left").select(*key, F.coalesce("race_total", F.lit(0)).alias("p"))
    return car_pts.unionByName(team_pts).groupBy(*key).agg(F.sum("p").cast("double").alias("actual_points"))
