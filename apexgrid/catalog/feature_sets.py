"""Queries for point-in-time history, feature columns, feature sets and training sets."""
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions.ranking import average_rank, ordinal_rank, rank_or_last
from ..operators import filters as FL, history as H, joins as J
from ..plans import features as FS
from .oracle_views import avg_rank, rank_last
from .registry import query

KEYS = ["event_id", "driver_id"]


def _drivers(v):
    return FS.driver_columns(FS.driver_history(FS.Tables.of(v)))


def _columns(name: str, view: str, cols: str, make, keys="event_id driver_id"):
    """Register a query for columns of one feature frame against one oracle view."""
    cs = cols.split()

    @query(name, f"SELECT {', '.join(keys.split() + cs)} FROM {view}", d=cols)
    def _(v):
        return make(v).select(*keys.split(), *cs)


_columns("wn01_recent_position_means", "o_form", "position_mean_last3 position_mean_last5", _drivers)
_columns("wn02_recent_position_std", "o_form", "position_std_last5", _drivers)
_columns("wn03_dnf_rate", "o_form", "dnf_rate_last10", _drivers)
_columns("wn04_positions_gained", "o_form", "positions_gained_mean_last5", _drivers)
_columns("jn04_latest_price_signal", "o_signal", "pick_percentage price_change_last_race", _drivers)
_columns("jn06_circuit_history", "o_circuit", "circuit_position_mean_last3", _drivers)
_columns("jn12_shared_races_gap", "o_gap", "driver_vs_teammate_gap_last5", _drivers)
_columns("ag04_career_starts", "o_wet", "driver_races", _drivers)
_columns("ag05_wet_starts", "o_wet", "driver_wet_session_count", _drivers)
_columns("ag06_wet_vs_dry_delta", "o_wet", "driver_wet_vs_dry_position_delta", _drivers)
_columns("ag16_points_trend", "o_points", "fantasy_points_mean_last3 fantasy_points_trend_last5", _drivers)
_columns("wn06_last5_form", "o_last5", "position_last1 position_slope best_position_last5 quali_last1 quali_slope", _drivers)
_columns("wn07_team_best_and_delta", "o_last5_team", "team_best_position teammate_delta", lambda v: FS.field_columns(FS.Tables.of(v), _drivers(v)))
_columns("wn05_team_form", "o_team_form", "team_position_mean_last5", lambda v: FS.team_frame(FS.Tables.of(v)), "event_id team_id")
_columns("ag10_downforce_split", "o_down", "team_low_df_avg_pos team_high_df_avg_pos", lambda v: FS.downforce(FS.Tables.of(v)), "event_id team_code")
_columns("ag08_ag09_circuit_weather", "o_weather", "circuit_historical_rain_rate track_temp_deviation_from_circuit_mean",
         lambda v: FS.circuit_weather(v.b_spine, v.b_weather), "weekend_id")
_columns("ag07_practice_weather", "o_weather", "weather_practice_rainfall weather_practice_rain_fraction weather_track_temp_mean weather_air_temp_mean",
         lambda v: FS.circuit_weather(v.b_spine, v.b_weather), "weekend_id")
_columns("wn13_practice_ranks", "o_pace", "practice_best_lap_rank practice_avg_best_5_rank", lambda v: FS.practice_frame(FS.Tables.of(v)))
_columns("ag13_sector_ranks", "o_fp", "fp_sector1_rank fp_sector2_rank fp_sector3_rank", lambda v: FS.practice_frame(FS.Tables.of(v)))
_columns("ag14_long_run_pace_rank", "o_fp", "fp_long_run_pace_rank", lambda v: FS.practice_frame(FS.Tables.of(v)))
_columns("ag15_tyre_wear_rank", "o_fp", "fp_tyre_deg_rank", lambda v: FS.practice_frame(FS.Tables.of(v)))
_columns("ag17_practice_laps", "o_fp", "fp_total_laps", lambda v: FS.practice_frame(FS.Tables.of(v)))


@query("ag17_session_availability", "SELECT event_id, fp_session_availability FROM o_avail", d="fp_session_availability")
def _(v):
    return FS.session_availability(v.b_session)


@query("ag03_team_standings", "SELECT event_id, team_id, team_constructor_standing_rank FROM o_standing", d="team_constructor_standing_rank")
def _(v):
    return FS.team_frame(FS.Tables.of(v)).select("event_id", "team_id", "team_constructor_standing_rank")


@query("wn11_title_rank", "SELECT event_id, driver_id, title_rank FROM o_title", i="title_rank")
def _(v):
    t = FS.Tables.of(v)
    return FS.championship_rank(t, FS.driver_history(t)).select(*KEYS, "title_rank")


@query("ag11_jn14_team_means", """
SELECT q.event_id, q.team_id, q.m AS quali_mean, r.m AS race_mean FROM o_team_quali3 q JOIN o_team_race3 r ON r.event_id = q.event_id AND r.team_id = q.team_id""", d="quali_mean race_mean")
def _(v):
    return FS.team_frame(FS.Tables.of(v)).select("event_id", "team_id", F.col("team_qualifying_position_mean_last3").alias("quali_mean"),
                                                 F.col("team_recent_finish_mean_last3").alias("race_mean"))


@query("flagship_form_and_standings", """
SELECT s.event_id, s.driver_id, f.position_mean_last3, f.position_mean_last5, f.position_std_last5, f.dnf_rate_last10, t.title_rank
FROM b_spine s JOIN o_form f ON f.event_id = s.event_id AND f.driver_id = s.driver_id JOIN o_title t ON t.event_id = s.event_id AND t.driver_id = s.driver_id""",
       d="position_mean_last3 position_mean_last5 position_std_last5 dnf_rate_last10", i="title_rank")
def _(v):
    t = FS.Tables.of(v)
    return FS.championship_rank(t, FS.driver_columns(FS.driver_history(t))).select(
        *KEYS, "position_mean_last3", "position_mean_last5", "position_std_last5", "dnf_rate_last10", "title_rank")


@query("jn05_last_n_history", """
SELECT event_id, driver_id, count(*) AS n, sum(position) AS total, min(past_date) AS oldest FROM o_hr WHERE rn <= 10 GROUP BY 1, 2""", i="total", s="oldest")
def _(v):
    d = H.day(F.col("event_date")).alias("day")
    spine = v.b_spine.select("code", *KEYS, d)
    facts = v.b_result.select("code", d, "position", F.col("event_date").alias("past_date"))
    df = H.last_n(H.stack(spine, race=facts), ["code"], "race", 10, "races").where("is_spine").where(F.size("races") > 0)
    pos = F.filter(F.transform("races", lambda r: r["position"]), lambda x: x.isNotNull())
    return df.select(*KEYS, F.size("races").alias("n"),
                     F.when(F.size(pos) > 0, F.aggregate(pos, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"),
                     F.array_min(F.transform("races", lambda r: r["past_date"])).alias("oldest"))


@query("jn03_nearest_event", """
SELECT x.row_id, coalesce(n.d, p.d) AS matched FROM (SELECT row_id, event_type, snapshot_date FROM b_snapshot WHERE event_type <> 'error') x
LEFT JOIN (SELECT s.row_id, min(e.d) AS d FROM b_snapshot s JOIN (SELECT DISTINCT snapshot_date AS d FROM b_snapshot WHERE event_type = 'error' AND (day(snapshot_date)) % 3 = 0) e ON e.d >= s.snapshot_date GROUP BY 1) n ON n.row_id = x.row_id
LEFT JOIN (SELECT s.row_id, max(e.d) AS d FROM b_snapshot s JOIN (SELECT DISTINCT snapshot_date AS d FROM b_snapshot WHERE event_type = 'error' AND (day(snapshot_date)) % 3 = 0) e ON e.d < s.snapshot_date GROUP BY 1) p ON p.row_id = x.row_id""", s="matched")
def _(v):
    # calendar: the dates with an 'error' entry on every third day of the month
    s = v.b_snapshot
    cal = s.where((F.col("event_type") == "error") & (F.dayofmonth("snapshot_date") % 3 == 0)).select(F.col("snapshot_date").alias("matched")).distinct()
    left = s.where(F.col("event_type") != "error").select("row_id", H.day(F.col("snapshot_date")).alias("day"))
    return H.asof_nearest(left, cal.withColumn("day", H.day(F.col("matched"))), ["matched"]).select("row_id", "matched")


@query("jn04_latest_at_or_before", """
SELECT v.user_id, v.d, coalesce(b.value, 0) AS value FROM (SELECT user_id, snapshot_date AS d FROM b_snapshot WHERE event_type = 'view' GROUP BY 1, 2) v
ASOF LEFT JOIN (SELECT user_id, snapshot_date AS bd, max(value) AS value FROM b_snapshot WHERE event_type = 'purchase' GROUP BY 1, 2) b ON b.user_id = v.user_id AND b.bd <= v.d""", d="value", s="d")
def _(v):
    day = H.day(F.col("snapshot_date")).alias("day")
    left = v.b_snapshot.where("event_type = 'view'").select("user_id", F.col("snapshot_date").alias("d"), day).distinct()
    right = v.b_snapshot.where("event_type = 'purchase'").groupBy("user_id", day).agg(F.max("value").alias("value"))
    return H.asof_latest(left, right, ["user_id"], ["value"]).select("user_id", "d", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


@query("jn07_default_on_miss", "SELECT s.event_id, s.driver_id, coalesce(r.position, 18) AS position FROM b_spine s LEFT JOIN b_result r ON r.event_id = s.event_id AND r.driver_id = s.driver_id", d="position")
def _(v):
    return J.with_default(v.b_spine.select(*KEYS), v.b_result.select(*KEYS, F.col("position").cast("double").alias("position")), KEYS, {"position": 18.0})


@query("jn11_teammate", "SELECT driver_id, mate_id FROM o_mate")
def _(v):
    return J.teammate(v.b_driver.select("driver_id", "team_id")).select("driver_id", "mate_id")


@query("jn13_wet_starts_semi_join", """
SELECT r.event_id, r.driver_id FROM b_result r WHERE EXISTS (SELECT 1 FROM b_weather w WHERE w.weekend_id = r.weekend_id AND w.session_type = 'R' AND w.rainfall)""")
def _(v):
    return v.b_result.join(J.wet_sessions(v.b_weather, "R"), ["weekend_id", "session_type"], "left_semi").select(*KEYS)


@query("ag12_best_five_laps", "SELECT event_id, driver_id, best, best5 FROM o_pace WHERE best IS NOT NULL", d="best best5")
def _(v):
    laps = FL.practice_laps(v.b_lap, keep_pit_laps=True)
    rn = ordinal_rank(KEYS, F.col("lap_time"))
    return laps.select(*KEYS, "lap_time", rn.alias("rn")).where("rn <= 5").groupBy(*KEYS).agg(F.min("lap_time").alias("best"), F.avg("lap_time").alias("best5"))


@query("ag14_exact_median", "SELECT event_id, driver_id, median(lap_time) AS med FROM b_lap GROUP BY 1, 2", d="med")
def _(v):
    from ..functions.quantiles import exact_median
    return exact_median(v.b_lap, KEYS, "lap_time", "med")


@query("ag14_exact_median_hot_groups", "SELECT session_type, median(lap_time) AS med FROM b_lap GROUP BY 1", d="med")
def _(v):
    from ..functions.quantiles import exact_median
    return exact_median(v.b_lap, ["session_type"], "lap_time", "med")


@query("ag15_stint_slope", """
SELECT event_id, driver_id, session_type, stint, compound, CASE WHEN min(tyre_life) < max(tyre_life) THEN regr_slope(lap_time, tyre_life) END AS slope FROM o_runs GROUP BY 1, 2, 3, 4, 5""", d="slope")
def _(v):
    return FS.stint_frame(v.b_lap).where("n_run >= 5").select(*FL.STINT, "slope")


@query("wn12_average_rank", f"SELECT event_id, driver_id, {avg_rank('points')} AS rk FROM b_result", d="rk")
def _(v):
    return v.b_result.select(*KEYS, average_rank(["event_id"], "points").alias("rk"))


@query("wn13_rank_or_last", f"SELECT event_id, driver_id, {rank_last('position')} AS rk FROM b_quali", d="rk")
def _(v):
    return v.b_quali.select(*KEYS, rank_or_last(["event_id"], "position", "driver_id").alias("rk"))


@query("fn17_derived_practice_columns", "SELECT event_id, driver_id, fp_short_vs_long_delta, practice_rainfall_any FROM o_all", d="fp_short_vs_long_delta practice_rainfall_any")
def _(v):
    return FS.features(FS.Tables.of(v), "v4").select(*KEYS, "fp_short_vs_long_delta", "practice_rainfall_any")


for _id, _version in (("fs01", "v1"), ("fs02", "v2"), ("fs03", "v3"), ("fs04", "v4"), ("fs05", "race"), ("fs06", "qualifying")):
    _cols = FS.SETS[_version]

    @query(f"{_id}_feature_set_{_version}", f"SELECT event_id, driver_id, {', '.join(_cols)} FROM o_all", d=" ".join(_cols))
    def _(v, version=_version, cols=_cols):
        return FS.features(FS.Tables.of(v), version).select(*KEYS, *cols)


@query("ar03_column_alignment", "SELECT event_id, driver_id, " + ", ".join(c for c in FS.V2 if c not in FS.V3_DROPPED) + " FROM o_all", d=" ".join(c for c in FS.V2 if c not in FS.V3_DROPPED))
def _(v):
    return FS.features(FS.Tables.of(v), "v2").drop("code", "season_id", "weekend_id", "event_date", "season_year", *FS.V3_DROPPED, "not_a_column")
