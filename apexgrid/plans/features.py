"""Feature sets for every (event, season driver) in one job.

Frames and their partitioning:
  driver history  - one shuffle by driver code; season and circuit windows nest inside it
  team history    - one shuffle by team code
  practice        - laps are reduced map-side to stints before anything else
  weekend         - weather is reduced to one row per weekend and session
They meet on (event_id, driver_id).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import lists as L, scalars as S
from ..functions.quantiles import exact_median
from ..functions.ranking import average_rank, ordinal_rank, rank_or_last
from ..operators import filters as FL, history as H, joins as J
from ..params import DEFAULTS, PRACTICE, Params

# The columns of each feature set, in their order.
V1 = ["position_mean_last3", "position_mean_last5", "position_std_last5", "dnf_rate_last10",
      "positions_gained_mean_last5", "qualifying_position_mean_last3", "circuit_position_mean_last3",
      "team_position_mean_last5", "fantasy_points_mean_last3", "practice_best_lap_rank",
      "practice_avg_best_5_rank", "circuit_length", "total_corners", "round_number", "is_sprint_weekend"]
V2_ADDED = ["team_constructor_standing_rank", "circuit_corner_density", "team_low_df_avg_pos",
            "team_high_df_avg_pos", "driver_vs_teammate_gap_last5", "pick_percentage",
            "price_change_last_race", "fantasy_points_trend_last5", "weather_practice_rainfall",
            "weather_track_temp_mean"]
V3_DROPPED = ["weather_practice_rainfall", "circuit_length", "total_corners", "circuit_corner_density",
              "team_low_df_avg_pos", "team_high_df_avg_pos", "pick_percentage", "dnf_rate_last10",
              "price_change_last_race"]
V3_ADDED = ["weather_practice_rain_fraction", "circuit_historical_rain_rate",
            "track_temp_deviation_from_circuit_mean", "weather_air_temp_mean",
            "driver_wet_vs_dry_position_delta", "driver_races", "driver_wet_session_count",
            "team_qualifying_position_mean_last3", "team_recent_finish_mean_last3",
            "driver_vs_teammate_championship_gap"]
V4_ADDED = ["position_last1", "position_slope", "best_position_last5", "teammate_delta", "team_best_position",
            "quali_last1", "quali_slope", "fp_long_run_pace_rank", "fp_tyre_deg_rank", "fp_sector1_rank",
            "fp_sector2_rank", "fp_sector3_rank", "fp_total_laps", "fp_session_availability",
            "fp_short_vs_long_delta", "practice_rainfall_any", "driver_wet_performance_rank"]
V2 = V1 + V2_ADDED
V3 = [c for c in V2 if c not in V3_DROPPED] + V3_ADDED
V4 = V3 + V4_ADDED
RACE = V4 + ["qualifying_position"]
SETS = {"v1": V1, "v2": V2, "v3": V3, "v4": V4, "race": RACE, "qualifying": V4}
KEYS = ["event_id", "driver_id"]


@dataclass
class Tables:
    """Inputs of the feature job."""

    spine: DataFrame     # every season driver at every event
    race: DataFrame      # results of R
    quali: DataFrame     # results of Q
    laps: DataFrame      # practice laps
    weather: DataFrame   # samples per weekend and session
    price: DataFrame     # driver prices
    total: DataFrame     # one points total per (event, driver)
    session: DataFrame   # session rows
    stints: DataFrame | None = None  # ``stint_frame`` of the laps, if already written

    @classmethod
    def of(cls, v) -> "Tables":
        v.stage("b_agg", "b_event", "b_driver", "b_spine", "b_rank", "b_result", "b_quali", "b_overtake", "b_score", "b_total", "b_price")
        return cls(v.b_spine, v.b_result, v.b_quali, v.b_lap, v.b_weather, v.b_price, v.b_total, v.b_session,
                   v.keep("stints", lambda: stint_frame(v.b_lap)))


# --- weekend ---------------------------------------------------------------
def weekend_weather(weather: DataFrame) -> DataFrame:
    """One row per weekend: practice aggregates, rain rate and temperature against the past of the circuit."""
    fp = F.col("session_type").isin(*PRACTICE)
    agg = weather.groupBy("weekend_id", "event_date", "circuit_id").agg(
        F.max(F.when(fp, F.col("rainfall").cast("double"))).alias("fp_any"),
        F.avg(F.when(fp, F.col("rainfall").cast("double"))).alias("fp_fraction"),
        F.avg(F.when(fp, F.col("track_temp"))).alias("fp_track"),
        F.avg(F.when(fp, F.col("air_temp"))).alias("fp_air"),
        F.max(F.col("rainfall").cast("double")).alias("any_rain"),
        F.sum("track_temp").alias("sum_track"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("day", H.day(F.col("event_date")))


def circuit_weather(weekends: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather columns of every weekend, also of those without samples."""
    spine = weekends.select("weekend_id", "circuit_id", H.day(F.col("event_date")).alias("day")).distinct()
    both = spine.join(weekend_weather(weather).drop("event_date", "circuit_id", "day"), "weekend_id", "left")
    w = H.before(["circuit_id"])
    past_mean = F.sum("sum_track").over(w) / F.nullif(F.sum("n").over(w), F.lit(0))
    z = F.lit(0.0)
    return both.select(
        "weekend_id",
        F.coalesce("fp_any", z).alias("weather_practice_rainfall"),
        F.coalesce("fp_track", z).alias("weather_track_temp_mean"),
        F.coalesce("fp_fraction", z).alias("weather_practice_rain_fraction"),
        F.coalesce(F.avg("any_rain").over(w), z).alias("circuit_historical_rain_rate"),
        F.coalesce(F.col("fp_track") - past_mean, z).alias("track_temp_deviation_from_circuit_mean"),
        F.coalesce("fp_air", z).alias("weather_air_temp_mean"))


# --- driver history --------------------------------------------------------
def race_facts(t: Tables) -> DataFrame:
    """Race results with the teammate's position in the same race and the wet flag."""
    mates = J.teammate(t.spine.select("driver_id", "team_id").distinct()).select("driver_id", "mate_id")
    mate_pos = t.race.select("event_id", F.col("driver_id").alias("mate_id"), F.col("position").alias("mate_position"))
    wet = J.wet_sessions(t.weather, "R").select("weekend_id", F.lit(True).alias("wet"))
    return (t.race.join(mates, "driver_id", "left").join(mate_pos, ["event_id", "mate_id"], "left")
            .join(wet, "weekend_id", "left")
            .select("code", "driver_id", "circuit_id", H.day(F.col("event_date")).alias("day"),
                    F.col("position").cast("double").alias("position"), F.col("grid_position").cast("double").alias("grid"),
                    S.dnf_by_status(F.col("status")).alias("dnf"), "points",
                    F.col("mate_position").cast("double").alias("mate_position"),
                    F.coalesce("wet", F.lit(False)).alias("wet")))


def quali_facts(t: Tables) -> DataFrame:
    wet = J.wet_sessions(t.weather, "Q").select("weekend_id", F.lit(True).alias("wet"))
    return (t.quali.join(wet, "weekend_id", "left")
            .select("code", H.day(F.col("event_date")).alias("day"), F.col("position").cast("double").alias("position"),
                    F.coalesce("wet", F.lit(False)).alias("wet")))


def driver_history(t: Tables) -> DataFrame:
    """All short histories of every spine row; a single shuffle by driver code."""
    d = H.day(F.col("event_date")).alias("day")
    spine = t.spine.select("code", "driver_id", "circuit_id", d, "event_id", "team_id", "season_year", "series", "team_code")
    df = H.stack(
        spine, race=race_facts(t), quali=quali_facts(t),
        score=t.total.select("code", d, F.col("race_total").cast("double").alias("total")),
        price=t.price.select("code", d, "pick_percentage", F.col("price_change").cast("double").alias("price_change")))
    code = ["code"]
    df = H.merge_days(df, code, [], ["race", "quali", "score", "price"])
    w, ws = H.before(code), H.before(["code", "driver_id"])
    placed = F.col("race.position")
    df = df.withColumns({
        "signal": F.last("price", ignorenulls=True).over(H.up_to(code)),
        "starts": F.count("race").over(w),
        "wet_starts": F.count_if(F.col("race.wet")).over(w) + F.count_if(F.col("quali.wet")).over(w),
        "n_wet": F.count(F.when(F.col("race.wet"), placed)).over(w),
        "n_dry": F.count(F.when(~F.col("race.wet"), placed)).over(w),
        "wet_mean": F.avg(F.when(F.col("race.wet"), placed)).over(w),
        "dry_mean": F.avg(F.when(~F.col("race.wet"), placed)).over(w),
        "season_points": F.sum("race.points").over(ws),
        "season_starts": F.count("race").over(ws),
        "_first5": F.when(F.count("score").over(w) < 5, F.col("score")),
        "_placed": F.when(placed.isNotNull(), F.col("race")),
        "_n_race": F.count("race").over(w), "_n_quali": F.count("quali").over(w), "_n_score": F.count("score").over(w),
        "_n_circuit": F.count("race").over(H.before(["code", "circuit_id"])),
        "_n_own": F.count(F.when(placed.isNotNull(), 1)).over(ws),
    })
    return df.withColumns({
        "oldest_scores": F.collect_list("_first5").over(w),
        "scores": F.collect_list("score").over(H.last(code, "_n_score", 5)),
        "at_circuit": F.collect_list("race").over(H.last(["code", "circuit_id"], "_n_circuit", 3)),
        "placed20": F.collect_list("_placed").over(H.last(["code", "driver_id"], "_n_own", 20)),
        "qualis": F.collect_list("quali").over(H.last(code, "_n_quali", 5)),
        "races": F.collect_list("race").over(H.last(code, "_n_race", 10)),
    }).where("is_spine").drop("race", "quali", "score", "price", "is_spine", "_first5", "_placed",
                              "_n_race", "_n_quali", "_n_score", "_n_circuit", "_n_own")


def driver_columns(hist: DataFrame, p: Params = DEFAULTS, trend: str = "latest") -> DataFrame:
    new = F.lit(p.new_entrant_position)
    newest = F.reverse("races")
    got = F.filter(F.transform(newest, lambda r: r["position"]), lambda x: x.isNotNull())
    gained = F.transform(F.filter(F.slice(newest, 1, 5), lambda r: r["position"].isNotNull() & r["grid"].isNotNull()),
                         lambda r: r["grid"] - r["position"])
    none = F.size("races") == 0
    q3 = F.filter(F.transform(F.slice(F.reverse("qualis"), 1, 3), lambda r: r["position"]), lambda x: x.isNotNull())
    c3 = F.filter(F.transform("at_circuit", lambda r: r["position"]), lambda x: x.isNotNull())
    points = F.transform("scores" if trend == "latest" else "oldest_scores", lambda r: r["total"])
    shared = F.slice(F.filter(F.reverse("placed20"), lambda r: r["mate_position"].isNotNull()), 1, 5)
    last5 = F.transform(F.reverse(F.slice(newest, 1, 5)), lambda r: F.when(r["dnf"] | r["position"].isNull(), 20.0).otherwise(r["position"]))
    quali5 = F.transform("qualis", lambda r: F.coalesce(r["position"], F.lit(20.0)))
    return hist.withColumns({
        "_got": got, "_last5": last5, "_q5": quali5,
    }).withColumns({
        "position_mean_last3": F.when(none, new).otherwise(L.mean(F.slice("_got", 1, 3), 0.0)),
        "position_mean_last5": F.when(none, new).otherwise(L.mean(F.slice("_got", 1, 5), 0.0)),
        "position_std_last5": L.sample_std(F.slice("_got", 1, 5)),
        "dnf_rate_last10": L.mean(F.transform("races", lambda r: r["dnf"].cast("double")), 0.0),
        "positions_gained_mean_last5": L.mean(gained, 0.0),
        "qualifying_position_mean_last3": F.coalesce(L.mean(q3), new),
        "circuit_position_mean_last3": L.mean(c3, 10.0),
        "fantasy_points_mean_last3": L.mean(F.transform(F.slice(F.reverse("scores"), 1, 3), lambda r: r["total"]), 0.0),
        "fantasy_points_trend_last5": L.slope(points),
        "driver_vs_teammate_gap_last5": L.mean(F.transform(shared, lambda r: r["mate_position"] - r["position"]), 0.0),
        "pick_percentage": F.coalesce("signal.pick_percentage", F.lit(0.0)),
        "price_change_last_race": F.coalesce("signal.price_change", F.lit(0.0)),
        "driver_races": F.col("starts").cast("double"),
        "driver_wet_session_count": F.col("wet_starts").cast("double"),
        "driver_wet_vs_dry_position_delta": F.when(F.col("n_wet") < 3, 2.0).when(F.col("n_dry") < 3, 0.0).otherwise(F.col("wet_mean") - F.col("dry_mean")),
        "position_last1": F.coalesce(F.try_element_at("_last5", F.lit(-1)), new),
        "position_slope": L.slope(F.col("_last5")),
        "best_position_last5": F.coalesce(F.array_min("_last5"), new),
        "quali_last1": F.coalesce(F.try_element_at("_q5", F.lit(-1)), new),
        "quali_slope": L.slope(F.col("_q5")),
    }).drop("_got", "_q5", "races", "qualis", "scores", "oldest_scores", "at_circuit", "placed20", "signal")


def championship_rank(t: Tables, hist: DataFrame, full_prev_standings: bool = False) -> DataFrame:
    """Title rank before each event, falling back to last season's points among the unranked, else 20."""
    prev = (t.race.groupBy("code", (F.col("season_year") + 1).alias("season_year"))
            .agg(F.sum("points").alias("prev_points")))
    df = hist.join(prev, ["code", "season_year"], "left")
    ranked = F.col("season_starts") > 0
    seat = df.withColumns({"_r": ranked, "_old": ~ranked & F.col("prev_points").isNotNull()})
    now = ordinal_rank(["event_id", "_r"], F.col("season_points").desc_nulls_last(), F.col("code"))
    pool = ["event_id"] if full_prev_standings else ["event_id", "_old"]
    before = ordinal_rank(pool, F.col("prev_points").desc_nulls_last(), F.col("code"))
    return seat.withColumn("title_rank", F.when(ranked, now).when(F.col("_old"), before).otherwise(20)).drop("_r", "_old", "prev_points")


def field_columns(t: Tables, df: DataFrame) -> DataFrame:
    """Columns that compare the drivers of one event: teammates, title gap, wet rank."""
    crew = Window.partitionBy("event_id", "team_id")
    mates = F.array_sort(F.collect_list(F.struct("driver_id", "title_rank", "position_last1")).over(crew))
    df = championship_rank(t, df).withColumn("_crew", mates)
    mate = F.try_element_at(F.filter("_crew", lambda m: m["driver_id"] != F.col("driver_id")), F.lit(1))
    return df.withColumns({
        "driver_vs_teammate_championship_gap": F.coalesce((F.col("title_rank") - mate["title_rank"]).cast("double"), F.lit(0.0)),
        "teammate_delta": F.when(F.size("_crew") == 2, F.col("position_last1") - mate["position_last1"]).otherwise(0.0),
        "team_best_position": F.coalesce(F.min(F.array_min("_last5")).over(crew), F.lit(DEFAULTS.new_entrant_position)),
        "driver_wet_performance_rank": average_rank(["event_id"], "driver_wet_vs_dry_position_delta"),
    }).drop("_crew", "_last5")


# --- team history ----------------------------------------------------------
def team_frame(t: Tables) -> DataFrame:
    """Team columns per (event, team): recent form, standing rank, means of the last three events."""
    keys = ["team_code", "team_id", "season_year"]
    d = H.day(F.col("event_date")).alias("day")
    spine = t.spine.select(*keys, d, "event_id", "series").distinct()

    def per_event(res):
        return res.groupBy(*keys, d).agg(
            F.array_sort(F.collect_list(F.struct("driver_id", F.col("position").cast("double").alias("position")))).alias("cars"),
            F.avg("position").alias("mean"), F.sum("points").alias("points"), F.count(F.lit(1)).alias("n"))

    race, quali = per_event(t.race), per_event(t.quali)
    season = ["team_code", "team_id"]
    df = H.merge_days(H.stack(spine, race=race, quali=quali), ["team_code"], season, ["race", "quali"])
    df = df.withColumns({"_rm": F.when(F.col("race.mean").isNotNull(), F.struct("race.mean")),
                         "_qm": F.when(F.col("quali.mean").isNotNull(), F.struct("quali.mean"))})
    df = H.last_n(df, season, "race", 10, "races")
    df = H.last_n(df, season, "_rm", 3, "race3")
    df = H.last_n(df, season, "_qm", 3, "quali3")
    df = df.withColumns({"team_points": F.sum("race.points").over(H.before(season)),
                         "team_rows": F.coalesce(F.sum("race.n").over(H.before(season)), F.lit(0))}).where("is_spine")

    def final3(res, out):
        w = Window.partitionBy("team_code", "season_year").orderBy(F.col("day").desc())
        return (res.where(F.col("mean").isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn <= 3")
                .groupBy("team_code", (F.col("season_year") + 1).alias("season_year")).agg(F.avg("mean").alias(out)))

    df = df.join(final3(race, "prev_race3"), ["team_code", "season_year"], "left").join(final3(quali, "prev_quali3"), ["team_code", "season_year"], "left")
    rows10 = F.slice(F.flatten(F.transform(F.reverse("races"), lambda e: e["cars"])), 1, 10)
    form = F.filter(F.transform(rows10, lambda c: c["position"]), lambda x: x.isNotNull())
    new = F.lit(DEFAULTS.new_entrant_position)
    scored = F.col("team_rows") > 0
    rank = ordinal_rank(["event_id", "_has"], F.col("team_points").desc_nulls_last(), F.col("team_id"))
    return df.withColumn("_has", scored).select(
        "event_id", "team_id",
        L.mean(form, 10.0).alias("team_position_mean_last5"),
        F.when(scored, rank.cast("double")).otherwise(5.0).alias("team_constructor_standing_rank"),
        F.coalesce(L.mean(F.transform("race3", lambda x: x["mean"])), "prev_race3", new).alias("team_recent_finish_mean_last3"),
        F.coalesce(L.mean(F.transform("quali3", lambda x: x["mean"])), "prev_quali3", new).alias("team_qualifying_position_mean_last3"))


def downforce(t: Tables) -> DataFrame:
    """Mean finish per team on low- and high-density circuits of this and last season.

    Results are first reduced to (event, team); each past event then meets at most the
    events of its own and the next season.
    """
    track = t.spine.where(F.col("circuit_length").isNotNull() & F.col("total_corners").isNotNull() & (F.col("circuit_length") != 0))
    dens = track.select("event_id", (F.col("total_corners") / F.col("circuit_length")).alias("density")).distinct()
    past = (t.race.where(F.col("position").isNotNull()).groupBy("event_id", "series", "season_year", H.day(F.col("event_date")).alias("past_day"), "team_code")
            .agg(F.sum("position").alias("pos"), F.count(F.lit(1)).alias("n")).join(dens, "event_id").drop("event_id")
            .withColumn("season_year", F.explode(F.array("season_year", F.col("season_year") + 1))))
    target = t.spine.select("event_id", "series", "season_year", H.day(F.col("event_date")).alias("day")).distinct()
    pairs = target.join(past, ["series", "season_year"]).where(F.col("past_day") < F.col("day"))
    med = pairs.groupBy("event_id").agg(F.percentile("density", F.lit(0.5), F.col("n")).alias("med"))
    low = F.col("density") < F.col("med")

    def mean(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("pos"))) / F.sum(F.when(cond, F.col("n"))), F.lit(10.0))

    return pairs.join(med, "event_id").groupBy("event_id", "team_code").agg(
        mean(low).alias("team_low_df_avg_pos"), mean(~low).alias("team_high_df_avg_pos"))


# --- practice --------------------------------------------------------------
def stint_frame(laps: DataFrame) -> DataFrame:
    """Practice laps reduced to stints: one partial aggregate feeds most practice columns."""
    fp = FL.practice_laps(laps, keep_pit_laps=True)
    clean = ~F.col("is_pit_in") & ~F.col("is_pit_out")
    run = clean & F.col("compound").isNotNull() & F.col("stint").isNotNull() & F.col("tyre_life").isNotNull()
    x, y = F.when(run, F.col("tyre_life").cast("double")), F.when(run, F.col("lap_time"))
    return fp.groupBy(*FL.STINT).agg(
        F.min("lap_time").alias("best"), F.count_if(clean).alias("n_clean"), F.count_if(run).alias("n_run"),
        F.regr_slope(y, x).alias("slope"),
        *[F.min(F.when(clean, F.col(f"sector{i}"))).alias(f"s{i}") for i in (1, 2, 3)])


def practice_frame(t: Tables) -> DataFrame:
    """Practice columns per (event, driver)."""
    stints = stint_frame(t.laps) if t.stints is None else t.stints
    long_run = F.col("n_run") >= 5
    fp2 = long_run & (F.col("session_type") == "FP2")
    per = stints.groupBy(*KEYS).agg(
        F.min("best").alias("best"), F.sum("n_clean").alias("laps"), *[F.min(f"s{i}").alias(f"s{i}") for i in (1, 2, 3)],
        F.avg(F.when(fp2, F.col("slope"))).alias("deg"))
    w5 = Window.partitionBy(*KEYS).orderBy("lap_time")
    best5 = (FL.practice_laps(t.laps, keep_pit_laps=True).select(*KEYS, "lap_time").withColumn("_rn", F.row_number().over(w5))
             .where("_rn <= 5").groupBy(*KEYS).agg(F.avg("lap_time").alias("best5")))
    field = t.spine.groupBy("event_id").agg(F.count(F.lit(1)).alias("field"))
    runs = stints.where(long_run)
    choice = (field.join(runs.where(F.col("session_type") == "FP2").groupBy("event_id").agg(F.count_distinct("driver_id").alias("n2")), "event_id", "left")
              .select("event_id", (F.coalesce("n2", F.lit(0)) * 2 >= F.col("field")).alias("fp2_only")))
    chosen = (runs.join(choice, "event_id")
              .where((F.col("session_type") == "FP2") | ((F.col("session_type") == "FP1") & ~F.col("fp2_only"))).select(*FL.STINT))
    usable = FL.practice_laps(t.laps).where(F.col("tyre_life").isNotNull())
    pace = exact_median(usable.join(chosen, FL.STINT, "left_semi"), KEYS, "lap_time", "pace")
    df = (t.spine.select(*KEYS).join(per, KEYS, "left").join(best5, KEYS, "left").join(pace, KEYS, "left"))
    e = ["event_id"]
    z = F.lit(10.5)
    return df.select(
        *KEYS,
        rank_or_last(e, "best", "driver_id").alias("practice_best_lap_rank"),
        rank_or_last(e, "best5", "driver_id").alias("practice_avg_best_5_rank"),
        F.coalesce(average_rank(e, "pace"), z).alias("fp_long_run_pace_rank"),
        F.coalesce(average_rank(e, "deg"), z).alias("fp_tyre_deg_rank"),
        *[F.coalesce(average_rank(e, f"s{i}"), z).alias(f"fp_sector{i}_rank") for i in (1, 2, 3)],
        F.coalesce(F.col("laps").cast("double"), F.lit(0.0)).alias("fp_total_laps"))


def session_availability(session: DataFrame) -> DataFrame:
    return (FL.sessions(session, *PRACTICE).groupBy("event_id")
            .agg(F.count_distinct("session_type").cast("double").alias("fp_session_availability")))


# --- feature sets ----------------------------------------------------------
def features(t: Tables, version: str = "v4", p: Params = DEFAULTS, trend: str = "latest", wanted: list[str] | None = None) -> DataFrame:
    """Feature set ``version`` (or the columns ``wanted`` of several) for every (event, driver); restrict with ``where`` afterwards."""
    ids = ["season_id", "weekend_id", "event_date", "season_year"]
    base = t.spine.select(*KEYS, "team_id", "team_code", "code", *ids, "round_no", "circuit_length", "total_corners", "event_format")
    base = base.withColumns({**S.event_context(), "circuit_corner_density": S.corner_density(F.col("total_corners"), F.col("circuit_length"))})
    drivers = field_columns(t, driver_columns(driver_history(t), p, trend)).drop("code", "team_id", "team_code", "season_year", "series", "circuit_id", "day")
    df = base.join(drivers, KEYS).join(team_frame(t), ["event_id", "team_id"]).join(practice_frame(t), KEYS)
    wanted = SETS[version] if wanted is None else wanted
    if "team_low_df_avg_pos" in wanted:
        df = J.with_default(df, downforce(t), ["event_id", "team_code"], {"team_low_df_avg_pos": 10.0, "team_high_df_avg_pos": 10.0})
    if "weather_track_temp_mean" in wanted:
        df = df.join(circuit_weather(t.spine, t.weather), "weekend_id", "left")
    if "fp_session_availability" in wanted:
        df = J.with_default(df, session_availability(t.session), ["event_id"], {"fp_session_availability": 0.0})
        df = df.withColumns({
            "fp_short_vs_long_delta": F.col("practice_best_lap_rank") - F.col("fp_long_run_pace_rank"),
            "practice_rainfall_any": (F.col("weather_practice_rain_fraction") > 0).cast("double")})
    if "qualifying_position" in wanted:
        q = t.quali.select(*KEYS, F.col("position").cast("double").alias("qualifying_position"))
        df = J.with_default(df, q, KEYS, {"qualifying_position": 10.5})
    return df.select(*KEYS, "code", *ids, *wanted)
