"""Queries for scalar functions and row filters."""
import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as FL
from ..params import Q_PROGRESSION
from .bindings import quali_pts, race_pts, sprint_pts
from .registry import query


@query("fn01_null_safe_conversions", """
SELECT l_suppkey AS code, count(CASE WHEN l_linenumber <> 3 THEN 1 END) AS n_value, sum(CASE WHEN l_linenumber <> 3 THEN l_quantity END) AS total,
  sum(CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(l_quantity AS bigint) END) AS total_int, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS n_text
FROM lineitem GROUP BY l_suppkey""", d="total", i="total_int")
def _(v):
    x = v.lineitem.select(
        F.col("l_suppkey").alias("code"),
        S.null_if_nan(F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))).alias("value"),
        S.int_or_null(F.when(F.col("l_linenumber") == 7, F.lit("bad")).otherwise(F.col("l_quantity").cast("string"))).alias("whole"),
        S.text_or_null(F.when(F.col("l_returnflag") == "N", F.lit("NaN")).otherwise(F.col("l_returnflag"))).alias("text"))
    return x.groupBy("code").agg(F.count("value").alias("n_value"), F.sum("value").alias("total"),
                                 F.sum("whole").alias("total_int"), F.count("text").alias("n_text"))


@query("fn02_money_parse", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END * ((1000 + p_partkey % 500) + (p_partkey % 10) / 10.0) AS price FROM part""", d="price")
def _(v):
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit(" -$1,")).otherwise(F.lit("$1,")),
                    F.lpad((F.col("p_partkey") % 500).cast("string"), 3, "0"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("M "))
    return v.part.select("p_partkey", S.money(text).alias("price"))


@query("fn03_int_or_null", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN NULL ELSE p_size END AS n FROM part""", i="n")
def _(v):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.lit("-")).when(k == 1, F.concat(F.col("p_size"), F.lit(".5x"))).otherwise(F.col("p_size").cast("string"))
    return v.part.select("p_partkey", S.strict_int(text).alias("n"))


@query("fn04_date_of_file", """
SELECT row_id, snapshot_date, year(snapshot_date) AS season_year FROM (SELECT row_id, snapshot_date FROM b_snapshot) x""", s="snapshot_date", i="season_year")
def _(v):
    name = F.concat(F.col("snapshot_date").cast("string"), F.lit("-drivers.csv"))
    return v.b_snapshot.select("row_id", S.date_of_file(name).alias("snapshot_date"), S.year_of_file(name).alias("season_year"))


@query("fn05_interval_seconds", """
SELECT l_suppkey AS code, sum(l_linenumber*60 + l_quantity) AS seconds, count(*) AS n FROM lineitem GROUP BY 1""", d="seconds")
def _(v):
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.col("l_linenumber"), F.col("l_quantity").cast("decimal(18,6)"))
    return v.lineitem.groupBy(F.col("l_suppkey").alias("code")).agg(F.sum(S.interval_seconds(span)).alias("seconds"), F.count(F.lit(1)).alias("n"))


@query("fn06_dnf_by_status", "SELECT event_id, driver_id, NOT (status = 'Finished' OR status LIKE '+%') AS dnf FROM b_result")
def _(v):
    return v.b_result.select("event_id", "driver_id", S.dnf_by_status(F.col("status")).alias("dnf"))


@query("fn07_dnf_for_scoring", "SELECT event_id, driver_id, position IS NULL AND status = 'Engine' AS dnf FROM b_result")
def _(v):
    return v.b_result.select("event_id", "driver_id", S.dnf_for_scoring(F.col("position"), F.col("status")).alias("dnf"))


@query("fn08_dsq", "SELECT event_id, driver_id, session_type, upper(classified_position) = 'D' AS dsq FROM b_results_all")
def _(v):
    return v.b_results_all.select("event_id", "driver_id", "session_type", S.dsq(F.col("classified_position")).alias("dsq"))


@query("fn09_position_points", f"""
SELECT event_id, driver_id, session_type, {race_pts('position')} AS race, {sprint_pts('position')} AS sprint, {quali_pts('position')} AS quali FROM b_results_all""",
       d="race sprint quali")
def _(v):
    p = F.col("position")
    return v.b_results_all.select("event_id", "driver_id", "session_type", S.race_points(p).alias("race"),
                                  S.sprint_points(p).alias("sprint"), S.quali_points(p).alias("quali"))


@query("fn10_q_progression", "SELECT event_id, team_id, points FROM b_qprog")
def _(v):
    g = v.b_quali.groupBy("event_id", "team_id").agg(
        F.count_if(F.col("position") <= 10).alias("q3"), F.count_if(F.col("position").between(11, 15)).alias("q2"))
    return g.select("event_id", "team_id", S.progression_points(F.col("q3"), F.col("q2")).alias("points"))


@query("fn11_corner_density", "SELECT event_id, coalesce(total_corners / circuit_length, 0) AS density FROM b_event", d="density")
def _(v):
    return v.b_event.select("event_id", S.corner_density(F.col("total_corners"), F.col("circuit_length")).alias("density"))


@query("fn12_event_context", """
SELECT event_id, coalesce(circuit_length, 0) AS circuit_length, total_corners, round_no AS round_number,
  CASE WHEN event_format = 'sprint' THEN 1 ELSE 0 END AS is_sprint_weekend FROM b_event""", d="circuit_length total_corners round_number is_sprint_weekend")
def _(v):
    return v.b_event.select("event_id", *[c.alias(n) for n, c in S.event_context().items()])


_PPM = "CASE WHEN price > 0 THEN (code % 16) / 10.0 END"


@query("fn13_performance_band", """
SELECT event_id, driver_id, CASE WHEN code % 16 > 12 THEN 'great' WHEN code % 16 > 9 THEN 'good' WHEN code % 16 > 6 THEN 'poor' ELSE 'terrible' END AS band FROM b_price""")
def _(v):
    return v.b_price.select("event_id", "driver_id", S.band((F.col("code") % 16) / F.lit(10.0)).alias("band"))


_CHANGE = """CASE WHEN price >= 19 THEN CASE WHEN code % 16 > 12 THEN 0.3 WHEN code % 16 > 9 THEN 0.1 WHEN code % 16 > 6 THEN -0.1 ELSE -0.3 END
  ELSE CASE WHEN code % 16 > 12 THEN 0.6 WHEN code % 16 > 9 THEN 0.2 WHEN code % 16 > 6 THEN -0.2 ELSE -0.6 END END"""


@query("fn14_price_change", f"SELECT event_id, driver_id, {_CHANGE} AS change FROM b_price", d="change")
def _(v):
    return v.b_price.select("event_id", "driver_id", S.price_change((F.col("code") % 16) / F.lit(10.0), F.col("price")).alias("change"))


@query("fn15_next_price", f"SELECT event_id, driver_id, greatest(3.0, least(34.0, price + {_CHANGE})) AS next_price FROM b_price", d="next_price")
def _(v):
    return v.b_price.select("event_id", "driver_id", S.next_price((F.col("code") % 16) / F.lit(10.0), F.col("price")).alias("next_price"))


@query("fn16_recency_weight", """
SELECT event_id, exp(-ln(2) / 10 * (max(i) OVER () - i)) AS weight FROM (
  SELECT event_id, dense_rank() OVER (ORDER BY event_date) - 1 AS i FROM b_event) x""", d="weight")
def _(v):
    from ..operators.windows import event_index
    idx = event_index(v.b_event, [])
    latest = idx.agg(F.max("event_index")).scalar()
    return idx.select("event_id", S.recency_weight(F.col("event_index"), latest).alias("weight"))


@query("fn18_team_alias", """
SELECT t.team_id, CASE n.n_name WHEN 'NATION_1' THEN 'alpha' WHEN 'NATION_2' THEN 'alpha' WHEN 'NATION_3' THEN 'beta' ELSE n.n_name END AS stable_code
FROM b_team t JOIN nation n ON n.n_nationkey = cast((t.team_id - t.season_year) / 10000 AS bigint) % 25""")
def _(v):
    from ..operators.joins import stable_code
    named = v.b_team.withColumn("k", F.expr("cast((team_id - season_year) / 10000 as bigint) % 25")).join(
        v.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("team_name")), "k")
    return stable_code(named, {"NATION_1": "alpha", "NATION_2": "alpha", "NATION_3": "beta"}).select("team_id", "stable_code")


@query("fn19_completion_percent", """
SELECT season_id, CASE WHEN count(*) = 0 THEN 0 ELSE cast(round_even(100.0 * count(CASE WHEN status = 'completed' THEN 1 END) / count(*), 0) AS bigint) END AS pct
FROM b_session s LEFT JOIN b_status t ON t.session_id = s.session_id GROUP BY season_id""", i="pct")
def _(v):
    g = v.b_session.join(v.b_status, "session_id", "left").groupBy("season_id").agg(
        F.count_if(F.col("status") == "completed").alias("done"), F.count(F.lit(1)).alias("total"))
    return g.select("season_id", S.completion_percent(F.col("done"), F.col("total")).alias("pct"))


@query("fn20_scoring_text", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'qualifying' WHEN p_partkey % 4 = 1 THEN 'sprint' WHEN p_partkey % 4 = 2 THEN 'weekend' ELSE 'race' END AS event_type,
  CASE WHEN p_partkey % 3 = 0 THEN p_size END AS position, CASE WHEN p_partkey % 3 = 1 THEN p_size END AS frequency, -p_size AS points FROM part""", i="position frequency points")
def _(v):
    k4, k3, n = F.col("p_partkey") % 4, F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.when(k4 == 0, "Qualifying Position").when(k4 == 1, "Sprint Position").when(k4 == 2, "Weekend Bonus").otherwise("Fastest Lap")
    mark = F.when(k3 == 0, F.concat(n, F.lit("th"))).when(k3 == 1, n).otherwise("-")
    return v.part.select("p_partkey", S.scoring_event_type(text).alias("event_type"), S.ordinal_position(mark).alias("position"),
                         S.plain_frequency(mark).alias("frequency"), S.first_signed_int(F.concat(F.lit("pts -"), n)).alias("points"))


@query("fn21_card_text", """
SELECT p_partkey, p_size + 0.25 AS pct, p_size AS pts, CASE WHEN p_partkey % 2 = 0 THEN -0.3 ELSE 0.3 END AS change FROM part""", d="pct change", i="pts")
def _(v):
    text = F.concat(F.col("p_size").cast("string"), F.lit(".25% picked, "), F.col("p_size").cast("string"), F.lit(" Pts"))
    return v.part.select("p_partkey", S.percent_in(text).alias("pct"), S.points_in(text).alias("pts"),
                         S.signed_change(F.lit(0.3), F.col("p_partkey") % 2 == 0).alias("change"))


# --- filters ---------------------------------------------------------------
@query("fl01_strict_cutoff", """
SELECT s.event_id, s.driver_id, count(*) AS n_before FROM b_spine s JOIN b_result r ON r.code = s.code AND r.event_date < s.event_date GROUP BY 1, 2""")
def _(v):
    r = v.b_result.select("code", F.col("event_date").alias("past"))
    return v.b_spine.join(r, "code").where(FL.before_target(F.col("past"), F.col("event_date"))).groupBy("event_id", "driver_id").agg(F.count(F.lit(1)).alias("n_before"))


@query("fl02_session_filter", "SELECT session_type, count(*) AS n FROM b_lap WHERE session_type IN ('FP1', 'FP3') GROUP BY 1")
def _(v):
    return FL.sessions(v.b_lap, "FP1", "FP3").groupBy("session_type").agg(F.count(F.lit(1)).alias("n"))


_CLEAN = "is_accurate AND lap_time IS NOT NULL AND NOT is_pit_in AND NOT is_pit_out"


@query("fl03_practice_laps", f"""
SELECT event_id, driver_id, count(*) AS n_all, count(CASE WHEN NOT is_pit_in AND NOT is_pit_out THEN 1 END) AS n_clean FROM b_lap WHERE is_accurate AND lap_time IS NOT NULL GROUP BY 1, 2""")
def _(v):
    g = FL.practice_laps(v.b_lap, keep_pit_laps=True).groupBy("event_id", "driver_id")
    return g.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(~F.col("is_pit_in") & ~F.col("is_pit_out")).alias("n_clean"))


@query("fl04_uncollected_sessions", """
SELECT s.session_id FROM b_session s LEFT JOIN b_status t ON t.session_id = s.session_id WHERE t.status IS NULL OR t.status NOT IN ('completed', 'failed')""")
def _(v):
    return FL.uncollected(v.b_session, v.b_status).select("session_id")


LONG_RUNS = f"""(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY event_id, driver_id, session_type, stint, compound) AS stint_n FROM b_lap
  WHERE {_CLEAN} AND compound IS NOT NULL AND stint IS NOT NULL AND tyre_life IS NOT NULL) z WHERE stint_n >= 5)"""


@query("fl05_long_runs", f"SELECT event_id, driver_id, session_type, count(*) AS n, sum(lap_time) AS total FROM {LONG_RUNS} q GROUP BY 1, 2, 3", d="total")
def _(v):
    runs = FL.long_run_laps(FL.practice_laps(v.b_lap), "FP1", "FP2", "FP3")
    return runs.groupBy("event_id", "driver_id", "session_type").agg(F.count(F.lit(1)).alias("n"), F.sum("lap_time").alias("total"))


@query("fl06_season_selection", "SELECT event_id, season_year, round_no FROM b_event WHERE season_year IN (1996, 1998)")
def _(v):
    return FL.seasons(v.b_event, [1996, 1998]).select("event_id", "season_year", "round_no")


@query("fl07_overdue_sessions", """
SELECT s.session_id, coalesce(t.status, 'pending') AS status FROM b_session s LEFT JOIN b_status t ON t.session_id = s.session_id
WHERE s.event_date < DATE '2000-01-15' AND coalesce(t.status, 'pending') <> 'completed'""")
def _(v):
    return FL.overdue(v.b_session, v.b_status, dt.date(2000, 1, 15)).select("session_id", "status")
