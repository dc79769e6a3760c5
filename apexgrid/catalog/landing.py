"""Queries for raw-frame mappers, merge sinks and reports."""
import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import scoring as SC, sinks_logic as SK
from ..plans import reports as RP
from ..session import shared_folder
from ..sources import mappers as MP, sinks as SI
from .bindings import RACING
from .learning import _LN02_LIST
from .lineups import oracle_scores
from .registry import query
from .scores_prices import nested_lineups
from .tables import _COST, _COVER, _MATCH, _TRANSFERS, coverage, run_races

KEYS = ["event_id", "driver_id"]


def _raw_laps(v):
    """Line items as raw laps of a timing feed; every seventh car is unknown to the entry list."""
    nan = F.lit(float("nan"))
    return v.lineitem.select(
        (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).cast("bigint").alias("session_id"), F.concat(F.lit("D"), F.col("l_suppkey").cast("string")).alias("Driver"),
        F.col("l_orderkey").alias("LapNumber"), F.when(F.col("l_linenumber") == 7, nan).otherwise(F.col("l_quantity")).alias("LapTime"),
        *[(F.col("l_quantity") * k).alias(f"Sector{i}Time") for i, k in ((1, 0.3), (2, 0.35), (3, 0.35))],
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(nan).alias("PitInTime"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("PitOutTime"),
        F.col("l_linenumber").cast("double").alias("Stint"), F.when(F.col("l_linenumber") == 6, "nan").otherwise(F.col("l_linestatus")).alias("Compound"),
        F.when(F.col("l_linenumber") == 5, nan).otherwise(F.col("l_quantity")).alias("TyreLife"), F.lit("1").alias("TrackStatus"), F.col("l_linenumber").cast("double").alias("Position"),
        F.lit(False).alias("IsPersonalBest"), (F.col("l_tax") > 0).alias("IsAccurate"))


def _entry_list(v):
    return v.supplier.where("s_suppkey % 7 <> 0").select(F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_suppkey").alias("driver_id"))


@query("src06_lap_mapper", """
SELECT year(l_shipdate) * 10 + quarter(l_shipdate) AS session_id, l_suppkey AS driver_id, count(*) AS n, sum(CASE WHEN l_linenumber <> 7 THEN l_quantity END) AS lap_time,
  count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS pit_in, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS pit_out, sum(CASE WHEN l_linenumber <> 5 THEN l_quantity END) AS tyre_life,
  count(CASE WHEN l_linenumber <> 6 THEN 1 END) AS compounds FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2""", d="lap_time", i="session_id tyre_life")
def _(v):
    rows, _skipped = MP.laps(_raw_laps(v), _entry_list(v))
    return rows.groupBy("session_id", "driver_id").agg(F.count(F.lit(1)).alias("n"), F.sum("lap_time").alias("lap_time"), F.count_if("is_pit_in").alias("pit_in"),
                                                       F.count_if("is_pit_out").alias("pit_out"), F.sum("tyre_life").alias("tyre_life"), F.count("compound").alias("compounds"))


@query("src06_unknown_codes", """
SELECT session_id, string_agg(c, ',' ORDER BY c) AS skipped FROM (SELECT DISTINCT year(l_shipdate) * 10 + quarter(l_shipdate) AS session_id, concat('D', cast(l_suppkey AS string)) AS c FROM lineitem WHERE l_suppkey % 7 = 0) x GROUP BY 1""", i="session_id")
def _(v):
    return MP.laps(_raw_laps(v), _entry_list(v))[1]


@query("src07_result_mapper", """
SELECT event_id AS session_id, driver_id, team_id, position, grid_position, CASE WHEN points = 0 THEN 0 ELSE points END AS points, fastest_lap_rank FROM b_result
WHERE code % 7 <> 0 AND (team_id // 10000) % 5 <> 0""", d="points")
def _(v):
    raw = v.b_result.select(
        F.col("event_id").alias("session_id"), F.col("driver_id").cast("string").alias("Abbreviation"), F.col("team_id").cast("string").alias("TeamName"), F.col("position").cast("double").alias("Position"),
        F.col("classified_position").alias("ClassifiedPosition"), F.col("grid_position").cast("double").alias("GridPosition"), F.col("status").alias("Status"),
        F.when(F.col("points") == 0, F.lit(float("nan"))).otherwise(F.col("points")).alias("Points"), F.lit(None).cast("double").alias("Time"), F.col("fastest_lap_rank").alias("FastestLapRank"))
    drivers = v.b_driver.where("code % 7 <> 0").select(F.col("driver_id").cast("string").alias("code"), "driver_id")
    teams = v.b_team.where("floor(team_id / 10000) % 5 <> 0").select(F.col("team_id").cast("string").alias("name"), "team_id")
    return MP.results(raw, drivers, teams)[0].select("session_id", "driver_id", "team_id", "position", "grid_position", "points", "fastest_lap_rank")


@query("src08_weather_mapper", """
SELECT o_custkey AS session_id, min(o_orderdate + to_seconds(o_orderkey)) AS first_sample, max(o_orderdate + to_seconds(o_orderkey)) AS last_sample, avg(o_totalprice) AS track_temp FROM orders GROUP BY 1""", s="first_sample last_sample", d="track_temp")
def _(v):
    raw = v.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("session_date"),
                          F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey").cast("decimal(18,6)")).alias("Time"), F.col("o_totalprice").alias("AirTemp"), F.col("o_totalprice").alias("TrackTemp"),
                          F.lit(0.5).alias("Humidity"), F.lit(1000.0).alias("Pressure"), F.lit(1.0).alias("WindSpeed"), F.lit(90).alias("WindDirection"), (F.col("o_orderpriority") == "1-URGENT").alias("Rainfall"))
    return MP.weather(raw).groupBy("session_id").agg(F.min("timestamp").alias("first_sample"), F.max("timestamp").alias("last_sample"), F.avg("track_temp").alias("track_temp"))


@query("src09_schedule_unpivot", """
SELECT e.event_id, k.st AS session_type, e.event_date AS date FROM b_event e JOIN (VALUES ('conventional', 'FP1'), ('conventional', 'FP2'), ('conventional', 'FP3'), ('conventional', 'Q'), ('conventional', 'R'),
  ('sprint', 'FP1'), ('sprint', 'SQ'), ('sprint', 'S'), ('sprint', 'Q')) AS k(fmt, st) ON k.fmt = e.event_format WHERE e.round_no <> 3""", s="date")
def _(v):
    normal = ["Practice 1", "Practice 2", "Practice 3", "Qualifying", "Race"]
    sprint = ["Practice 1", "Sprint Shootout", "Sprint", "Qualifying", "Grand Finale"]  # the last label is unknown
    is_sprint = F.col("event_format") == "sprint"
    raw = v.b_event.select("event_id", F.when(F.col("round_no") == 3, "testing").otherwise(F.col("event_format")).alias("EventFormat"),
                           *[F.when(is_sprint, s).otherwise(n).alias(f"Session{i}") for i, (n, s) in enumerate(zip(normal, sprint), 1)],
                           *[F.col("event_date").alias(f"Session{i}Date") for i in range(1, 6)])
    return MP.schedule(raw, ["event_id"])


# --- merge sinks: the table before is one half of the rows, the delivery overlaps it -----
@query("snk01_replace_by_session", "SELECT event_id, driver_id, CASE WHEN round_no = 1 THEN points ELSE points + 100 END AS points FROM b_result WHERE round_no <> 1 OR code % 2 = 0", d="points")
def _(v):
    old = v.b_result.select(*KEYS, "round_no", "code", (F.col("points") + 100).alias("points"))
    new = v.b_result.where("round_no = 1 AND code % 2 = 0").select(*KEYS, "round_no", "code", "points")
    return SK.replace_keys(old, new, ["event_id"]).select(*KEYS, "points")


@query("snk02_replace_by_season", "SELECT season_id, event_id, driver_id, CASE WHEN season_year = 1997 THEN 1 ELSE 0 END AS fresh FROM b_result", i="fresh")
def _(v):
    old = v.b_result.select("season_id", *KEYS, F.lit(0).alias("fresh"))
    return SK.replace_keys(old, v.b_result.where("season_year = 1997").select("season_id", *KEYS, F.lit(1).alias("fresh")), ["season_id"])


@query("snk03_replace_by_event_list", "SELECT event_id, driver_id, CASE WHEN round_no = 2 THEN price + 1 ELSE price END AS price FROM b_price", d="price")
def _(v):
    old = v.b_price.select(*KEYS, F.col("price").cast("double").alias("price"))
    return SK.replace_keys(old, v.b_price.where("round_no = 2").select(*KEYS, (F.col("price") + 1).cast("double").alias("price")), ["event_id"])


@query("snk04_upsert", "SELECT event_id, driver_id, CASE WHEN round_no >= 3 THEN price + 5 ELSE price END AS price FROM b_price", d="price")
def _(v):
    return SK.upsert(*_delivery(v), KEYS)[0]


@query("snk04_upsert_counts", """SELECT action, count(*) AS n FROM (SELECT CASE WHEN round_no = 4 THEN 'created' WHEN round_no = 3 THEN 'updated' ELSE 'kept' END AS action FROM b_price) x GROUP BY 1""")
def _(v):
    return SK.upsert(*_delivery(v), KEYS)[1]


def _delivery(v):
    """Table of rounds 1-3; a delivery of rounds 3-4 in which every key comes twice, the later row counts."""
    old = v.b_price.where("round_no <= 3").select(*KEYS, F.col("price").cast("double").alias("price"))
    fresh = v.b_price.where("round_no >= 3").select(*KEYS, F.col("price").cast("double").alias("price"))
    twice = fresh.withColumn("n", F.lit(1)).unionByName(fresh.withColumns({"price": F.col("price") + 5, "n": F.lit(2)}))
    return old, SK.last_in_file(twice, KEYS, "n").drop("n")


@query("snk05_insert_if_absent", "SELECT driver_id, CASE WHEN code % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM b_driver")
def _(v):
    old = v.b_driver.where("code % 2 = 0").select("driver_id", F.lit("old").alias("origin"))
    return SK.insert_missing(old, v.b_driver.select("driver_id", F.lit("new").alias("origin")), ["driver_id"])


@query("snk06_upsert_with_rename", """
SELECT team_id, CASE WHEN k = 0 THEN team_code WHEN k = 1 THEN concat(team_code, ' Racing') ELSE team_code END AS name, CASE WHEN k = 2 THEN 'fresh' ELSE 'c' END AS code,
  CASE WHEN k = 0 THEN 'updated' WHEN k = 1 THEN 'renamed' ELSE 'created' END AS action FROM (SELECT team_id, team_code, (team_id // 10000) % 3 AS k FROM b_team) x""")
def _(v):
    # a third known by name, a third known by label and renamed, a third new
    k = F.floor(F.col("team_id") / 10000) % 3
    old = v.b_team.where(k < 2).select("season_id", "team_id", F.col("team_code").alias("name"), F.lit("c").alias("code"))
    new = v.b_team.select("season_id", F.when(k == 1, F.concat("team_code", F.lit(" Racing"))).otherwise(F.col("team_code")).alias("name"), F.col("team_code").alias("label"),
                          F.when(k == 2, "fresh").otherwise("").alias("code"), F.col("team_id").alias("fresh_id"))
    return SK.upsert_with_rename(old, new).select("team_id", "name", "code", "action")


_RUN_SQL = "SELECT cast(config_id AS bigint) AS run_id, {} FROM b_run_race"


def _runs(v):
    """Three runs through the sink: the first has a crashed attempt before it, the second is done twice, the third comes empty first."""
    root = f"{shared_folder(v.spark)}/runs-{uuid.uuid4().hex}"
    rows = run_races(v)
    of = lambda c: rows.where(F.col("config_id") == c).select("event_id", "mae_position", "mae_points", "lineup_actual", "optimal_actual")
    SI.write_run(v.spark, root, 1, of(1).limit(5), optimizer="crashed")  # never published
    assert not SI.append_run(v.spark, root, 3, of(3).limit(0))
    for c, optimizer in ((2, "first"), (1, "greedy"), (2, "exact"), (3, "sampled")):
        SI.append_run(v.spark, root, c, of(c), optimizer=optimizer)
    return SI.read_runs(v.spark, root)


@query("snk07_run_rows", _RUN_SQL.format("max(optimizer) AS optimizer, count(*) AS races, avg(mae_position) AS mae_position, avg(mae_points) AS mae_points, sum(lineup_actual) AS lineup_actual, sum(optimal_actual) AS optimal_actual")
       + " GROUP BY 1", d="mae_position mae_points lineup_actual optimal_actual")
def _(v):
    return _runs(v)[0].select("run_id", "optimizer", "races", "mae_position", "mae_points", "lineup_actual", "optimal_actual")


@query("snk07_race_rows", _RUN_SQL.format("event_id, mae_position, mae_points, lineup_actual, optimal_actual"), d="mae_position mae_points lineup_actual optimal_actual")
def _(v):
    return _runs(v)[1].select("run_id", "event_id", "mae_position", "mae_points", "lineup_actual", "optimal_actual")


_SKIPPED = """LEFT JOIN (SELECT session_id, string_agg(c, ', ' ORDER BY c) AS skipped FROM (SELECT DISTINCT year(l_shipdate) * 10 + quarter(l_shipdate) AS session_id, concat('D', cast(l_suppkey AS string)) AS c FROM lineitem WHERE l_suppkey % 7 = 0) x GROUP BY 1) k
ON k.session_id = l.session_id"""


@query("snk08_ingest_audit", f"""
SELECT l.session_id, 'completed' AS status, l.n AS lap_count, coalesce(w.n, 0) AS weather_sample_count, k.skipped FROM
(SELECT year(l_shipdate) * 10 + quarter(l_shipdate) AS session_id, count(CASE WHEN l_suppkey % 7 <> 0 THEN 1 END) AS n FROM lineitem GROUP BY 1) l
LEFT JOIN (SELECT weekend_id, count(*) AS n FROM b_weather GROUP BY 1) w ON w.weekend_id = l.session_id {_SKIPPED}""", i="session_id")
def _(v):
    rows, skipped = MP.laps(_raw_laps(v), _entry_list(v))
    results = v.b_result.select(F.col("weekend_id").alias("session_id"))
    return MP.audit(rows, results, v.b_weather.select(F.col("weekend_id").alias("session_id")), skipped).select("session_id", "status", "lap_count", "weather_sample_count", "skipped")


# every third session has lap records that are cut off, and has failed before as often as its quarter says
_AUDIT = f"""SELECT l.session_id, CASE WHEN l.broken > 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN l.broken > 0 THEN 0 ELSE l.n END AS lap_count,
CASE WHEN l.broken > 0 THEN 0 ELSE coalesce(w.n, 0) END AS weather_sample_count, CASE WHEN l.broken > 0 THEN '' ELSE k.skipped END AS skipped, l.session_id % 10 + CASE WHEN l.broken > 0 THEN 1 ELSE 0 END AS retry_count,
CASE WHEN l.broken > 0 THEN concat(l.broken, ' unusable lap records') ELSE '' END AS error_message FROM
(SELECT year(l_shipdate) * 10 + quarter(l_shipdate) AS session_id, count(CASE WHEN l_suppkey % 7 <> 0 THEN 1 END) AS n,
  count(CASE WHEN (year(l_shipdate) * 10 + quarter(l_shipdate)) % 3 = 0 AND l_linenumber IN (3, 4) THEN 1 END) AS broken FROM lineitem GROUP BY 1) l
LEFT JOIN (SELECT weekend_id, count(*) AS n FROM b_weather GROUP BY 1) w ON w.weekend_id = l.session_id {_SKIPPED}"""


def _audited(v):
    raw, cut = _raw_laps(v), F.col("session_id") % 3 == 0
    raw = raw.withColumns({"LapNumber": F.when(~(cut & (F.col("Stint") == 3)), F.col("LapNumber").cast("double")), "Driver": F.when(~(cut & (F.col("Stint") == 4)), F.col("Driver"))})
    rows, skipped = MP.laps(raw, _entry_list(v))
    session = lambda df: df.select(F.col("weekend_id").alias("session_id"))
    earlier = raw.select("session_id", (F.col("session_id") % 10).cast("int").alias("retry_count")).distinct()
    return MP.audit(rows, session(v.b_result), session(v.b_weather), skipped, MP.failures(raw), earlier)


@query("snk08_failed_sessions", _AUDIT, i="session_id retry_count lap_count weather_sample_count")
def _(v):
    return _audited(v).select("session_id", "status", "lap_count", "weather_sample_count", "skipped", "retry_count", "error_message")


@query("snk08_run_totals", f"""SELECT count(CASE WHEN status = 'completed' THEN 1 END) AS sessions_processed, count(CASE WHEN status = 'failed' THEN 1 END) AS sessions_skipped, sum(lap_count) AS lap_count,
sum(retry_count) AS retry_count FROM ({_AUDIT}) a""", i="lap_count retry_count")
def _(v):
    return MP.run_totals(_audited(v))


# --- reports ---------------------------------------------------------------
def _dashboard(v):
    v.stage(*RACING)
    lines = nested_lineups(v)
    mine = lines.join(SC.lineup_points(lines, v.b_total, v.b_ctotal, ["event_id"]), "event_id")
    r = run_races(v)
    recs = r.select("event_id", F.col("config_id").alias("rec_id"), (F.col("event_id") * 10 + F.col("config_id") * 7 % 5).alias("created_at"), (F.col("optimal_actual") * 0.5).alias("ml_predicted"),
                    F.col("lineup_actual").alias("ml_actual"), F.col("optimal_actual").alias("oracle"))
    return RP.season_dashboard(mine, recs)


from .scores_prices import _LINEUP_PTS, _TEAM_PTS

_DASH = _TRANSFERS + f""", pts AS (SELECT a.event_id, a.pts + b.pts AS actual_points FROM ({_LINEUP_PTS}) a JOIN ({_TEAM_PTS}) b ON b.event_id = a.event_id),
rec AS (SELECT event_id, lineup_actual AS ml_actual, optimal_actual AS oracle, row_number() OVER (PARTITION BY event_id ORDER BY event_id * 10 + config_id * 7 % 5 DESC, config_id DESC) AS rn FROM b_run_race),
dash AS (SELECT n.event_id, n.season_id, n.n_transfers, p.actual_points, r.ml_actual, r.oracle, r.oracle - p.actual_points AS left_on_table, coalesce(p.actual_points > r.ml_actual, false) AS beat_ml
  FROM n JOIN pts p ON p.event_id = n.event_id LEFT JOIN rec r ON r.event_id = n.event_id AND r.rn = 1)"""


@query("rp01_season_dashboard", _DASH + " SELECT event_id, n_transfers, actual_points, ml_actual, oracle, left_on_table, beat_ml FROM dash", d="actual_points ml_actual oracle left_on_table", i="n_transfers")
def _(v):
    return _dashboard(v).select("event_id", "n_transfers", "actual_points", "ml_actual", "oracle", "left_on_table", "beat_ml")


@query("rp01_season_totals", _DASH + """ SELECT season_id, coalesce(sum(actual_points), 0) AS my_total, coalesce(sum(ml_actual), 0) AS ml_total, coalesce(sum(oracle), 0) AS oracle_total,
  coalesce(sum(actual_points), 0) - coalesce(sum(ml_actual), 0) AS vs_ml, coalesce(sum(actual_points), 0) - coalesce(sum(oracle), 0) AS vs_oracle, count(CASE WHEN beat_ml THEN 1 END) AS races_beat FROM dash GROUP BY 1""",
       d="my_total ml_total oracle_total vs_ml vs_oracle")
def _(v):
    return RP.season_totals(_dashboard(v))


@query("rp02_race_sheet", """SELECT p.event_id, p.driver_id, p.predicted_points, x.price, row_number() OVER (PARTITION BY p.event_id ORDER BY p.predicted_points DESC, p.driver_id) AS sheet_rank
FROM b_pred p LEFT JOIN b_price x ON x.event_id = p.event_id AND x.driver_id = p.driver_id""", d="predicted_points price")
def _(v):
    return RP.race_sheet(v.b_pred, v.b_price).select(*KEYS, "predicted_points", "price", "sheet_rank")


def _difference_sql(old: str, new: str, name: str) -> str:
    return f"""array_to_string(list_sort(list_filter({old}, lambda z: NOT list_contains({new}, z))), ',') AS {name}_dropped,
array_to_string(list_sort(list_filter({new}, lambda z: NOT list_contains({old}, z))), ',') AS {name}_added, len(list_filter({old}, lambda z: list_contains({new}, z))) AS {name}_kept"""


@query("rp02_lineup_difference", f"""SELECT event_id, {_difference_sql('d', 'ds', 'drivers')}, {_difference_sql('c', 'ts', 'teams')} FROM (
SELECT l.event_id, [l.d1, l.d2, l.d3, l.d4, l.d5] AS d, [l.c1, l.c2] AS c, r.ds, r.ts FROM b_lineup l JOIN {_LN02_LIST} r ON r.event_id = l.event_id) x""", i="drivers_kept teams_kept")
def _(v):
    from .learning import recommendations
    return RP.lineup_diff(nested_lineups(v), recommendations(v)).select("event_id", "drivers_dropped", "drivers_added", "drivers_kept", "teams_dropped", "teams_added", "teams_kept")


@query("rp03_run_explorer", "SELECT event_id, config_id AS run_id FROM (SELECT event_id, config_id, event_date FROM b_run_race ORDER BY event_date DESC, event_id DESC, config_id DESC LIMIT 25) x", i="run_id")
def _(v):
    r = run_races(v).select("event_id", F.col("config_id").alias("run_id"), F.concat(F.col("event_date").cast("string"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("created_at"))
    return RP.runs_page(r, 1).select("event_id", "run_id")


@query("rp04_price_trajectory", """SELECT season_id, driver_id, arg_min(price, round_no) AS first_price, arg_max(price, round_no) AS last_price, arg_max(price, round_no) - arg_min(price, round_no) AS net,
  max(CASE WHEN round_no = 1 THEN price END) AS "1", max(CASE WHEN round_no = 2 THEN price END) AS "2", max(CASE WHEN round_no = 3 THEN price END) AS "3", max(CASE WHEN round_no = 4 THEN price END) AS "4" FROM b_price GROUP BY 1, 2""",
       d='first_price last_price net "1" "2" "3" "4"')
def _(v):
    return RP.price_trajectory(v.b_price, "driver_id", [1, 2, 3, 4])


query("rp05_data_coverage", _COVER)(coverage)


@query("rp05_gaps", """SELECT s.session_id FROM b_session s LEFT JOIN b_status t ON t.session_id = s.session_id WHERE s.event_date < DATE '1999-05-01' AND coalesce(t.status, 'pending') <> 'completed'""")
def _(v):
    return RP.gaps(v.b_session, v.b_status, dt.date(1999, 5, 1)).select("session_id")


@query("rp06_session_list", "SELECT s.session_id, coalesce(t.status, 'pending') AS status FROM b_session s LEFT JOIN b_status t ON t.session_id = s.session_id")
def _(v):
    return RP.session_list(v.b_session, v.b_status).select("session_id", "status")


@query("rp07_next_event", "SELECT series, coalesce(min(CASE WHEN event_date >= DATE '1998-02-10' - 3 THEN event_id END), max(event_id)) AS event_id FROM b_event GROUP BY 1")
def _(v):
    return RP.next_event(v.b_event, dt.date(1998, 2, 10))
