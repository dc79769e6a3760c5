"""Queries for joins, aggregates, windows on line-ups, top-k, nested values and metrics."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as A, joins as J, ledger as G, nested as N, topk as K, windows as W
from ..plans import evaluation as E
from .registry import query
from .scores_prices import nested_lineups

KEYS = ["event_id", "driver_id"]


# --- joins -----------------------------------------------------------------
@query("jn01_case_insensitive_name", """
SELECT s.s_suppkey, n.k FROM supplier s LEFT JOIN (SELECT lower(s_name) AS n, s_nationkey AS g, min(s_suppkey) AS k FROM supplier GROUP BY 1, 2) n
ON n.n = lower(CASE WHEN s.s_suppkey % 7 = 0 THEN 'nobody' ELSE s.s_name END) AND n.g = s.s_nationkey""")
def _(v):
    rows = v.supplier.select("s_suppkey", F.col("s_nationkey").alias("g"), F.when(F.col("s_suppkey") % 7 == 0, "nobody").otherwise(F.upper("s_name")).alias("label"))
    names = v.supplier.select(F.col("s_nationkey").alias("g"), "s_name", F.col("s_suppkey").alias("k"))
    return J.by_name(rows, names, "label", "s_name", "k", ["g"]).select("s_suppkey", "k")


@query("jn02_substring_event", """
SELECT p.p_partkey, p.season_id, e.event_id FROM (SELECT p_partkey, p_partkey % 5 * 0 + 1995 + p_partkey % 7 AS season_id, concat('REGION ', cast(p_partkey % 6 AS string)) AS t FROM part) p
LEFT JOIN (SELECT season_id, lower(event_name) AS n, min(event_id) AS event_id FROM b_event GROUP BY 1, 2) e ON e.season_id = p.season_id AND contains(e.n, lower(p.t))""", i="season_id")
def _(v):
    rows = v.part.select("p_partkey", (F.col("p_partkey") % 7 + 1995).alias("season_id"), F.concat(F.lit("REGION "), (F.col("p_partkey") % 6).cast("string")).alias("race"))
    return J.first_containing(rows, v.b_event, "race", ["season_id"]).select("p_partkey", "season_id", "event_id")


_MATCH = "b_pred p JOIN b_result r ON r.event_id = p.event_id AND r.driver_id = p.driver_id AND r.position IS NOT NULL JOIN b_total t ON t.event_id = p.event_id AND t.driver_id = p.driver_id"


def _actuals(v):
    v.stage("b_agg", "b_rank", "b_score", "b_total")
    return v.b_result.select(*KEYS, "position").join(v.b_total.select(*KEYS, F.col("race_total").alias("actual_points")), KEYS)


def pred_pairs(v):
    p = v.b_pred.select(*KEYS, "predicted_position", "predicted_points", "lower", "upper")
    return E.pairs(p, _actuals(v))


@query("jn08_prediction_actual", f"SELECT p.event_id, p.driver_id, p.predicted_points, r.position AS actual_position, t.race_total AS actual_points FROM {_MATCH}", d="predicted_points actual_position actual_points")
def _(v):
    return J.matched(v.b_pred.select(*KEYS, "predicted_points"), _actuals(v)).select(*KEYS, "predicted_points", "actual_position", "actual_points")


@query("jn09_session_actuals", """
SELECT q.event_id, q.driver_id, q.position, coalesce(s.p, 0) AS actual_points FROM b_quali q LEFT JOIN (SELECT event_id, driver_id, sum(points) AS p FROM b_score WHERE event_type = 'qualifying' GROUP BY 1, 2) s
ON s.event_id = q.event_id AND s.driver_id = q.driver_id WHERE q.position IS NOT NULL""", d="actual_points")
def _(v):
    v.stage("b_agg", "b_rank", "b_score")
    return J.session_actuals(v.b_quali, v.b_score, "Q", ["qualifying"]).select(*KEYS, "position", "actual_points")


@query("jn10_status_lookup", "SELECT s.session_id, (SELECT t.status FROM b_status t WHERE t.session_id = s.session_id) AS status FROM b_session s")
def _(v):
    return v.b_session.join(v.b_status.select("session_id", "status"), "session_id", "left").select("session_id", "status")


@query("jn14_previous_season_fallback", """
SELECT t.team_id, coalesce(c.m, p.m) AS mean_position FROM b_team t LEFT JOIN (SELECT team_id, avg(position) AS m FROM b_result WHERE round_no = 1 AND (team_id // 10000) % 3 <> 0 GROUP BY 1) c ON c.team_id = t.team_id
LEFT JOIN (SELECT team_code, season_year + 1 AS season_year, avg(position) AS m FROM b_result GROUP BY 1, 2) p ON p.team_code = t.team_code AND p.season_year = t.season_year""", d="mean_position")
def _(v):
    # current rows by team id; only teams without any use last season's rows of the same code
    now = v.b_result.where("round_no = 1 AND floor(team_id / 10000) % 3 <> 0").groupBy("team_id").agg(F.avg("position").alias("mean_position"))
    have = now.where("mean_position IS NOT NULL")
    empty = v.b_team.join(have, "team_id", "left_anti")
    prev = v.b_result.groupBy("team_code", (F.col("season_year") + 1).alias("season_year")).agg(F.avg("position").alias("mean_position"))
    return empty.join(prev, ["team_code", "season_year"], "left").select("team_id", "mean_position").unionByName(have)


@query("jn15_priced_predictions", "SELECT p.event_id, p.driver_id, p.predicted_points, p.lower, p.upper, x.price FROM b_pred p JOIN b_price x ON x.event_id = p.event_id AND x.driver_id = p.driver_id", d="price predicted_points lower upper")
def _(v):
    return J.priced(v.b_pred.select(*KEYS, "predicted_points", "lower", "upper"), v.b_price)


@query("jn16_team_rollup", """
SELECT c.event_id, c.team_id, c.price, coalesce(sum(p.predicted_points), 0) AS predicted_points, coalesce(sum(p.upper), 0) AS upper
FROM b_cprice c LEFT JOIN b_pred p ON p.event_id = c.event_id AND p.team_id = c.team_id GROUP BY 1, 2, 3""", d="price predicted_points upper")
def _(v):
    return J.team_rollup(v.b_cprice, v.b_driver, v.b_pred.select(*KEYS, "predicted_points", "upper"), ["predicted_points", "upper"])


@query("jn18_config_sweep", """
SELECT c.config_id, p.event_id, sum(p.predicted_points * c.k) AS total FROM b_pred p JOIN (VALUES (1, 0.5), (2, 1.0), (3, 1.5)) AS c(config_id, k) ON true GROUP BY 1, 2""", d="total", i="config_id")
def _(v):
    # a fixed number of configurations becomes a key of every row
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("config_id"), F.lit(k).alias("k")) for i, k in ((1, 0.5), (2, 1.0), (3, 1.5))]))
    return v.b_pred.withColumn("_c", grid).groupBy("_c.config_id", "event_id").agg(F.sum(F.col("predicted_points") * F.col("_c.k")).alias("total"))


@query("jn19_walk_forward_splits", """
WITH i AS (SELECT DISTINCT event_date, dense_rank() OVER (ORDER BY event_date) - 1 AS k FROM b_event)
SELECT t.k AS test_index, count(*) AS n_train FROM i t JOIN i r ON r.k < t.k WHERE t.k >= 5 GROUP BY 1""")
def _(v):
    return J.walk_forward(W.event_index(v.b_event, []), 5)


# --- aggregates ------------------------------------------------------------
@query("ag01_event_total", "SELECT event_id, driver_id, sum(points) AS race_total FROM b_score GROUP BY 1, 2", i="race_total")
def _(v):
    v.stage("b_agg", "b_rank", "b_score")
    return A.event_totals(W.stamp_event_total(v.b_score), "driver_id")


@query("ag02_points_by_session_kind", "SELECT event_id, driver_id, sum(points) AS points FROM b_score WHERE event_type IN ('qualifying', 'sprint_qualifying') GROUP BY 1, 2", i="points")
def _(v):
    v.stage("b_agg", "b_rank", "b_score")
    return A.points_of(v.b_score, "qualifying", "sprint_qualifying")


_KINDS = "count(CASE WHEN s.hh <> 0 THEN 1 END) AS with_results, count(CASE WHEN s.hh <> 1 THEN 1 END) AS with_laps, count(CASE WHEN s.hh <> 2 THEN 1 END) AS with_weather"
_COVER = f"""SELECT s.season_id, count(*) AS total, count(CASE WHEN s.event_date < DATE '1998-06-01' THEN 1 END) AS past, count(CASE WHEN t.status = 'completed' THEN 1 END) AS completed,
  count(CASE WHEN t.status = 'failed' THEN 1 END) AS failed, count(*) - count(CASE WHEN t.status IN ('completed', 'failed') THEN 1 END) AS pending, {_KINDS}
FROM b_session s LEFT JOIN b_status t ON t.session_id = s.session_id GROUP BY 1"""


def coverage(v):
    import datetime as dt
    s = v.b_session
    return A.coverage(s, v.b_status, dt.date(1998, 6, 1), s.where("hh <> 0"), s.where("hh <> 1"), s.where("hh <> 2"))


query("ag18_coverage", _COVER)(coverage)

_DATA = """SELECT y.season_year, coalesce(a.n, 0) AS prices, coalesce(b.n, 0) AS scores, coalesce(c.n, 0) AS lineups FROM (SELECT DISTINCT season_year FROM b_event) y
LEFT JOIN (SELECT season_year, count(DISTINCT event_id) AS n FROM b_price GROUP BY 1) a ON a.season_year = y.season_year
LEFT JOIN (SELECT season_year, count(DISTINCT event_id) AS n FROM b_score GROUP BY 1) b ON b.season_year = y.season_year
LEFT JOIN (SELECT season_year, count(DISTINCT event_id) AS n FROM b_lineup GROUP BY 1) c ON c.season_year = y.season_year"""


@query("ag19_events_with_data", _DATA)
def _(v):
    v.stage("b_agg", "b_rank", "b_score")
    return A.events_with_data("season_year", prices=v.b_price, scores=v.b_score, lineups=v.b_lineup)


_SUM = """avg(mae_position) AS mae_position, avg(mae_points) AS mae_points, sum(lineup_actual) AS lineup_actual, sum(optimal_actual) AS optimal_actual, sum(optimal_actual) - sum(lineup_actual) AS left_on_table"""
_SUM_D = "mae_position mae_points lineup_actual optimal_actual left_on_table"


def run_races(v):
    v.stage("b_agg", "b_event", "b_driver", "b_rank", "b_score", "b_total")
    return v.b_run_race.withColumns({c: F.col(c).cast("double") for c in _SUM_D.split()[:4]}).withColumn("config_id", F.col("config_id").cast("bigint"))


@query("ag20_metric_means", f"SELECT cast(config_id AS bigint) AS config_id, count(*) AS races, {_SUM} FROM b_run_race GROUP BY 1", d=_SUM_D)
def _(v):
    return A.metric_summary(run_races(v), ["config_id"])


@query("ag21_season_summary", f"SELECT cast(config_id AS bigint) AS config_id, season_year, count(*) AS races, {_SUM} FROM b_run_race GROUP BY 1, 2", d=_SUM_D)
def _(v):
    return A.metric_summary(run_races(v), ["config_id", "season_year"])


@query("ag22_best_config", f"""WITH r AS (SELECT config_id, {_SUM} FROM b_run_race GROUP BY 1)
SELECT arg_min(config_id, mae_position) AS best_mae_config, min(mae_position) AS best_mae, arg_max(config_id, lineup_actual) AS best_points_config, max(lineup_actual) AS best_points FROM r""",
       d="best_mae best_points", i="best_mae_config best_points_config")
def _(v):
    return A.best_configs(A.metric_summary(run_races(v), ["config_id"]))


_MOVES = "SELECT season_id, driver_id, arg_min(price, round_no) AS first_price, arg_max(price, round_no) AS last_price, round(arg_max(price, round_no) - arg_min(price, round_no), 1) AS net FROM b_price GROUP BY 1, 2"


@query("ag23_price_moves", _MOVES, d="first_price last_price net")
def _(v):
    return A.price_moves(v.b_price, "driver_id")


_CELLS = ", ".join(f'max(CASE WHEN round_no = {r} THEN price END) AS "{r}"' for r in (1, 2, 3, 4))


@query("ag24_price_matrix", f"SELECT season_id, driver_id, {_CELLS} FROM b_price GROUP BY 1, 2", d='"1" "2" "3" "4"')
def _(v):
    return A.price_matrix(v.b_price, "driver_id", [1, 2, 3, 4])


# --- windows on line-ups and events ---------------------------------------
_TRANSFERS = """
WITH u AS (SELECT season_id, round_no, event_id, [d1, d2, d3, d4, d5] AS d, [c1, c2] AS c FROM b_lineup),
p AS (SELECT *, lag(d) OVER w AS pd, lag(c) OVER w AS pc, row_number() OVER w AS k FROM u WINDOW w AS (PARTITION BY season_id ORDER BY round_no)),
n AS (SELECT season_id, round_no, event_id, k, CASE WHEN pd IS NULL THEN 0 ELSE len(list_filter(d, lambda x: NOT list_contains(pd, x))) + len(list_filter(c, lambda x: NOT list_contains(pc, x))) END AS n_transfers FROM p)"""


@query("wn15_transfers", _TRANSFERS + " SELECT event_id, n_transfers FROM n", i="n_transfers")
def _(v):
    return W.transfers(nested_lineups(v), ["season_id"]).select("event_id", "n_transfers")


@query("ln08_banked_transfers", _TRANSFERS + """, f AS (
  SELECT season_id, k, event_id, n_transfers, 2 AS free_before, least(2, 2 - least(n_transfers, 2) + 1) AS free_after FROM n WHERE k = 1
  UNION ALL SELECT n.season_id, n.k, n.event_id, n.n_transfers, f.free_after, least(2, f.free_after - least(n.n_transfers, f.free_after) + 1) FROM f JOIN n ON n.season_id = f.season_id AND n.k = f.k + 1)
SELECT event_id, n_transfers, free_before, free_after FROM f""", i="n_transfers free_before free_after")
def _(v):
    return G.banked_transfers(nested_lineups(v)).drop("season_id")


_COST = """(SELECT l.event_id AS lid, l.ev, CASE WHEN count(x.price) = 7 THEN sum(x.price) END AS v FROM (
  SELECT event_id, ev, unnest([d1, d2, d3, d4, d5, c1, c2]) AS id, unnest([1, 1, 1, 1, 1, 2, 2]) AS kind FROM l2) l
  LEFT JOIN (SELECT event_id, driver_id AS id, 1 AS kind, price FROM b_price UNION ALL SELECT event_id, team_id, 2, price FROM b_cprice) x ON x.event_id = l.ev AND x.id = l.id AND x.kind = l.kind GROUP BY 1, 2)"""


@query("ln09_budgets", f"""
WITH l1 AS (SELECT *, lead(event_id) OVER (PARTITION BY season_id ORDER BY round_no) AS nxt FROM b_lineup),
l2 AS (SELECT *, event_id AS ev FROM l1 UNION ALL SELECT *, nxt AS ev FROM l1 WHERE nxt IS NOT NULL),
c AS {_COST},
j AS (SELECT l1.event_id, l1.season_id, row_number() OVER (PARTITION BY l1.season_id ORDER BY l1.round_no) AS k, a.v AS cost, b.v AS nv
  FROM l1 LEFT JOIN c a ON a.lid = l1.event_id AND a.ev = l1.event_id LEFT JOIN c b ON b.lid = l1.event_id AND b.ev = l1.nxt),
f AS (SELECT event_id, season_id, k, cost, nv, CASE WHEN cost IS NOT NULL THEN cast(100 AS decimal(18,1)) END AS cap FROM j WHERE k = 1
  UNION ALL SELECT j.event_id, j.season_id, j.k, j.cost, j.nv, CASE WHEN j.cost IS NOT NULL THEN cast(f.cap - f.cost + f.nv AS decimal(18,1)) END FROM f JOIN j ON j.season_id = f.season_id AND j.k = f.k + 1)
SELECT event_id, cost AS team_cost, cap AS budget_cap, cap - cost + nv AS available_next, coalesce(cost > cap, false) AS over_budget FROM f""", d="team_cost budget_cap available_next")
def _(v):
    v.stage("b_agg", "b_event", "b_driver", "b_rank")
    return G.budgets(nested_lineups(v), v.b_price, v.b_cprice).select("event_id", "team_cost", "budget_cap", "available_next", "over_budget")


_ENTRY = "SELECT l.event_id AS entry_id, CASE WHEN l.event_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN l.event_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN l.event_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM b_lineup l"


@query("ln10_lineup_validation", f"SELECT entry_id, n AS n_reasons FROM ({_ENTRY}) x", i="n_reasons")
def _(v):
    # entries as typed text: one in five has an unknown car, one in four a foreign boost, one in three is too dear
    v.stage("b_agg", "b_driver")
    code = lambda c: F.floor(F.col(c) / 10000).cast("string")
    e = v.b_lineup.select(
        F.col("event_id").alias("entry_id"), "season_id", "event_id",
        F.array(F.when(F.col("event_id") % 5 == 0, F.lit("zzz")).otherwise(F.concat(F.lit(" d"), code("d5"))), *[F.concat(F.lit("d"), code(f"d{i}")) for i in (1, 2, 3, 4)]).alias("codes"),
        F.array(*[F.concat(F.lit("t"), code(c)) for c in ("c1", "c2")]).alias("team_names"),
        F.when(F.col("event_id") % 4 == 0, F.lit("d-1")).otherwise(F.concat(F.lit("D"), code("boost"))).alias("boost"))
    drivers = v.b_driver.select("season_id", F.concat(F.lit("D"), F.col("code").cast("string")).alias("code"), "driver_id")
    teams = v.b_team.select("season_id", F.col("team_code").alias("team_name"), "team_id")
    budget = e.select("entry_id", F.when(F.col("event_id") % 3 == 0, 101).otherwise(99).alias("cost"), F.lit(100).alias("cap"))
    return G.validate(e, drivers, teams, budget).select("entry_id", F.size("reasons").alias("n_reasons"))


@query("wn16_event_index", "SELECT event_id, dense_rank() OVER (ORDER BY event_date) - 1 AS event_index FROM b_event")
def _(v):
    return W.event_index(v.b_event, []).select("event_id", "event_index")


@query("wn17_group_sizes", "SELECT dense_rank() OVER (ORDER BY event_date) - 1 AS event_index, count(*) AS n FROM b_result GROUP BY event_date")
def _(v):
    return W.group_sizes(v.b_result.join(W.event_index(v.b_event, []).select("event_id", "event_index"), "event_id"))


@query("wn18_latest_per_event", "SELECT event_id, arg_max(config_id, event_id * 10 + config_id * 7 % 5) AS config_id FROM (SELECT event_id, config_id FROM b_run_race) r GROUP BY 1", i="config_id")
def _(v):
    r = run_races(v).withColumn("created_at", F.col("event_id") * 10 + F.col("config_id") * 7 % 5)
    return W.latest_per(r, ["event_id"], F.col("created_at").desc(), F.col("config_id").desc()).select("event_id", "config_id")


# --- sorts and top-k -------------------------------------------------------
@query("tk01_global_sort", "SELECT event_id, driver_id, predicted_points, row_number() OVER (PARTITION BY event_id ORDER BY predicted_points DESC, driver_id) AS rk FROM b_pred ORDER BY event_id, rk")
def _(v):
    from ..functions.ranking import ordinal_rank
    rk = ordinal_rank(["event_id"], F.col("predicted_points").desc(), F.col("driver_id"))
    return v.b_pred.select(*KEYS, "predicted_points", rk.alias("rk")).orderBy("event_id", "rk")


@query("tk02_top_ten", """
SELECT event_id, driver_id, rk AS rank FROM (SELECT event_id, driver_id, row_number() OVER (PARTITION BY event_id ORDER BY points DESC, driver_id) AS rk, count(*) OVER (PARTITION BY event_id) AS n FROM b_result) x WHERE rk <= 10 AND n >= 10""")
def _(v):
    return K.top_set(v.b_result.select(*KEYS, "points"), ["event_id"], [F.col("points").desc(), F.col("driver_id")]).select(*KEYS, "rank")


@query("tk03_first_by_order", "SELECT season_id, arg_max(event_id, event_date) AS last_event FROM b_event GROUP BY 1")
def _(v):
    return K.first_by(v.b_event, ["season_id"], "event_date", ["event_id"]).select("season_id", F.col("event_id").alias("last_event"))


@query("tk04_page", "SELECT event_id, event_name FROM b_event ORDER BY event_date DESC, event_id DESC LIMIT 25 OFFSET 25")
def _(v):
    return K.page(v.b_event.select("event_id", "event_name", "event_date"), [F.col("event_date").desc(), F.col("event_id").desc()], 2)[0].select("event_id", "event_name")


@query("tk05_cheapest_two", "SELECT event_id, sum(price) AS reserve FROM (SELECT event_id, price, row_number() OVER (PARTITION BY event_id ORDER BY price) AS rn FROM b_cprice) x WHERE rn <= 2 GROUP BY 1", d="reserve")
def _(v):
    return K.cheapest_sum(v.b_cprice, ["event_id"])


# --- sets and nested -------------------------------------------------------
@query("st01_lineup_difference", """
WITH u AS (SELECT event_id, season_id, round_no, unnest([d1, d2, d3, d4, d5]) AS id FROM b_lineup),
p AS (SELECT a.event_id, a.id, b.id AS old FROM u a LEFT JOIN u b ON b.season_id = a.season_id AND b.round_no = a.round_no - 1 AND b.id = a.id WHERE a.round_no > 2)
SELECT event_id, coalesce(string_agg(CASE WHEN old IS NULL THEN cast(id AS string) END, ',' ORDER BY id), '') AS drivers_added, count(old) AS drivers_kept FROM p GROUP BY 1""")
def _(v):
    from pyspark.sql import Window
    w = Window.partitionBy("season_id").orderBy("round_no")
    df = nested_lineups(v).withColumn("old", F.lag("driver_ids").over(w)).where("old IS NOT NULL")
    return N.difference(df, "old", "driver_ids", "drivers").select("event_id", "drivers_added", "drivers_kept")


@query("st02_row_union", "SELECT session_type, count(*) AS n, count(position) AS placed FROM b_results_all GROUP BY 1")
def _(v):
    frames = [v.b_result, v.b_quali, v.b_sprint, v.b_sq]
    return reduce(DataFrame.unionByName, frames).groupBy("session_type").agg(F.count(F.lit(1)).alias("n"), F.count("position").alias("placed"))


@query("st03_distinct_sets", "SELECT season_id, count(DISTINCT code) AS n, string_agg(DISTINCT team_code, ',' ORDER BY team_code) AS teams FROM b_result GROUP BY 1")
def _(v):
    return v.b_result.groupBy("season_id").agg(F.count_distinct("code").alias("n"), F.array_sort(F.collect_set("team_code")).alias("teams"))


@query("ar01_nested_lineup", "SELECT event_id, d1 AS first_id, boost AS boost_id, 5 AS n_drivers, concat_ws(',', c1, c2) AS team_ids FROM b_lineup", i="n_drivers")
def _(v):
    return N.to_nested(v.b_lineup).select("event_id", F.element_at("driver_ids", 1).alias("first_id"), "boost_id", F.size("driver_ids").alias("n_drivers"), "team_ids")


@query("ar02_slots_round_trip", "SELECT event_id, d1, d2, d3, d4, d5, c1, c2, boost FROM b_lineup")
def _(v):
    return N.to_slots(N.to_nested(v.b_lineup)).select("event_id", "d1", "d2", "d3", "d4", "d5", "c1", "c2", "boost")


# --- evaluation ------------------------------------------------------------
_M = f"""m AS (SELECT p.event_id, p.driver_id, p.predicted_position AS pp, p.predicted_points AS pts, r.position AS ap, t.race_total AS apts FROM {_MATCH}),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pp, driver_id) AS pr, row_number() OVER (PARTITION BY event_id ORDER BY ap, driver_id) AS ar,
  row_number() OVER (PARTITION BY event_id ORDER BY pts DESC, driver_id) AS prp, row_number() OVER (PARTITION BY event_id ORDER BY apts DESC, driver_id) AS arp, count(*) OVER (PARTITION BY event_id) AS n FROM m)"""
_RHO = "CASE WHEN max(n) < 2 THEN 0.0 ELSE coalesce(corr(pr, ar), 0.0) END"
_P10 = "CASE WHEN max(n) < 10 THEN 0.0 ELSE count(CASE WHEN prp <= 10 AND arp <= 10 THEN 1 END) / 10.0 END"
_NDCG = "CASE WHEN max(n) < 2 OR sum(CASE WHEN arp <= 10 THEN apts / log2(arp + 1) END) = 0 THEN 0.0 ELSE sum(CASE WHEN prp <= 10 THEN apts / log2(prp + 1) END) / sum(CASE WHEN arp <= 10 THEN apts / log2(arp + 1) END) END"


@query("evl01_mae", f"WITH {_M} SELECT event_id, avg(abs(pp - ap)) AS mae_position, avg(abs(pts - apts)) AS mae_points FROM m GROUP BY 1", d="mae_position mae_points")
def _(v):
    return E.mae(pred_pairs(v))


for _name, _col, _sql in (("evl02_spearman", "spearman", _RHO), ("evl03_precision10", "precision10", _P10), ("evl04_recall10", "recall10", _P10), ("evl05_ndcg10", "ndcg10", _NDCG)):
    @query(_name, f"WITH {_M} SELECT event_id, {_sql} AS {_col} FROM k GROUP BY 1", d=_col)
    def _(v, col=_col):
        return E.rank_metrics(pred_pairs(v)).select("event_id", col)


@query("evl06_metric_bundle", f"WITH {_M} SELECT event_id, {_RHO} AS spearman, {_P10} AS precision10, {_P10} AS recall10, {_NDCG} AS ndcg10, avg(abs(pp - ap)) AS mae_position, avg(abs(pts - apts)) AS mae_points FROM k GROUP BY 1",
       d="spearman precision10 recall10 ndcg10 mae_position mae_points")
def _(v):
    return E.bundle(pred_pairs(v))
