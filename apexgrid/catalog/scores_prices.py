"""Queries for scoring, price paths and the windows around them."""
from pyspark.sql import functions as F

from ..operators import prices as PR, scoring as SC, windows as W
from .registry import query

KEYS = ["event_id", "driver_id"]
_ITEM = ["event_type", "scoring_item", "frequency", "position", "points"]
_ITEM_SQL = ", ".join(_ITEM)
_TEAM = ["event_id", "season_id", "round_no", "team_id"]


def nested_lineups(v):
    return v.b_lineup.select("event_id", "event_date", "season_id", "season_year", "round_no", F.array("d1", "d2", "d3", "d4", "d5").alias("driver_ids"),
                             F.array("c1", "c2").alias("team_ids"), F.col("boost").alias("boost_id"))


@query("wn08_overtakes", "SELECT * FROM b_overtake", i="overtakes")
def _(v):
    return W.overtakes(v.b_racelap)


@query("sc01_race_and_sprint_items", f"SELECT event_id, driver_id, {_ITEM_SQL} FROM b_score WHERE event_type IN ('race', 'sprint')")
def _(v):
    return SC.race_items(v.b_results_all.where(F.col("session_type").isin("R", "S")), W.overtakes(v.b_racelap), KEYS)


@query("sc02_qualifying_items", f"SELECT event_id, driver_id, {_ITEM_SQL} FROM b_score WHERE event_type IN ('qualifying', 'sprint_qualifying')")
def _(v):
    return SC.quali_items(v.b_results_all.where(F.col("session_type").isin("Q", "SQ")), KEYS)


_CITEMS = """SELECT event_id, season_id, round_no, team_id, event_type, concat(cast(code AS string), ': ', scoring_item) AS scoring_item, points FROM b_score WHERE event_type IN ('race', 'sprint')
UNION ALL SELECT event_id, season_id, round_no, team_id, 'qualifying', 'Q Progression', points FROM b_qprog"""


@query("sc03_constructor_items", f"SELECT event_id, team_id, event_type, scoring_item, points FROM ({_CITEMS}) x")
def _(v):
    keep = ["event_id", "season_id", "round_no", "driver_id", "code", "team_id"]
    v.stage("b_agg", "b_rank")
    rows = SC.driver_items(v.b_results_all, v.b_racelap, keep)
    return SC.constructor_items(rows, v.b_results_all, _TEAM).select("event_id", "team_id", "event_type", "scoring_item", "points")


def _stamped(src, who):
    return f"""SELECT s.event_id, s.{who}, s.event_type, s.scoring_item, s.points, t.race_total, t.season_total FROM {src} s JOIN (
  SELECT event_id, {who}, race_total, sum(race_total) OVER (PARTITION BY {who} ORDER BY round_no) AS season_total FROM (
    SELECT event_id, {who}, round_no, sum(points) AS race_total FROM {src} GROUP BY 1, 2, 3) a) t ON t.event_id = s.event_id AND t.{who} = s.{who}"""


@query("sc04_season_driver_scores", _stamped("b_score", "driver_id"), i="race_total season_total")
def _(v):
    v.stage("b_agg", "b_rank")
    return SC.season_scores(v.b_results_all, v.b_racelap)[0].select("event_id", "driver_id", "event_type", "scoring_item", "points", "race_total", "season_total")


@query("sc04_season_constructor_scores", f"WITH c AS ({_CITEMS}) " + _stamped("c", "team_id"), i="race_total season_total")
def _(v):
    v.stage("b_agg", "b_rank")
    return SC.season_scores(v.b_results_all, v.b_racelap)[1].select("event_id", "team_id", "event_type", "scoring_item", "points", "race_total", "season_total")


@query("wn09_running_season_total", "SELECT event_id, driver_id, scoring_item, event_type, sum(points) OVER (PARTITION BY driver_id ORDER BY round_no RANGE UNBOUNDED PRECEDING) AS season_total FROM b_score", i="season_total")
def _(v):
    v.stage("b_agg", "b_rank", "b_overtake", "b_score")
    return W.stamp_season_total(v.b_score).select("event_id", "driver_id", "scoring_item", "event_type", "season_total")


@query("wn10_stamped_event_total", "SELECT event_id, driver_id, scoring_item, event_type, sum(points) OVER (PARTITION BY driver_id, event_id) AS race_total FROM b_score", i="race_total")
def _(v):
    v.stage("b_agg", "b_rank", "b_overtake", "b_score")
    return W.stamp_event_total(v.b_score).select("event_id", "driver_id", "scoring_item", "event_type", "race_total")


_LINEUP_PTS = """
SELECT l.event_id, sum(coalesce(t.race_total, 0) * CASE WHEN l.id = l.boost THEN 2 ELSE 1 END) AS pts FROM (
  SELECT event_id, boost, unnest([d1, d2, d3, d4, d5]) AS id FROM b_lineup) l LEFT JOIN b_total t ON t.event_id = l.event_id AND t.driver_id = l.id GROUP BY 1"""
_TEAM_PTS = """
SELECT l.event_id, sum(coalesce(t.race_total, 0)) AS pts FROM (SELECT event_id, unnest([c1, c2]) AS id FROM b_lineup) l
LEFT JOIN b_ctotal t ON t.event_id = l.event_id AND t.team_id = l.id GROUP BY 1"""


@query("sc05_lineup_points", f"SELECT a.event_id, a.pts + b.pts AS actual_points FROM ({_LINEUP_PTS}) a JOIN ({_TEAM_PTS}) b ON b.event_id = a.event_id", d="actual_points")
def _(v):
    v.stage("b_agg", "b_event", "b_driver", "b_rank", "b_score", "b_total", "b_ctotal")
    return SC.lineup_points(nested_lineups(v), v.b_total, v.b_ctotal, ["event_id"])


# --- prices ----------------------------------------------------------------
def _chain_sql(ent, totals, spine, start):
    ch = "CASE WHEN {p} >= 19 THEN CASE WHEN {a} > 1.2 THEN 0.3 WHEN {a} > 0.9 THEN 0.1 WHEN {a} > 0.6 THEN -0.1 ELSE -0.3 END ELSE CASE WHEN {a} > 1.2 THEN 0.6 WHEN {a} > 0.9 THEN 0.2 WHEN {a} > 0.6 THEN -0.2 ELSE -0.6 END END"
    nxt = "cast(greatest(3.0, least(34.0, {p} + (" + ch + "))) AS decimal(5,1))"
    push = "CASE WHEN {pts} IS NULL THEN {w} ELSE list_slice(list_append({w}, {pts} / cast({p} AS double)), greatest(len({w}) - 1, 1), len({w}) + 1) END"
    avg = "coalesce(list_avg({w}), 0.0)"
    return f"""
WITH r AS (SELECT s.{ent}, s.event_id, t.race_total AS pts, row_number() OVER (PARTITION BY s.{ent} ORDER BY s.round_no) AS n, {start} AS start_price
  FROM {spine} s LEFT JOIN {totals} t ON t.event_id = s.event_id AND t.{ent} = s.{ent}),
c AS (
  SELECT {ent}, event_id, n, cast(start_price AS decimal(5,1)) AS price, cast([] AS double[]) AS w0, {push.format(w="cast([] AS double[])", pts="pts", p="start_price")} AS w FROM r WHERE n = 1
  UNION ALL
  SELECT r.{ent}, r.event_id, r.n, q.price, q.w0, {push.format(w="q.w0", pts="r.pts", p="q.price")} AS w
  FROM (SELECT {ent}, n, {nxt.format(p="price", a=avg.format(w="w"))} AS price, w AS w0 FROM c) q JOIN r ON r.{ent} = q.{ent} AND r.n = q.n + 1)
SELECT event_id, {ent}, price, {ch.format(p="price", a=avg.format(w="w0"))} AS price_change FROM c"""


_TSPINE = "(SELECT DISTINCT event_id, team_id, round_no FROM b_spine)"


@query("pr01_driver_price_chain", _chain_sql("driver_id", "b_total", "b_spine", "8.0 + (s.code % 150) / 10.0"), d="price price_change")
def _(v):
    v.stage("b_agg", "b_event", "b_driver", "b_spine", "b_rank", "b_score", "b_total")
    rounds = v.b_spine.join(v.b_total.select(*KEYS, F.col("race_total").alias("points")), KEYS, "left").select("driver_id", "event_id", "round_no", "points")
    start = v.b_driver.select("driver_id", (8 + (F.col("code") % 150) / F.lit(10.0)).alias("start_price"))
    return PR.price_chain(start, rounds, ["driver_id"]).select(*KEYS, "price", "price_change")


@query("pr01_constructor_price_chain", _chain_sql("team_id", "b_ctotal", _TSPINE, "9.5 + (s.team_id // 10000) % 12"), d="price price_change")
def _(v):
    v.stage("b_agg", "b_event", "b_driver", "b_spine", "b_rank", "b_score", "b_total", "b_ctotal")
    k = ["event_id", "team_id"]
    rounds = v.b_spine.select(*k, "round_no").distinct().join(v.b_ctotal.select(*k, F.col("race_total").alias("points")), k, "left")
    start = v.b_team.select("team_id", (F.floor(F.col("team_id") / 10000) % 12 + 9.5).alias("start_price"))
    return PR.price_chain(start, rounds, ["team_id"]).select(*k, "price", "price_change")


_CARRY = """SELECT code, season_year + 1 AS season_year, greatest(5.0, least(28.0, price)) AS price FROM b_price p
WHERE round_no = (SELECT max(round_no) FROM b_price x WHERE x.season_year = p.season_year)"""


@query("pr03_carry_over", _CARRY, d="price")
def _(v):
    return PR.carry_over(v.b_price, "code")


@query("pr02_starting_prices", f"""
SELECT d.driver_id, coalesce(l.price, c.price, 10.0) AS start_price, CASE WHEN l.price IS NOT NULL THEN 'listed' WHEN c.price IS NOT NULL THEN 'carried' ELSE 'default' END AS source
FROM b_driver d LEFT JOIN (SELECT driver_id, price FROM b_price WHERE round_no = 1 AND code % 5 = 0) l ON l.driver_id = d.driver_id
LEFT JOIN ({_CARRY}) c ON c.code = d.code AND c.season_year = d.season_year""", d="start_price")
def _(v):
    listed = v.b_price.where("round_no = 1 AND code % 5 = 0").select("driver_id", "price")
    carried = PR.carry_over(v.b_price, "code").join(v.b_driver.select("driver_id", "code", "season_year"), ["code", "season_year"])
    return PR.starting_prices(v.b_driver.select("driver_id"), listed, carried, "driver_id", 10.0)


# a list of prices for all seasons meets the entry list of one: codes that are not in it are reported
@query("pr02_unknown_codes", """SELECT DISTINCT p.code FROM b_price p WHERE p.round_no = 1 AND p.code % 3 = 1""")
def _(v):
    entered = v.b_driver.where("code % 3 <> 1").select("code").distinct()
    return PR.unknown_codes(v.b_price.where("round_no = 1").select("code", "price"), entered, "code")


_STATE = """(SELECT s.event_id, s.driver_id, list(h.race_total / cast(h.price AS double) ORDER BY h.event_date) FILTER (WHERE h.rn <= 3) AS seen, count(CASE WHEN h.rn <= 3 THEN 1 END) AS n
FROM b_spine s LEFT JOIN (SELECT s.event_id, s.driver_id, t.race_total, p.price, t.event_date, row_number() OVER (PARTITION BY s.event_id, s.driver_id ORDER BY t.event_date DESC) AS rn
  FROM b_spine s JOIN b_total t ON t.driver_id = s.driver_id AND t.event_date < s.event_date JOIN b_price p ON p.event_id = t.event_id AND p.driver_id = t.driver_id) h
ON h.event_id = s.event_id AND h.driver_id = s.driver_id GROUP BY 1, 2)"""


def price_state(v):
    scored = v.b_total.join(v.b_price.select(*KEYS, "price"), KEYS)
    return PR.rolling_state(v.b_spine, scored)


@query("pr06_rolling_price_state", f"SELECT event_id, driver_id, n, coalesce(list_sum(seen), 0.0) AS total FROM {_STATE} z", d="total")
def _(v):
    v.stage("b_agg", "b_event", "b_driver", "b_spine", "b_rank", "b_score", "b_total")
    from ..functions import lists as L
    return price_state(v).select(*KEYS, F.size("seen").alias("n"), L.total(F.col("seen")).alias("total"))


_MOVE = """greatest(3.0, least(34.0, p.price + CASE WHEN p.price >= 19 THEN CASE WHEN a > 1.2 THEN 0.3 WHEN a > 0.9 THEN 0.1 WHEN a > 0.6 THEN -0.1 ELSE -0.3 END
  ELSE CASE WHEN a > 1.2 THEN 0.6 WHEN a > 0.9 THEN 0.2 WHEN a > 0.6 THEN -0.2 ELSE -0.6 END END)) - p.price"""


@query("pr05_price_adjusted_points", f"""
SELECT d.event_id, d.driver_id, d.predicted_points + 1.5 * coalesce(cast({_MOVE} AS double), 0) AS predicted_points FROM b_pred d
LEFT JOIN b_price p ON p.event_id = d.event_id AND p.driver_id = d.driver_id
LEFT JOIN (SELECT event_id, driver_id, coalesce(list_avg(seen), 0.0) AS a FROM {_STATE} z) s ON s.event_id = d.event_id AND s.driver_id = d.driver_id""", d="predicted_points")
def _(v):
    v.stage("b_agg", "b_event", "b_driver", "b_spine", "b_rank", "b_score", "b_total")
    return PR.adjust_for_price(v.b_pred, v.b_price, price_state(v), 1.5).select(*KEYS, "predicted_points")


_T_CH = "CASE WHEN {p} >= 19 THEN CASE WHEN {a} > 1.2 THEN 0.3 WHEN {a} > 0.9 THEN 0.1 WHEN {a} > 0.6 THEN -0.1 ELSE -0.3 END ELSE CASE WHEN {a} > 1.2 THEN 0.6 WHEN {a} > 0.9 THEN 0.2 WHEN {a} > 0.6 THEN -0.2 ELSE -0.6 END END"
_T_NX = "cast(greatest(3.0, least(34.0, {p} + " + _T_CH + ")) AS decimal(5,1))"


@query("pr04_price_trajectory", f"""
WITH x AS (SELECT event_id, driver_id, price AS p0, cast(code % 40 AS double) AS pts FROM b_price),
y AS (SELECT *, {_T_NX.format(p='p0', a='0.0')} AS p1, pts / cast(p0 AS double) AS r1 FROM x),
z AS (SELECT *, {_T_NX.format(p='p1', a='r1')} AS p2, (pts + 5) / cast(p1 AS double) AS r2 FROM y)
SELECT event_id, driver_id, p1, p2, {_T_NX.format(p='p2', a='((r1 + r2) / 2)')} AS p3 FROM z""", d="p1 p2 p3")
def _(v):
    c = (F.col("code") % 40).cast("double")
    df = v.b_price.withColumns({"seen": F.array().cast("array<double>"), "pts": F.array(c, c + 5, c + 1)})
    return PR.trajectory(df, "price", "seen", "pts").select(*KEYS, *[F.element_at("path", i).alias(f"p{i}") for i in (1, 2, 3)])


@query("wn14_rolling_value", """
SELECT t.event_id, t.driver_id, avg(t.race_total / cast(p.price AS double)) OVER (PARTITION BY t.driver_id ORDER BY t.event_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg_ppm
FROM b_total t JOIN b_price p ON p.event_id = t.event_id AND p.driver_id = t.driver_id""", d="avg_ppm")
def _(v):
    v.stage("b_agg", "b_event", "b_driver", "b_rank", "b_score", "b_total")
    return W.rolling_value(v.b_total.join(v.b_price.select(*KEYS, "price"), KEYS), "driver_id").select(*KEYS, "avg_ppm")
