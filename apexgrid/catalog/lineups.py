"""Queries for line-up selection."""
from pyspark.sql import Window, functions as F

from ..operators import draws as D, lineup as LN
from ..params import DEFAULTS
from .registry import query
from .scores_prices import nested_lineups
from .bindings import RACING


def _stage(v):
    return v.stage(*RACING)


def _best_sql(cars: str, teams: str, budget: int = 1000) -> str:
    """Enumerate cars by total cost and teams by total cost, then meet inside the budget."""
    return f"""
WITH d AS (SELECT event_id, driver_id AS id, cast(round(price * 10) AS integer) AS x, cast(pts AS integer) AS p FROM {cars}),
t AS (SELECT event_id, team_id AS id, cast(round(price * 10) AS integer) AS x, cast(pts AS integer) AS p FROM {teams}),
d2 AS (SELECT a.event_id, b.id, a.x + b.x AS x, a.p + b.p AS p, greatest(a.p, b.p) AS m FROM d a JOIN d b ON b.event_id = a.event_id AND b.id > a.id),
d3 AS (SELECT a.event_id, b.id, a.x + b.x AS x, a.p + b.p AS p, greatest(a.m, b.p) AS m FROM d2 a JOIN d b ON b.event_id = a.event_id AND b.id > a.id),
d4 AS (SELECT a.event_id, b.id, a.x + b.x AS x, a.p + b.p AS p, greatest(a.m, b.p) AS m FROM d3 a JOIN d b ON b.event_id = a.event_id AND b.id > a.id),
d5 AS (SELECT a.event_id, a.x + b.x AS x, max(a.p + b.p + greatest(a.m, b.p)) AS v FROM d4 a JOIN d b ON b.event_id = a.event_id AND b.id > a.id WHERE a.x + b.x <= {budget} GROUP BY 1, 2),
t2 AS (SELECT a.event_id, a.x + b.x AS x, max(a.p + b.p) AS v FROM t a JOIN t b ON b.event_id = a.event_id AND b.id > a.id GROUP BY 1, 2)
SELECT d5.event_id, max(d5.v + t2.v) AS best FROM d5 JOIN t2 ON t2.event_id = d5.event_id AND d5.x + t2.x <= {budget} GROUP BY 1"""


_PRED_CARS = "(SELECT p.event_id, p.driver_id, x.price, p.predicted_points AS pts FROM b_pred p JOIN b_price x ON x.event_id = p.event_id AND x.driver_id = p.driver_id) c"
_PRED_TEAMS = "(SELECT c.event_id, c.team_id, c.price, coalesce(sum(p.predicted_points), 0) AS pts FROM b_cprice c LEFT JOIN b_pred p ON p.event_id = c.event_id AND p.team_id = c.team_id GROUP BY 1, 2, 3) c"
_REAL_CARS = "(SELECT x.event_id, x.driver_id, x.price, coalesce(t.race_total, 0) AS pts FROM b_price x LEFT JOIN b_total t ON t.event_id = x.event_id AND t.driver_id = x.driver_id) c"
_REAL_TEAMS = "(SELECT x.event_id, x.team_id, x.price, coalesce(t.race_total, 0) AS pts FROM b_cprice x LEFT JOIN b_ctotal t ON t.event_id = x.event_id AND t.team_id = x.team_id) c"
_KEEP = ["event_id", "total_cost", "predicted_points", "feasible", "boost_id"]


def _grid(v, prune=False):
    _stage(v)
    return LN.prediction_grid(v.b_pred.select("event_id", "driver_id", "predicted_points", "lower", "upper"), v.b_price, v.b_cprice, v.b_driver, prune=prune)


@query("jn17_ln04_exact_lineup", _best_sql(_PRED_CARS, _PRED_TEAMS), d="best")
def _(v):
    return LN.solve(_grid(v, prune=True), ["event_id"], "exact").where("feasible").select("event_id", F.col("predicted_points").alias("best"))


@query("ln07_oracle_score", _best_sql(_REAL_CARS, _REAL_TEAMS), d="best")
def _(v):
    _stage(v)
    return oracle_scores(v).where("feasible").select("event_id", F.col("predicted_points").alias("best"))


def oracle_scores(v, method: str = "exact"):
    return LN.solve(LN.actual_grid(v.b_total, v.b_ctotal, v.b_price, v.b_cprice), ["event_id"], method)


def _greedy_sql(src: str, k: int, budget: str) -> str:
    """Greedy fill as a recursion over the candidates in value order.

    ``fill`` holds, per candidate, the sums of the 0..k-1 cheapest later candidates.
    """
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p / cast(x AS double) DESC, id) AS i FROM {src}),
later AS (SELECT a.event_id, a.i, b.x, row_number() OVER (PARTITION BY a.event_id, a.i ORDER BY b.x, b.i) AS r FROM o a JOIN o b ON b.event_id = a.event_id AND b.i > a.i),
fill AS (SELECT o.event_id, o.i, o.id, o.x, o.p, {", ".join(f"coalesce(sum(CASE WHEN l.r <= {n} THEN l.x END), 0) AS f{n}" for n in range(k))}
  FROM o LEFT JOIN later l ON l.event_id = o.event_id AND l.i = o.i GROUP BY 1, 2, 3, 4, 5),
run AS (
  SELECT event_id, cast(0 AS bigint) AS i, cast(NULL AS bigint) AS id, 0 AS took, 0 AS got, cast(b AS bigint) AS money FROM {budget} bb
  UNION ALL
  SELECT event_id, i, id, took, got + took, money - took * x FROM (
    SELECT f.event_id, f.i, f.id, f.x, r.got, r.money,
      CASE WHEN r.got < {k} AND f.x + CASE {k} - r.got - 1 {" ".join(f"WHEN {n} THEN f.f{n}" for n in range(k))} ELSE 0 END <= r.money THEN 1 ELSE 0 END AS took
    FROM run r JOIN fill f ON f.event_id = r.event_id AND f.i = r.i + 1) q)
SELECT o.event_id, o.id, o.x, o.p FROM run r JOIN o ON o.event_id = r.event_id AND o.id = r.id WHERE r.took = 1"""


def _upgrade_sql(src: str, picked: str, budget: str) -> str:
    """The swap fixpoint as a recursion: the first pick in value order for which a better affordable candidate exists goes, the best of those comes."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p / cast(x AS double) DESC, id) AS i FROM {src}),
up AS (
  SELECT k.event_id, 0 AS n, list(k.id) AS ids, cast(sum(k.x) AS bigint) AS cost, cast(min(m.b) AS bigint) AS money FROM {picked} k JOIN {budget} m ON m.event_id = k.event_id GROUP BY 1
  UNION ALL
  SELECT event_id, n + 1, ids, cost, money FROM (
    SELECT s.event_id, s.n, list_append(list_filter(s.ids, lambda z: z <> c.id), q.id) AS ids, s.cost - c.x + q.x AS cost, s.money,
      row_number() OVER (PARTITION BY s.event_id ORDER BY c.i, q.p DESC, q.id) AS rn
    FROM up s JOIN o c ON c.event_id = s.event_id AND list_contains(s.ids, c.id)
    JOIN o q ON q.event_id = s.event_id AND NOT list_contains(s.ids, q.id) AND q.p > c.p AND q.x <= s.money - s.cost + c.x) w WHERE rn = 1),
fixed AS (SELECT event_id, arg_max(ids, n) AS ids FROM up GROUP BY 1)
SELECT o.event_id, o.id, o.x, o.p FROM fixed JOIN o ON o.event_id = fixed.event_id AND list_contains(fixed.ids, o.id)"""


def _lineup_sql(cars: str, teams: str, improve: bool) -> str:
    """Line-ups by value, with or without the swaps: cars first, with the two cheapest teams set aside, then teams."""
    def side(out: str, src: str, k: int, budget: str) -> str:
        if not improve:
            return f"{out} AS (WITH RECURSIVE {_greedy_sql(src, k, budget)})"
        return f"{out}_first AS (WITH RECURSIVE {_greedy_sql(src, k, budget)}), {out} AS (WITH RECURSIVE {_upgrade_sql(src, f'{out}_first', budget)})"

    return f"""
WITH d AS (SELECT event_id, driver_id AS id, cast(round(price * 10) AS bigint) AS x, cast(pts AS bigint) AS p FROM {cars}),
t AS (SELECT event_id, team_id AS id, cast(round(price * 10) AS bigint) AS x, cast(pts AS bigint) AS p FROM {teams}),
reserve AS (SELECT event_id, 1000 - sum(x) AS b FROM (SELECT event_id, x, row_number() OVER (PARTITION BY event_id ORDER BY x) AS rn FROM t) z WHERE rn <= 2 GROUP BY 1),
{side('cars', 'd', 5, 'reserve')},
rest AS (SELECT r.event_id, 1000 - coalesce(sum(c.x), 0) AS b FROM reserve r LEFT JOIN cars c ON c.event_id = r.event_id GROUP BY 1),
{side('teams', 't', 2, 'rest')},
c AS (SELECT event_id, count(*) AS n, sum(x) AS x, sum(p) + max(p) AS p, arg_max(id, p * 1000000000 - id) AS boost_id, string_agg(cast(id AS varchar), ',' ORDER BY id) AS ids FROM cars GROUP BY 1),
q AS (SELECT event_id, count(*) AS n, sum(x) AS x, sum(p) AS p, string_agg(cast(id AS varchar), ',' ORDER BY id) AS ids FROM teams GROUP BY 1)
SELECT r.event_id, CASE WHEN c.n = 5 AND q.n = 2 THEN (c.x + q.x) / 10.0 END AS total_cost, CASE WHEN c.n = 5 AND q.n = 2 THEN c.p + q.p END AS predicted_points,
  coalesce(c.n = 5 AND q.n = 2, false) AS feasible, c.boost_id, coalesce(c.ids, '') AS driver_ids, coalesce(q.ids, '') AS team_ids
FROM reserve r LEFT JOIN c ON c.event_id = r.event_id LEFT JOIN q ON q.event_id = r.event_id"""


_LN01 = _lineup_sql(_PRED_CARS, _PRED_TEAMS, False)
_LN02 = _lineup_sql(_PRED_CARS, _PRED_TEAMS, True)
_LN07 = _lineup_sql(_REAL_CARS, _REAL_TEAMS, True)


@query("ln01_greedy_lineup", _LN01, d="total_cost predicted_points", i="boost_id")
def _(v):
    return LN.solve(_grid(v), ["event_id"], "greedy").select(*_KEEP, "driver_ids", "team_ids")


@query("ln02_upgraded_lineup", _LN02, d="total_cost predicted_points", i="boost_id")
def _(v):
    return LN.solve(_grid(v), ["event_id"], "upgraded").select(*_KEEP, "driver_ids", "team_ids")


@query("ln07_oracle_score_greedy", f"SELECT event_id, total_cost, predicted_points, feasible, boost_id FROM ({_LN07}) z", d="total_cost predicted_points", i="boost_id")
def _(v):
    _stage(v)
    return LN.solve(LN.actual_grid(v.b_total, v.b_ctotal, v.b_price, v.b_cprice, prune=False), ["event_id"], "upgraded").select(*_KEEP)


@query("ln03_transfer_limited_lineup")
def _(v):
    prev = nested_lineups(v).select("event_id", F.col("driver_ids").alias("prev_drivers"), F.col("team_ids").alias("prev_teams"))
    return LN.solve(_grid(v).join(prev, "event_id"), ["event_id"], "upgraded").select(*_KEEP, "driver_ids", "team_ids")


@query("ln04_exact_with_transfers")
def _(v):
    prev = nested_lineups(v).select("event_id", F.col("driver_ids").alias("prev_drivers"), F.col("team_ids").alias("prev_teams"))
    return LN.solve(_grid(v).join(prev, "event_id"), ["event_id"], "exact").select(*_KEEP, "driver_ids", "team_ids")


@query("ln05_sampled_lineup")
def _(v):
    return LN.solve(_grid(v), ["event_id"], "sampled").select(*_KEEP, "driver_ids", "team_ids", "n_candidates")


# every draw is a hash of (event, car, scenario), so both engines get the same 500 values
_HASH = "xor({0} >> 16, {0}) * 73244475 & 4294967295"


def _mixed(source: str, out: str, x: str, rest: str, name: str) -> str:
    """Two steps of the hash and its last shift, as three subqueries."""
    return f"""{name}1 AS (SELECT {rest}, {_HASH.format(x)} AS x FROM {source}), {name}2 AS (SELECT {rest}, {_HASH.format("x")} AS x FROM {name}1),
{out} AS (SELECT {rest}, xor(x >> 16, x) AS h FROM {name}2)"""


@query("ln05_scenario_values", f"""WITH p AS (SELECT event_id, driver_id, lower AS lo, upper AS hi, least(greatest(predicted_points, lower), upper) AS mo, event_id % 4294967296 AS x FROM b_pred),
{_mixed("p", "e", "x", "event_id, driver_id, lo, hi, mo", "ea")},
e0 AS (SELECT *, xor(h, (2 * driver_id) % 4294967296) AS x FROM e), {_mixed("e0", "d", "x", "event_id, driver_id, lo, hi, mo", "da")},
d0 AS (SELECT *, xor(h, s) AS x, s FROM d, range(500) r(s)), {_mixed("d0", "s", "x", "event_id, driver_id, lo, hi, mo, s", "sa")},
s0 AS (SELECT *, h AS x FROM s), {_mixed("s0", "z", "x", "event_id, driver_id, lo, hi, mo, s", "za")},
u AS (SELECT *, (h + 0.5::double) / 4294967296 AS u, hi - lo AS w FROM z),
v AS (SELECT event_id, driver_id, CASE WHEN w > 0 THEN CASE WHEN u < (mo - lo) / w THEN lo + sqrt(u * w * (mo - lo)) ELSE hi - sqrt((1 - u) * w * (hi - mo)) END ELSE lo END AS value FROM u)
SELECT event_id, driver_id, count(*) AS scenarios, min(value) AS lowest, avg(value) AS middle, max(value) AS highest FROM v GROUP BY 1, 2""", d="lowest middle highest")
def _(v):
    values = D.scenario_values(v.b_pred, DEFAULTS.n_scenarios)
    return values.groupBy("event_id", "driver_id").agg(F.count(F.lit(1)).alias("scenarios"), F.min("value").alias("lowest"), F.avg("value").alias("middle"), F.max("value").alias("highest"))


@query("ln05_within_exact", f"SELECT event_id, best, true AS within FROM ({_best_sql(_PRED_CARS, _PRED_TEAMS)}) x", d="best")
def _(v):
    """No sampled line-up has more predicted points than the exact one."""
    g = _grid(v)
    best = LN.solve(g, ["event_id"], "exact").where("feasible").select("event_id", F.col("predicted_points").alias("best"))
    return best.join(LN.solve(g, ["event_id"], "sampled").select("event_id", "predicted_points"), "event_id").select("event_id", "best", (F.col("predicted_points") <= F.col("best") + 1e-9).alias("within"))


@query("ln06_fallback_without_bounds", _best_sql(_PRED_CARS, _PRED_TEAMS), d="best")
def _(v):
    # no spread between the bounds: the sampled method falls back to the exact one
    _stage(v)
    g = LN.prediction_grid(v.b_pred.select("event_id", "driver_id", "predicted_points"), v.b_price, v.b_cprice, v.b_driver)
    return LN.solve(g, ["event_id"], "sampled").where("feasible").select("event_id", F.col("predicted_points").alias("best"))
