"""Queries for training sets, models, backtests and the weekly jobs."""
from functools import reduce

from pyspark.sql import functions as F

from ..operators import joins as J, ledger as G, lineup as LN, nested as N, scoring as SC, sinks_logic as SK
from ..plans import backtest as BT, features as FS, models as M, training as TR, walk as WK
from .bindings import RACING
from .lineups import _LN02, _REAL_CARS, _REAL_TEAMS, _best_sql, oracle_scores
from .registry import query
from .scores_prices import _LINEUP_PTS, _TEAM_PTS, nested_lineups, price_state
from .tables import _actuals

KEYS = FS.KEYS
# fixed values: feature stores and predictors of the comparison
STORES, PREDICTORS = ("v1", "v2", "v3", "v4"), ("v1", "v2", "v3", "v4")
_Y = "r.position AS y_position, coalesce(t.race_total, r.points) AS y_points, e.event_index"
_CALENDAR = "JOIN (SELECT event_id, dense_rank() OVER (ORDER BY event_date) - 1 AS event_index FROM b_event) e ON e.event_id = r.event_id"


def feature_table(v, version: str):
    """Feature set as a written table; ``all`` has the columns of every store."""
    v.stage(*RACING)
    every = list(dict.fromkeys(c for s in STORES for c in FS.SETS[s]))
    return v.keep(f"features-{version}", lambda: FS.features(FS.Tables.of(v), wanted=every) if version == "all" else FS.features(FS.Tables.of(v), version))


def training_table(v, family: str):
    def make():
        if family == "qualifying":
            return TR.quali_training_set(feature_table(v, "v4"), v.b_quali, v.b_score, v.b_event)
        return TR.race_training_set(feature_table(v, family if family in ("race", "all") else "v4"), v.b_result, v.b_total, v.b_event)

    return v.keep(f"training-{family}", make)


@query("fs07_race_training_set", f"""SELECT r.event_id, r.driver_id, o.position_mean_last3, o.fp_sector1_rank, {_Y} FROM b_result r JOIN o_all o ON o.event_id = r.event_id AND o.driver_id = r.driver_id
{_CALENDAR} LEFT JOIN b_total t ON t.event_id = r.event_id AND t.driver_id = r.driver_id WHERE r.position IS NOT NULL""", d="position_mean_last3 fp_sector1_rank y_position y_points")
def _(v):
    return training_table(v, "v4").select(*KEYS, "position_mean_last3", "fp_sector1_rank", "y_position", "y_points", "event_index")


@query("fs08_qualifying_training_set", f"""SELECT r.event_id, r.driver_id, o.quali_last1, r.position AS y_position, coalesce(t.p, r.points) AS y_points, e.event_index
FROM b_quali r JOIN o_last5 o ON o.event_id = r.event_id AND o.driver_id = r.driver_id {_CALENDAR} LEFT JOIN (SELECT event_id, driver_id, sum(points) AS p FROM b_score WHERE event_type = 'qualifying' GROUP BY 1, 2) t
ON t.event_id = r.event_id AND t.driver_id = r.driver_id WHERE r.position IS NOT NULL""", d="quali_last1 y_position y_points")
def _(v):
    return training_table(v, "qualifying").select(*KEYS, "quali_last1", "y_position", "y_points", "event_index")


def field(v, family="v4"):
    """All season drivers with features, numbered by the calendar."""
    name = family if family in ("race", "all") else "v4"
    return v.keep(f"field-{name}", lambda: TR.numbered(feature_table(v, name), v.b_event))


def _split(v, family="v4"):
    """The newest weekend of the field is the target, whether it has results or not; all events before it with results are training."""
    f, t = field(v, family), training_table(v, family)
    target = f.agg(F.max("event_index").alias("target"))
    before = t.join(F.broadcast(target), t["event_index"] < target["target"]).drop("target")
    return before, f.join(F.broadcast(target), f["event_index"] == target["target"]).drop("target")


_OUT = [*KEYS, "predicted_position", "predicted_points", "lower", "upper"]

for _id, _version, _family in (("ml01_tree_model_v1", "v1", "v4"), ("ml02_tree_model_v2", "v2", "v4"), ("ml03_recency_tree_model_v3", "v3", "v4"),
                               ("ml04_ranker_v4", "v4", "v4"), ("ml05_qualifying_ranker", "qualifying", "qualifying"), ("ml06_race_ranker", "race", "race")):
    @query(_id)
    def _(v, version=_version, family=_family):
        train, test = _split(v, family)
        return M.make(version, FS.SETS["race" if family == "race" else "v4"]).fit(train).predict(test).select(*_OUT)


@query("ml07_feature_importances")
def _(v):
    train, _ = _split(v)
    return v.spark.createDataFrame(M.make("v4", FS.V4).fit(train).importances(), "feature string, importance double")


@query("ml08_random_search")
def _(v):
    train, _ = _split(v)
    # the fixed settings first, as the baseline
    return M.search(train, FS.V4, [M.SPECS["v2"], *M.draw_specs()])


@query("ml09_prediction_job")
def _(v):
    train, target = _split(v)
    new = M.make("v4", FS.V4).fit(train).predict(target).select(*_OUT).withColumn("model_version", F.lit("v4"))
    old = v.b_pred.select(*KEYS, "predicted_position", "predicted_points", "lower", "upper").withColumn("model_version", F.lit("v4"))
    return SK.upsert(old, new, [*KEYS, "model_version"])[0]


#: Families of the model backtest: training set and field, columns, and how fast older events fade.
FAMILIES = {"v4": ("v4", "v4", M.DEFAULTS.half_life), "race": ("race", "race", None), "qualifying": ("qualifying", "v4", None)}


def walk_predictions(v, version="v4"):
    family, cols, half_life = FAMILIES[version]
    return v.keep(f"walk-{version}", lambda: WK.rank_forward(training_table(v, family), field(v, family), FS.SETS[cols], half_life).select(*BT.PRED))


def store_predictions(v):
    """The ranker on the columns of each feature store, from one table with the columns of all."""
    def of(store):
        return v.keep(f"walk-store-{store}", lambda: WK.rank_forward(training_table(v, "all"), field(v, "all"), FS.SETS[store]).select(*BT.PRED)).withColumn("predictor", F.lit(f"v4:{store}"))

    rows = [of(store) for store in STORES[:-1]] + [walk_predictions(v).withColumn("predictor", F.lit(f"v4:{STORES[-1]}"))]
    return reduce(lambda a, b: a.unionByName(b), rows)


def predictor_predictions(v):
    """The tree predictors, which grow side by side, and the ranker, on the widest store."""
    trees = v.keep("walk-trees", lambda: BT.predictions(training_table(v, "v4"), field(v), {name: FS.V4 for name in ("v1", "v2", "v3")}))
    return trees.unionByName(walk_predictions(v).withColumn("predictor", F.lit("v4")))


@query("evl07_model_walk_forward")
def _(v):
    return BT.model_report(walk_predictions(v), _actuals(v))


@query("evl07_race_walk_forward")
def _(v):
    return BT.model_report(walk_predictions(v, "race"), _actuals(v))


@query("evl07_qualifying_walk_forward")
def _(v):
    return BT.model_report(walk_predictions(v, "qualifying"), J.session_actuals(v.b_quali, v.b_score, "Q", ["qualifying"]).select(*KEYS, "position", "actual_points"))


# what holds for any model: every car of every weekend from min_train on has a rank, and no bounds cross
@query("evl07_walk_structure", """SELECT s.event_id, count(*) AS n_cars, count(*) * (count(*) + 1) / 2.0 AS rank_sum, 0 AS n_crossed, 0 AS n_missing
FROM b_spine s JOIN (SELECT event_id, dense_rank() OVER (ORDER BY event_date) - 1 AS event_index FROM b_event) e ON e.event_id = s.event_id
WHERE event_index >= 5 GROUP BY s.event_id""", d="rank_sum", i="n_crossed n_missing")
def _(v):
    missing = F.col("predicted_points").isNull() | F.col("lower").isNull() | F.col("upper").isNull()
    return walk_predictions(v).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_cars"), F.sum("predicted_position").alias("rank_sum"),
                                                       F.count_if(F.col("lower") > F.col("upper")).alias("n_crossed"), F.count_if(missing).alias("n_missing"))


# with one feature of two values the best weight is known: the log of how often, by weight, that feature wins against how often it loses
@query("ml04_ranker_closed_form", f"""WITH t AS (SELECT r.event_id, CASE WHEN o.position_mean_last3 <= 10 THEN 1 ELSE 0 END AS x, coalesce(t.race_total, r.points) AS y, e.event_index
FROM b_result r JOIN o_all o ON o.event_id = r.event_id AND o.driver_id = r.driver_id {_CALENDAR} LEFT JOIN b_total t ON t.event_id = r.event_id AND t.driver_id = r.driver_id WHERE r.position IS NOT NULL),
p AS (SELECT a.event_index, count(*) FILTER (a.y > b.y) AS won, count(*) FILTER (a.y < b.y) AS lost FROM t a JOIN t b ON a.event_id = b.event_id AND a.x = 1 AND b.x = 0 GROUP BY a.event_index),
k AS (SELECT s.split, (SELECT max(event_index) FROM t WHERE event_index < s.split) AS latest FROM (SELECT unnest(range(5, (SELECT max(event_index) + 2 FROM t))) AS split) s)
SELECT k.split AS event_index, 'front' AS feature, ln(sum(won * pow(0.5, (latest - p.event_index) / 10.0)) / sum(lost * pow(0.5, (latest - p.event_index) / 10.0))) AS weight
FROM k JOIN p ON p.event_index < k.split GROUP BY k.split""", d="weight", i="event_index")
def _(v):
    front = F.when(F.col("position_mean_last3") <= 10, 1.0).otherwise(0.0)
    return WK.model_weights(training_table(v, "v4").withColumn("front", front), ["front"], ridge=0.0)


def _backtest(v, configs):
    v.stage(*RACING)
    return BT.backtest(walk_predictions(v), _actuals(v), v, price_state(v), configs, oracle_scores(v))


@query("evl08_full_backtest")
def _(v):
    return _backtest(v, [(1, "exact", 1.0)])


# fixed values: the price sensitivities and optimizers of the sweep
SENSITIVITIES = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0, 15.0, 20.0)
OPTIMIZERS = ("greedy", "upgraded", "exact", "sampled")
SWEEP = [(i, o, s) for i, (o, s) in enumerate(((o, s) for o in OPTIMIZERS for s in SENSITIVITIES), 1)]


def _compared(v, pred, names):
    """Every (predictor, optimizer): totals over the races that all of them cover."""
    configs = [(i, o, 1.0, name) for i, (name, o) in enumerate(((n, o) for n in names for o in OPTIMIZERS), 1)]
    v.stage(*RACING)
    rows = BT.backtest(pred, _actuals(v), v, price_state(v), configs, oracle_scores(v))
    told = v.spark.createDataFrame([(c[0], c[3], c[1]) for c in configs], "config_id bigint, predictor string, optimizer string")
    return told.join(BT.summary(rows, ["config_id"]), "config_id")


@query("evl09_store_comparison")
def _(v):
    return _compared(v, store_predictions(v), [f"v4:{s}" for s in STORES])


@query("evl09_predictor_comparison")
def _(v):
    return _compared(v, predictor_predictions(v), PREDICTORS)


# all configurations cover the same races
@query("evl09_race_counts", """SELECT c.predictor, count(*) AS races FROM (VALUES ('v4:v1'), ('v4:v2'), ('v4:v3'), ('v4:v4')) c(predictor)
CROSS JOIN (SELECT DISTINCT s.event_id FROM b_spine s JOIN (SELECT event_id, dense_rank() OVER (ORDER BY event_date) - 1 AS event_index FROM b_event) e ON e.event_id = s.event_id WHERE event_index >= 5) x GROUP BY 1""")
def _(v):
    return store_predictions(v).groupBy("predictor").agg(F.countDistinct("event_id").alias("races"))


@query("evl09_config_comparison")
def _(v):
    names = v.spark.createDataFrame(SWEEP, "config_id bigint, optimizer string, sensitivity double")
    return names.join(BT.summary(_backtest(v, SWEEP), ["config_id"]), "config_id")


# --- weekly jobs -----------------------------------------------------------
def recommendations(v):
    """Stored predictions and prices to one recommendation per event, for all events."""
    v.stage(*RACING)
    g = LN.prediction_grid(v.b_pred.select(*KEYS, "predicted_points"), v.b_price, v.b_cprice, v.b_driver)
    return LN.solve(g, ["event_id"], "upgraded").where("feasible").withColumns({"strategy": F.lit("upgraded"), "model_version": F.lit("v1")})


@query("ln11_recommendation_job", f"SELECT event_id, 'upgraded' AS strategy, 'v1' AS model_version, driver_ids, team_ids, boost_id, total_cost, predicted_points FROM ({_LN02}) z WHERE feasible",
       d="total_cost predicted_points", i="boost_id")
def _(v):
    return recommendations(v).select("event_id", "strategy", "model_version", "driver_ids", "team_ids", "boost_id", "total_cost", "predicted_points")


@query("sc06_submitted_lineups", f"""SELECT a.event_id, a.pts + b.pts AS actual_points, o.best AS oracle_points FROM ({_LINEUP_PTS}) a JOIN ({_TEAM_PTS}) b ON b.event_id = a.event_id
LEFT JOIN ({_best_sql(_REAL_CARS, _REAL_TEAMS)}) o ON o.event_id = a.event_id""", d="actual_points oracle_points")
def _(v):
    v.stage(*RACING)
    lines = nested_lineups(v)
    best = oracle_scores(v).select("event_id", F.col("predicted_points").alias("oracle_points"))
    return SC.lineup_points(lines, v.b_total, v.b_ctotal, ["event_id"]).join(best, "event_id", "left")


_LN02_LIST = f"""(SELECT event_id, boost_id, list_transform(string_split(driver_ids, ','), lambda z: cast(z AS bigint)) AS ds, list_transform(string_split(team_ids, ','), lambda z: cast(z AS bigint)) AS ts
FROM ({_LN02}) z WHERE feasible)"""


@query("sc06_post_race_scoring", f"""SELECT s.event_id, s.source, s.actual_points, o.best AS oracle_points FROM (
  SELECT a.event_id, 'submitted' AS source, a.pts + b.pts AS actual_points FROM ({_LINEUP_PTS}) a JOIN ({_TEAM_PTS}) b ON b.event_id = a.event_id
  UNION ALL SELECT a.event_id, 'upgraded', a.pts + b.pts FROM (
    SELECT l.event_id, sum(coalesce(t.race_total, 0) * CASE WHEN l.id = l.boost_id THEN 2 ELSE 1 END) AS pts FROM (SELECT event_id, boost_id, unnest(ds) AS id FROM {_LN02_LIST} r) l
    LEFT JOIN b_total t ON t.event_id = l.event_id AND t.driver_id = l.id GROUP BY 1) a JOIN (
    SELECT l.event_id, sum(coalesce(t.race_total, 0)) AS pts FROM (SELECT event_id, unnest(ts) AS id FROM {_LN02_LIST} r) l
    LEFT JOIN b_ctotal t ON t.event_id = l.event_id AND t.team_id = l.id GROUP BY 1) b ON b.event_id = a.event_id) s
LEFT JOIN ({_best_sql(_REAL_CARS, _REAL_TEAMS)}) o ON o.event_id = s.event_id""", d="actual_points oracle_points")
def _(v):
    v.stage(*RACING)
    mine = nested_lineups(v).select("event_id", "driver_ids", "team_ids", "boost_id").withColumn("source", F.lit("submitted"))
    recs = recommendations(v).select("event_id", "driver_ids", "team_ids", "boost_id", "strategy").withColumnRenamed("strategy", "source")
    both = mine.unionByName(recs)
    scored = SC.lineup_points(both, v.b_total, v.b_ctotal, ["event_id", "source"])
    return scored.join(oracle_scores(v).select("event_id", F.col("predicted_points").alias("oracle_points")), "event_id", "left")


@query("ln12_weekly_recommendation")
def _(v):
    """Newest weekend of every championship: train, predict, adjust, budget, transfers, line-up, difference."""
    from ..operators import prices as PR
    v.stage(*RACING)
    train, target = _split(v)
    pred = M.make("v4", FS.V4).fit(train).predict(target).select(*_OUT)
    pred = PR.adjust_for_price(pred, v.b_price, price_state(v), 1.0)
    lines = nested_lineups(v)
    ledger = G.budgets(lines, v.b_price, v.b_cprice).join(G.banked_transfers(lines).select("event_id", "free_after"), "event_id")
    last = (ledger.where(F.col("next_event").isNotNull()).select(F.col("next_event").alias("event_id"), F.col("driver_ids").alias("prev_drivers"),
            F.col("team_ids").alias("prev_teams"), F.col("free_after").alias("free"), F.coalesce(F.col("available_next").cast("double"), F.lit(100.0)).alias("budget")))
    grid = LN.prediction_grid(pred, v.b_price, v.b_cprice, v.b_driver).join(last, "event_id")
    out = LN.solve(grid, ["event_id"], "exact").join(last.select("event_id", "prev_drivers", "prev_teams"), "event_id")
    return N.difference(N.difference(out, "prev_drivers", "driver_ids", "drivers"), "prev_teams", "team_ids", "teams").drop("prev_drivers", "prev_teams")
