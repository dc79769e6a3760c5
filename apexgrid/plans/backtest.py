"""Walk-forward evaluation: fits, features, predictions, metrics, line-ups and scores are computed for all splits, events and configurations together."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.quantiles import weighted_quantiles
from ..operators import aggregates as A, lineup as LN, prices as PR, scoring as SC
from ..params import DEFAULTS, Params
from ..session import stage
from . import evaluation as E, forest as FO, models as M, pairwise as PW

PRED = ["event_id", "driver_id", "season_id", "event_index", "predicted_position", "predicted_points", "lower", "upper"]


def predictions(table: DataFrame, field: DataFrame, versions: dict[str, list[str]], p: Params = DEFAULTS) -> DataFrame:
    """Predictions of every event from ``min_train`` on by tree models of the events before it, and by which ``predictor``.

    ``versions`` gives the columns of each predictor (``v1`` to ``v3``); a name may carry a store after a colon. ``table`` is a training set, ``field`` all
    season drivers with features and event index. The models of all splits, predictors and both targets grow side by side.
    """
    last = table.agg(F.max("event_index")).first()[0]
    splits = range(max(1, p.min_train), int(-1 if last is None else last) + 2)
    cols = list(dict.fromkeys(c for own in versions.values() for c in own))
    names = [(name, k, label) for name in versions for k in splits for label in (0, 1)]
    models = []
    for name, k, label in names:
        s, own = M.SPECS[name.split(":")[0]], tuple(cols.index(c) for c in versions[name])
        models.append(FO.Grown(s.trees, s.depth, s.step, s.min_rows, s.subsample, s.columns, k, k + 1, label, s.half_life, own))
    labelled = field.drop("y_position", "y_points").join(table.select("event_id", "driver_id", "y_position", "y_points"), ["event_id", "driver_id"], "left")
    rows = FO.predicted(labelled, cols, ["y_position", "y_points"], models, ["event_id", "driver_id", "season_id"])
    about = table.sparkSession.createDataFrame([(i, n, k, label, M.SPECS[n.split(":")[0]].bounds, M.SPECS[n.split(":")[0]].half_life) for i, (n, k, label) in enumerate(names)],
                                               "model int, predictor string, split bigint, label int, bounds string, half_life double")
    rows = rows.join(about, "model")
    # spread of the points around their training predictions: deviation, or exact weighted quantiles by prediction bucket
    w = F.coalesce(F.pow(F.lit(0.5), (F.col("split") - 1 - F.col("event_index")) / F.col("half_life")), F.lit(1.0))
    seen = rows.where("label = 1 AND NOT test").select("model", "p", (F.col("y") - F.col("p")).alias("r"), w.alias("w"))
    deviation = seen.groupBy("model").agg(F.stddev_pop("r").alias("sd"))
    cuts = stage(weighted_quantiles(seen, ["model"], "p", "w", tuple(i / M.BUCKETS for i in range(1, M.BUCKETS)), "cuts"), "tree-cuts")
    per = weighted_quantiles(seen.join(cuts, "model").withColumn("b", PW.bucket(F.col("p"), F.col("cuts"))), ["model", "b"], "r", "w", (0.1, 0.9), "q")
    spread = deviation.join(cuts, "model").join(per.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("b", "q"))).alias("quantiles")), "model", "left")
    test = rows.where("test")
    key = ["predictor", "event_id", "driver_id"]
    position = test.where("label = 0").select(*key, F.col("p").alias("predicted_position"))
    q = F.when(F.col("bounds") == "quantile", F.try_element_at("quantiles", PW.bucket(F.col("p"), F.col("cuts")))).otherwise(F.array(-F.col("sd"), F.col("sd")))
    points = test.where("label = 1").join(spread, "model", "left").withColumn("q", q)
    lo, hi = F.col("p") + F.coalesce(F.col("q")[0], F.lit(0.0)), F.col("p") + F.coalesce(F.col("q")[1], F.lit(0.0))
    return points.select(*key, "season_id", "event_index", F.col("p").alias("predicted_points"), F.least(lo, hi).alias("lower"), F.greatest(lo, hi).alias("upper")) \
        .join(position, key).select("predictor", *PRED)


def model_report(pred: DataFrame, actual: DataFrame) -> DataFrame:
    """Errors and rank metrics per event (and predictor, where there are several)."""
    key = [c for c in ("predictor",) if c in pred.columns] + ["event_id"]
    if key == ["event_id"]:
        return E.bundle(E.pairs(pred, actual).join(pred.select("event_id").distinct(), "event_id", "left_semi"))
    every = pred.select(*key).distinct().join(actual, "event_id")
    matched = E.pairs(pred, every, ["predictor"])
    return E.bundle(matched, key)


def with_configs(pred: DataFrame, configs: list[tuple]) -> DataFrame:
    """Every prediction under every (id, optimizer, price sensitivity[, predictor]) that uses it: a short literal array exploded."""
    cfg = F.array(*[F.struct(F.lit(c[0]).cast("bigint").alias("config_id"), F.lit(c[1]).alias("optimizer"), F.lit(float(c[2])).alias("sensitivity"),
                             F.lit(c[3] if len(c) > 3 else "").alias("p")) for c in configs])
    if "predictor" in pred.columns:
        cfg = F.filter(cfg, lambda c: c["p"] == F.col("predictor"))
    return pred.withColumn("_c", F.explode(cfg)).select(*pred.columns, "_c.config_id", "_c.optimizer", "_c.sensitivity")


def distinct_seasons(grid: DataFrame, methods: DataFrame) -> DataFrame:
    """(config_id, season_id, same): the smallest configuration that sets the same line-up problems over a season by the same method.

    A problem is a digest of an event's prices and points; budgets and the first line-up are equal for all, so equal problems give equal line-ups.
    """
    digest = F.xxhash64(*[c for c in grid.columns if c[:2] in ("d_", "t_")])
    per = grid.groupBy("config_id", "season_id").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("event_id", digest.alias("h"))))).alias("digest"), F.count(F.lit(1)).alias("n"))
    per = per.join(methods, "config_id")
    first = per.groupBy("optimizer", "season_id", "digest", "n").agg(F.min("config_id").alias("same"))
    return per.join(first, ["optimizer", "season_id", "digest", "n"]).select("config_id", "season_id", "same")


def backtest(pred: DataFrame, actual: DataFrame, v, state: DataFrame, configs: list[tuple], oracle: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per (config, event): errors, metrics, carried line-up, its score, the ceiling.

    Ten points per transfer above the free ones are charged; the line-up restarts each season. Seasons in which configurations set the
    same problems are solved once.
    """
    key = ["config_id", "event_id"]
    multi = with_configs(pred, configs)
    adjusted = PR.adjust_for_price(multi, v.b_price, state, F.col("sensitivity"))
    grid = LN.prediction_grid(adjusted, v.b_price, v.b_cprice, v.b_driver, key)
    grid = stage(grid.join(v.b_event.select("event_id", "season_id", "event_date"), "event_id"), "backtest-grid")
    methods = grid.sparkSession.createDataFrame([(c[0], c[1]) for c in configs], "config_id bigint, optimizer string")
    same = stage(distinct_seasons(grid, methods), "backtest-seasons")
    needed = grid.join(same.where("config_id = same").select("config_id", "season_id"), ["config_id", "season_id"], "left_semi")
    lines = []
    for method in dict.fromkeys(c[1] for c in configs):
        ids = [c[0] for c in configs if c[1] == method]
        lines.append(LN.season_walk(needed.where(F.col("config_id").isin(ids)), key, "season_id", "event_date", method, p))
    solved = reduce(DataFrame.unionByName, lines).withColumnRenamed("config_id", "same")
    lineups = stage(solved.join(same, ["same", "season_id"]).drop("same"), "backtest-lineups")
    scored = SC.lineup_points(lineups, v.b_total, v.b_ctotal, key)
    charge = F.greatest(F.col("n_transfers") - p.free_transfers, F.lit(0)) * p.transfer_penalty
    # a race that could not be priced or filled stays, with nulls, so that all configurations cover the same races
    which = [c for c in ("predictor",) if c in pred.columns]
    races = with_configs(pred.select("event_id", "season_id", *which).distinct(), configs).select(*key, "season_id", *which)
    line = F.col("feasible")
    result = (races.join(lineups.drop("season_id"), key, "left").join(scored, key, "left")
              .select(*key, "season_id", *which, F.when(line, F.col("predicted_points")).alias("lineup_predicted"), F.when(line, F.col("actual_points") - charge).alias("lineup_actual"),
                      F.when(line, F.col("n_transfers")).alias("n_transfers"), F.when(line, F.col("total_cost")).alias("total_cost"), F.coalesce(line, F.lit(False)).alias("feasible")))
    quality = model_report(pred, actual)
    return (result.join(oracle.select("event_id", F.col("predicted_points").alias("optimal_actual")), "event_id", "left").join(quality, [*which, "event_id"], "left"))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return A.metric_summary(rows, by)
