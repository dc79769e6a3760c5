"""Line-up selection for all events and configurations at once.

Spark joins prices and predictions and gathers each event's grid into one row; an Arrow
batch of such rows is solved in the task.  Seasons with carried line-ups are grouped by
(configuration, season): a season is sequential, seasons are not.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import DEFAULTS, Params
from . import draws as D, joins as J, picks as X

OUT = "driver_ids array<bigint>, team_ids array<bigint>, boost_id bigint, total_cost double, predicted_points double, feasible boolean, n_candidates bigint"


def ticks(price: Column) -> Column:
    return F.round(price.cast("double") * 10).cast("bigint")


def useful(df: DataFrame, key: list[str], ident: str, k: int) -> DataFrame:
    """Entrants that an exact line-up can need: per price, the ``k`` best.

    Prices are tenths between the floor and the ceiling, so this bounds the rows of an
    event for any field size without changing the optimum.
    """
    w = Window.partitionBy(*key, "price").orderBy(F.col("predicted_points").desc(), ident)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def grids(drivers: DataFrame, teams: DataFrame, key: list[str], prune: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """One row per ``key`` with the parallel arrays of its priced cars and teams."""

    def side(df, ident, tag):
        for c in ("lower", "upper"):
            if c not in df.columns:
                df = df.withColumn(c, F.col("predicted_points"))
        cols = F.struct(F.col(ident).alias("id"), ticks(F.col("price")).alias("x"), F.col("predicted_points").cast("double").alias("p"),
                        F.col("lower").cast("double").alias("lo"), F.col("upper").cast("double").alias("hi"))
        rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(cols)).alias("_a"))
        return rows.select(*key, *[F.col(f"_a.{f}").alias(f"{tag}_{f}") for f in ("id", "x", "p", "lo", "hi")])

    if prune:
        drivers, teams = useful(drivers, key, "driver_id", p.n_drivers), useful(teams, key, "team_id", p.n_constructors)
    return side(drivers, "driver_id", "d").join(side(teams, "team_id", "t"), key)


def _row(d, t, r, extra=0, p: Params = DEFAULTS):
    """Result tuple of chosen car and team indexes."""
    ids, pts = r.d_id[d], r.d_p[d]
    if len(d) < p.n_drivers or len(t) < p.n_constructors:
        b = int(ids[pts.argmax()]) if len(d) else None
        return list(map(int, ids)), list(map(int, r.t_id[t])), b, None, None, False, extra
    return (list(map(int, ids)), list(map(int, r.t_id[t])), int(ids[pts.argmax()]), float(r.d_x[d].sum() + r.t_x[t].sum()) / 10,
            float(pts.sum() + pts.max() + r.t_p[t].sum()), True, extra)


def _arrays(r):
    return np.asarray(r.d_p, float), np.asarray(r.d_x, np.int64), np.asarray(r.t_p, float), np.asarray(r.t_x, np.int64)


#: Events whose scenarios are taken together.
SAMPLED_AT_ONCE = 8


def ideals(rows: list, method: str, budgets: np.ndarray, p: Params) -> list:
    """Of many grid rows the line-up by value (``greedy``, ``upgraded`` or ``sampled``) without transfer rules; null where the exact one counts. Rows of equal size are solved together."""
    out: list = [None] * len(rows)
    sizes: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        if method in ("greedy", "upgraded") or method == "sampled" and not np.array_equal(r.d_lo, r.d_hi):
            sizes.setdefault((len(r.d_id), len(r.t_id)), []).append(i)
    for every in sizes.values():
        step = SAMPLED_AT_ONCE if method == "sampled" else len(every)
        for own in (every[k:k + step] for k in range(0, len(every), step)):
            many = [rows[i] for i in own]
            of = lambda c, kind: np.stack([np.asarray(getattr(r, c), kind) for r in many])
            dp, dx, tp, tx = of("d_p", float), of("d_x", np.int64), of("t_p", float), of("t_x", np.int64)
            if method == "sampled":
                n = p.n_scenarios
                du, tu = (np.concatenate([D.uniforms(r.event_id, kind, getattr(r, c), n) for r in many]) for kind, c in ((D.DRIVER, "d_id"), (D.TEAM, "t_id")))
                each = lambda x: np.repeat(x, n, axis=0)
                dp = D.triangular(du, each(of("d_lo", float)), each(dp), each(of("d_hi", float)))
                tp = D.triangular(tu, each(of("t_lo", float)), each(tp), each(of("t_hi", float)))
                cars, teams = X.value_lineup(dp, each(dx), tp, each(tx), each(budgets[own]), improve=True)
                for k, i in enumerate(own):
                    at = slice(k * n, (k + 1) * n)
                    d, t, found = X.best_candidate(dp[at], tp[at], cars[at], teams[at])
                    out[i] = _row(d, t, rows[i], found, p)
            else:
                cars, teams = X.value_lineup(dp, dx, tp, tx, budgets[own], improve=method == "upgraded")
                for k, i in enumerate(own):
                    out[i] = _row(np.flatnonzero(cars[k]), np.flatnonzero(teams[k]), rows[i], 1, p)
    return out


def choose(r, method: str, budget: int, p: Params, ideal, prev=None, free: int = 2):
    """Solve one grid row whose line-up by value is ``ideal``; ``prev`` is (car ids, team ids) of the line-up before."""
    if ideal is None:
        dp, dx, tp, tx = _arrays(r)
        new = (None, None) if prev is None else (~np.isin(r.d_id, prev[0]), ~np.isin(r.t_id, prev[1]))
        got = X.exact(dp, dx, tp, tx, budget, *new, p.transfer_threshold if prev else 0.0, p.transfer_penalty, free)
        return _row(*got, r, 1, p) if got is not None else ([], [], None, None, None, False, 0)
    return ideal if prev is None or method == "greedy" or not ideal[5] else _toward(r, ideal, prev, free, budget, p)


def _toward(r, ideal, prev, free, budget, p):
    pts, price = ([dict(zip(getattr(r, f"{k}_id").tolist(), np.asarray(getattr(r, f"{k}_{c}"), kind).tolist())) for k in "dt"] for c, kind in (("p", float), ("x", np.int64)))
    (cars, teams), cost = X.limit_transfers(ideal[:2], prev, pts, price, free, p.transfer_penalty, budget)
    score = [pts[0].get(c, 0.0) for c in cars]
    return (list(map(int, cars)), list(map(int, teams)), int(cars[int(np.argmax(score))]), float(cost) / 10,
            float(sum(score) + max(score) + sum(pts[1].get(t, 0.0) for t in teams)), cost <= budget, ideal[6])


def _frame(keys, rows, results) -> pd.DataFrame:
    out = pd.DataFrame(results, columns=["driver_ids", "team_ids", "boost_id", "total_cost", "predicted_points", "feasible", "n_candidates"])
    out["boost_id"] = out["boost_id"].astype("Int64")
    for k in reversed(keys):
        out.insert(0, k, [getattr(r, k) for r in rows])
    return out


def tasks(df: DataFrame) -> int:
    """Tasks for CPU-bound rows: small in bytes, so size-based coalescing would serialise them."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def solve(grid: DataFrame, key: list[str], method: str, budget: float | None = None, p: Params = DEFAULTS, spread: int | None = None) -> DataFrame:
    """Line-up of every grid row: ``greedy``, ``upgraded``, ``exact`` or ``sampled``.

    An optional column ``budget`` sets the budget per row; optional ``prev_drivers``,
    ``prev_teams`` and ``free`` bring the transfer rules in.
    """
    limit = int(round((p.lineup_budget if budget is None else budget) * 10))
    types = dict(grid.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", " + OUT

    def run(batches):
        for pdf in batches:
            rows, res = list(pdf.itertuples(index=False)), []
            budgets = np.array([limit if getattr(r, "budget", None) is None else int(round(float(r.budget) * 10)) for r in rows], np.int64)
            for r, b, ideal in zip(rows, budgets.tolist(), ideals(rows, method, budgets, p)):
                prev = getattr(r, "prev_drivers", None)
                res.append(choose(r, method, b, p, ideal, None if prev is None else (list(prev), list(r.prev_teams)), int(getattr(r, "free", p.free_transfers))))
            yield _frame(key, rows, res)

    return grid.repartition(spread or tasks(grid), *key).mapInPandas(run, schema)


def season_walk(grid: DataFrame, key: list[str], season: str, order: str, method: str, p: Params = DEFAULTS) -> DataFrame:
    """Line-ups carried from race to race inside each season, with the transfers made.

    A group is one season of one configuration: a few dozen grid rows, which follow each other in one task. Only the transfers go from row to row,
    the line-ups that they aim at are found for all rows of a batch.
    """
    types = dict(grid.dtypes)
    cols = list(dict.fromkeys([*key, season, order]))
    schema = ", ".join(f"{k} {types[k]}" for k in cols) + ", " + OUT + ", n_transfers bigint"
    group = list(dict.fromkeys([k for k in key if k != "event_id"] + [season]))
    limit = int(round(p.lineup_budget * 10))

    def run(batches):
        own = prev = None
        for pdf in batches:
            rows, res, moved = list(pdf.itertuples(index=False)), [], []
            for r, ideal in zip(rows, ideals(rows, method, np.full(len(rows), limit, np.int64), p)):
                at = tuple(None if pd.isna(x) else x for x in (getattr(r, k) for k in group))
                if at != own:
                    own, prev = at, None
                got = choose(r, method, limit, p, ideal, prev, p.free_transfers)
                res.append(got)
                moved.append(0 if prev is None or not got[5] else len(set(got[0]) - set(prev[0])) + len(set(got[1]) - set(prev[1])))
                prev = (got[0], got[1]) if got[5] else prev
            out = _frame(cols, rows, res)
            out["n_transfers"] = moved
            yield out

    return grid.repartition(tasks(grid), *group).sortWithinPartitions(*group, F.col(order).asc_nulls_last(), *key).mapInPandas(run, schema)


def prediction_grid(pred: DataFrame, prices: DataFrame, cprices: DataFrame, drivers: DataFrame, key: list[str] = ["event_id"], prune: bool = False) -> DataFrame:
    """Grid from driver predictions: priced drivers and priced teams with their rolled-up points."""
    cols = [c for c in ("predicted_points", "lower", "upper") if c in pred.columns]
    rest = [k for k in key if k != "event_id"]
    d = J.priced(pred.select("event_id", "driver_id", *rest, *cols), prices)
    per_team = (pred.join(drivers.select("driver_id", F.col("team_id").alias("_t")), "driver_id")
                .groupBy(*key, F.col("_t").alias("team_id")).agg(*[F.sum(c).alias(c) for c in cols]))
    base = cprices.select("event_id", "team_id", "price")
    if rest:
        base = base.join(pred.select("event_id", *rest).distinct(), "event_id")
    t = J.with_default(base, per_team, [*key, "team_id"], {c: 0.0 for c in cols})
    return grids(d, t, key, prune)


def actual_grid(totals: DataFrame, ctotals: DataFrame, prices: DataFrame, cprices: DataFrame, prune: bool = True) -> DataFrame:
    """Grid of actual points: all priced cars and teams, 0 where nothing was scored."""

    def side(p, t, ident):
        pts = t.select("event_id", ident, F.col("race_total").cast("double").alias("predicted_points"))
        return J.with_default(p.select("event_id", ident, "price"), pts, ["event_id", ident], {"predicted_points": 0.0})

    return grids(side(prices, totals, "driver_id"), side(cprices, ctotals, "team_id"), ["event_id"], prune)
