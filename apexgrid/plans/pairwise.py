"""Pairwise logistic rankers of many training splits, fitted together.

A ranker is a linear score whose differences give the odds that one car of an event beats another. The loss of an event sums
``log(1 + exp(-(s_i - s_j)))`` over its pairs with more points for ``i``; each event has one weight. It is minimised by Newton
steps (iterated reweighting): per step every event adds its gradient and cross products to the splits it belongs to, which a partition sums
in place. One vector per (partition, split) is shuffled and summed in two steps, and each split is solved in its own task. Pairs are formed inside an
event's arrays only (a grid is bounded by the rules), never written.

A split ``k`` is trained on the events before ``k``; all splits of a walk-forward run share the passes, a single fit is a run of one split.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import weighted_quantiles
from ..functions.ranking import average_rank
from ..session import small_batches, stage

#: Shrinkage in units of a split's own curvature, most steps, and the step (in the same units) that ends them.
RIDGE, STEPS, SMALL = 1e-3, 40, 1e-6
#: Spread of scores under which they are not calibrated, prediction buckets of the bounds, and their residual shares.
FLAT, BUCKETS, SHARES = 1e-9, 10, (0.1, 0.9)
SALT = 64
_SUMS = "split bigint, salt int, sums array<double>"


def event_arrays(table: DataFrame, cols: list[str]) -> DataFrame:
    """One row per event: its index, and the cars' features and points in one flat array. Rows without points are left out, missing features are 0."""
    car = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols], F.col("y_points").cast("double"))
    return table.where(F.col("y_points").isNotNull()).groupBy("event_index", "event_id").agg(F.flatten(F.collect_list(car)).alias("cars"))


def event_weight(index: np.ndarray, latest: float, half_life: float | None) -> np.ndarray:
    return np.ones(len(index)) if half_life is None else 0.5 ** ((latest - index) / half_life)


def padded(cars: pd.Series, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (events, cars, p), points and presence of a batch of events."""
    n = np.array([len(c) for c in cars]) // (p + 1)
    on = np.arange(n.max()) < n[:, None]
    rows = np.zeros((*on.shape, p + 1))
    rows[on] = np.concatenate(cars.to_numpy()).reshape(-1, p + 1)
    return np.ascontiguousarray(rows[:, :, :p]), rows[:, :, p], on


@lru_cache(8)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of ``n`` cars: the first, the second, +1 and -1 for them by pair and car, and the pair of every two cars (one past the last on the diagonal)."""
    i, j = np.triu_indices(n, 1)
    sides = np.zeros((len(i), n))
    sides[np.arange(len(i)), i], sides[np.arange(len(i)), j] = 1, -1
    at = np.full((n, n), len(i))
    at[i, j] = at[j, i] = np.arange(len(i))
    return i, j, sides, at


def contrasts(x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features less those of the event's first car, and by (event, pair) 1 if the first car has more points, -1 if the second has, 0 for equal ones and absent cars.

    Only differences count in pairs: what all cars of an event share is exactly zero here, so no rounding of it gets a weight.
    """
    i, j, _, _ = _pairs(y.shape[1])
    return x - x[:, :1], ((y[:, i] > y[:, j]).astype(float) - (y[:, i] < y[:, j])) * (on[:, i] & on[:, j])


def pair_terms(x: np.ndarray, y: np.ndarray, on: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """(cross products, gradient, loss) of a batch of events as one vector."""
    return contrast_terms(*contrasts(x, y, on), w, beta)


def contrast_terms(x: np.ndarray, won: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The same from the batch's ``contrasts``."""
    n, p = x.shape[1:]
    i, j, sides, at = _pairs(n)
    flat = x.reshape(-1, p)
    s = (flat @ beta).reshape(-1, n)
    d = (s[:, i] - s[:, j]) * won
    small = np.exp(-np.abs(d))
    odds = 1 / (1 + small)  # of the car that is ahead by score
    wins = w[:, None] * np.abs(won)
    loss = float((wins * (np.log1p(small) - np.minimum(d, 0.0))).sum())
    miss = wins * np.where(d > 0, small * odds, odds)  # weight times the odds of the lower car
    grad = -(((miss * won) @ sides).ravel() @ flat)
    curve = np.zeros((len(won), len(i) + 1))
    np.multiply(wins * small, odds * odds, out=curve[:, :-1])
    both = -curve[:, at]
    both[:, np.arange(n), np.arange(n)] = -both.sum(2)
    cross = flat.T @ (both @ x).reshape(-1, p)
    return np.concatenate([cross.ravel(), grad, [loss]])


def _reduced(events: DataFrame, p: int, terms) -> DataFrame:
    """(split, salt, sums): sums of the (split, vector) that ``terms(index, x, y, on)`` gives for batches of events in rising order, in at most ``SALT`` rows a split."""
    def reduce_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            part = int(batch["_part"].iloc[0]) if len(batch) else part
            batch = batch.sort_values("event_index", kind="stable")
            for lo in range(0, len(batch), 64):
                some = batch.iloc[lo:lo + 64]
                for k, v in terms(some["event_index"].to_numpy(float), *padded(some["cars"], p)):
                    acc[k] = acc[k] + v if k in acc else v
        if acc:
            yield pd.DataFrame({"split": list(acc), "salt": [part % SALT] * len(acc), "sums": list(acc.values())})

    return events.select("event_index", "cars", F.spark_partition_id().alias("_part")).mapInPandas(reduce_part, _SUMS).groupBy("split", "salt").applyInPandas(_added, _SUMS)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"split": [pdf["split"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "sums": [np.stack(pdf["sums"].to_numpy()).sum(axis=0)]})


def _before(splits: list[int], index: np.ndarray) -> Iterator[tuple[int, int]]:
    """(split, how many events of a batch in rising order are before it), where there are any."""
    return ((k, n) for k, n in zip(splits, np.searchsorted(index, splits).tolist()) if n)


def newton(sums: np.ndarray, p: int, beta: np.ndarray, before: np.ndarray, lost: float, scale: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, bool]:
    """The next weights of a split, with what the step after them needs. A step that made the penalised loss larger is halved."""
    cross, grad, loss = sums[:p * p].reshape(p, p), sums[p * p:p * p + p], float(sums[-1])
    if not len(scale):
        scale = np.where(np.diag(cross) > 1e-12, np.diag(cross), 0.0)  # curvature at zero weights
    loss += 0.5 * ridge * float(scale @ beta ** 2)
    if loss > lost * (1 + 1e-12):
        return (beta + before) / 2, before, lost, scale, bool(np.abs((beta - before) * np.sqrt(scale)).max() < SMALL)
    used = scale > 0
    step = np.zeros(p)
    if used.any():
        d = np.sqrt(scale[used])
        a = cross[np.ix_(used, used)] / np.outer(d, d) + ridge * np.eye(used.sum())
        step[used] = np.linalg.lstsq(a, (grad[used] + ridge * scale[used] * beta[used]) / d, rcond=1e-12)[0] / d
    return beta - step, beta, loss, scale, not used.any() or bool(np.abs(step[used] * np.sqrt(scale[used])).max() < SMALL)


def fit_weights(events: DataFrame, splits: list[int], p: int, latest: dict[int, float], half_life: float | None, ridge: float = RIDGE) -> dict[int, np.ndarray]:
    """Weights of every split. What the driver keeps is the state of the splits: a few vectors of ``p`` numbers each."""
    state = {k: (np.zeros(p), np.zeros(p), np.inf, np.zeros(0)) for k in splits}
    done: dict[int, np.ndarray] = {}
    schema = "split bigint, beta array<double>, before array<double>, lost double, scale array<double>, done boolean"
    events = events.where(F.col("event_index") < max(splits))
    for _ in range(STEPS):
        now = dict(state)

        def terms(index, x, y, on):
            x, won = contrasts(x, y, on)
            for k, n in _before(list(now), index):
                yield k, contrast_terms(x[:n], won[:n], event_weight(index[:n], latest[k], half_life), now[k][0])

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["split"].iloc[0])
            beta, before, lost, scale, end = newton(np.stack(pdf["sums"].to_numpy()).sum(axis=0), p, *now[k], ridge)
            return pd.DataFrame({"split": [k], "beta": [beta], "before": [before], "lost": [lost], "scale": [scale], "done": [end]})

        rows = _reduced(events, p, terms).groupBy("split").applyInPandas(solve, schema).collect()  # one row per split
        state = {k: v for k, v in state.items() if k not in done}
        for r in rows:
            state[r["split"]] = tuple(np.asarray(r[c]) if c != "lost" else r[c] for c in ("beta", "before", "lost", "scale"))
            if r["done"]:
                done[r["split"]] = state.pop(r["split"])[0]
        if not rows or not state:
            break
        state = {k: v for k, v in state.items() if k in {r["split"] for r in rows}}
    return {k: done[k] if k in done else state[k][0] if k in state else np.zeros(p) for k in splits}


MODEL = "split bigint, weights array<double>, slope double, intercept double, spread array<double>"


def calibrated(events: DataFrame, weights: dict[int, np.ndarray], p: int) -> list[tuple]:
    """(split, weights, slope, intercept, spread): the line from scores to points, identity where scores do not differ, and the features' deviations."""
    def terms(index, x, y, on):
        v, z, ends = y[on], x[on], np.cumsum(on.sum(1))
        for k, n in _before(list(weights), index):
            cars = ends[n - 1]
            s, own, few = z[:cars] @ weights[k], v[:cars], z[:cars]
            yield k, np.concatenate([[cars, s.sum(), own.sum(), (s * s).sum(), (s * own).sum()], few.sum(0), np.einsum("np,np->p", few, few)])

    sums: dict[int, np.ndarray] = {}
    for r in _reduced(events.where(F.col("event_index") < max(weights)), p, terms).collect():  # at most SALT short vectors per split
        sums[r["split"]] = sums.get(r["split"], 0.0) + np.asarray(r["sums"])
    out = []
    for k, w in weights.items():
        slope, intercept, spread = 1.0, 0.0, np.zeros(p)
        if k in sums:
            n, s, v, ss, sv = sums[k][:5]
            mean, square = sums[k][5:5 + p] / n, sums[k][5 + p:] / n
            spread = np.sqrt(np.maximum(square - mean ** 2, 0))
            var = ss / n - (s / n) ** 2
            if var > FLAT ** 2:
                slope = float((sv / n - s / n * v / n) / var)
                intercept = float(v / n - slope * s / n)
        out.append((int(k), w.tolist(), slope, intercept, spread.tolist()))
    return out


def score(cols: list[str]) -> Column:
    """The score of a row beside its model's ``weights``."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.aggregate(F.zip_with(x, F.col("weights"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def bucket(value: Column, cuts: Column) -> Column:
    """How many cuts lie below."""
    return F.size(F.filter(cuts, lambda c: c < value))


def residuals(events: DataFrame, models: list[tuple], p: int, latest: dict[int, float], half_life: float | None) -> DataFrame:
    """(split, p, r, w): of every split and training row its prediction, what it missed and its weight; scores are summed column by column, as ``score`` does."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("event_index", kind="stable")
            index = batch["event_index"].to_numpy(float)
            for lo in range(0, len(batch), 256):
                some, own = batch["cars"].iloc[lo:lo + 256], index[lo:lo + 256]
                x, y, on = padded(some, p)
                z, y, ends, out = np.ascontiguousarray(x[on].T), y[on], np.cumsum(on.sum(1)), []
                for k, weights, slope, intercept, _ in models:
                    n = int(np.searchsorted(own, k))
                    if n:
                        cars = ends[n - 1]
                        s = np.zeros(cars)
                        for c, v in zip(z, weights):
                            s += c[:cars] * v
                        at = s * slope + intercept
                        w = np.repeat(event_weight(own[:n], latest[k], half_life), on[:n].sum(1))
                        out.append((np.full(cars, k), at, y[:cars] - at, w))
                if out:
                    yield pd.DataFrame(dict(zip(("split", "p", "r", "w"), map(np.concatenate, zip(*out)))))

    last = max((m[0] for m in models), default=0)
    return events.where(F.col("event_index") < last).select("event_index", "cars").mapInPandas(rows, "split bigint, p double, r double, w double")


def bounds(rows: DataFrame) -> DataFrame:
    """(split, cuts, quantiles) from ``residuals``: deciles of a split's training predictions and, by bucket between them, exact weighted residual quantiles."""
    rows = stage(rows, "residuals")
    cuts = stage(weighted_quantiles(rows, ["split"], "p", "w", tuple(i / BUCKETS for i in range(1, BUCKETS)), "cuts"), "cuts")
    per = weighted_quantiles(rows.join(cuts, "split").withColumn("b", bucket(F.col("p"), F.col("cuts"))), ["split", "b"], "r", "w", SHARES, "q")
    return per.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("b", "q"))).alias("quantiles")).join(cuts, "split")


def fit_splits(table: DataFrame, cols: list[str], splits: list[int], half_life: float | None, ridge: float = RIDGE) -> DataFrame:
    """One row per split: weights, calibration and bounds of the ranker trained on the events before it."""
    spark, p = table.sparkSession, len(cols)
    events = stage(event_arrays(table, cols), "event-arrays")
    # the newest training event of a split has weight one
    seen = [r[0] for r in events.select("event_index").distinct().orderBy("event_index").collect()]  # the calendar
    latest = {k: float(max((i for i in seen if i < k), default=k - 1)) for k in splits}
    with small_batches(spark):
        rows = calibrated(events, fit_weights(events, splits, p, latest, half_life, ridge), p)
        near = bounds(residuals(events, rows, p, latest, half_life))
    # written, so that the join with the field knows how small they are
    return stage(spark.createDataFrame(rows, MODEL).join(near, "split", "left"), "models")


def ranked(field: DataFrame, cols: list[str]) -> DataFrame:
    """Predictions of ``field``, whose rows stand beside their model's columns."""
    out = field.withColumn("score", score(cols)).withColumn("predicted_points", F.col("score") * F.col("slope") + F.col("intercept"))
    q = F.try_element_at("quantiles", bucket(F.col("predicted_points"), F.col("cuts")))
    pts = F.col("predicted_points")
    lo, hi = pts + F.coalesce(q[0], F.lit(0.0)), pts + F.coalesce(q[1], F.lit(0.0))
    # the model's columns go before the ranks, whose shuffle need not carry them
    out = out.withColumns({"lower": F.least(lo, hi), "upper": F.greatest(lo, hi)}).drop("weights", "slope", "intercept", "spread", "quantiles", "cuts")
    return out.withColumn("predicted_position", average_rank(["event_id"], "score", ascending=False))
