"""Pairwise rankers, their bounds and the walk-forward run, against plain numpy."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexgrid.functions.quantiles import weighted_quantiles
from apexgrid.params import Params
from apexgrid.plans import models as M, pairwise as PW, walk

COLS = ["a", "b", "c"]


def season(spark, events=12, cars=12, noise=0.3, seed=1, split_points=False):
    """Points follow a hidden skill; ``b`` is noise, ``c`` does not vary. Two grids per weekend."""
    r = random.Random(seed)
    rows = []
    for e in range(events):
        for grid in range(2):
            n = cars - grid * 3
            skill = [r.random() for _ in range(n)]
            shown = [s + r.gauss(0, noise) for s in skill]
            order = sorted(range(n), key=lambda d: -skill[d])
            rows += [(2 * e + grid, d, 1, e, shown[d] * 100, r.random(), 4.0, float(order.index(d) + 1), float((n - order.index(d)) // (2 if split_points else 1))) for d in range(n)]
    return spark.createDataFrame(rows, "event_id int, driver_id int, season_id int, event_index int, a double, b double, c double, y_position double, y_points double")


def plain_terms(pdf, beta, latest, half_life):
    """Loss, gradient and cross products by loops over pairs."""
    loss, grad, cross = 0.0, np.zeros(len(COLS)), np.zeros((len(COLS),) * 2)
    for _, g in pdf.groupby("event_id"):
        x, y = g[COLS].to_numpy(), g["y_points"].to_numpy()
        w = 1.0 if half_life is None else 0.5 ** ((latest - g["event_index"].iloc[0]) / half_life)
        for i in range(len(g)):
            for j in range(len(g)):
                if y[i] > y[j]:
                    d = x[i] - x[j]
                    p = 1 / (1 + math.exp(d @ beta))
                    loss += w * math.log1p(math.exp(-(d @ beta)))
                    grad -= w * p * d
                    cross += w * p * (1 - p) * np.outer(d, d)
    return cross, grad, loss


@pytest.mark.parametrize("half_life", [None, 3.0])
def test_pair_terms_equal_loops(spark, half_life):
    df = season(spark, 4, 6, split_points=True)
    pdf = df.toPandas()
    beta = np.array([0.02, -0.4, 0.1])
    cross, grad, loss = plain_terms(pdf, beta, 3, half_life)
    rows = PW.event_arrays(df, COLS).toPandas()
    x, y, on = PW.padded(rows["cars"], len(COLS))
    got = PW.pair_terms(x, y, on, PW.event_weight(rows["event_index"].to_numpy(float), 3, half_life), beta)
    assert got == pytest.approx(np.concatenate([cross.ravel(), grad, [loss]]), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("version", ["v4", "race"])
def test_weights_end_where_the_gradient_does(spark, version):
    df = season(spark, 8).persist()
    m = M.make(version, COLS).fit(df)
    cross0, _, _ = plain_terms(df.toPandas(), np.zeros(3), 7, m.half_life)
    beta = np.array(m.weights)
    cross, grad, _ = plain_terms(df.toPandas(), beta, 7, m.half_life)
    scale = np.diag(cross0)
    used = scale > 1e-12
    assert np.abs((grad + m.ridge * scale * beta)[used] / np.sqrt(scale[used])).max() < 1e-4 and beta[2] == 0
    assert m.importances()[0][0] == "a"


def test_what_a_grid_shares_gets_no_weight_and_the_steps_end(spark, monkeypatch):
    """A column with one value per event differs in no pair. Its rounding must not be taken for curvature: weights would then be noise, and no step the last."""
    shared = {f"shared{k}": F.sin(F.col("event_id") * k) * 1000 + 2000 for k in range(1, 9)}
    df = season(spark, 10).withColumns(shared).persist()
    passes, reduced = [], PW._reduced
    monkeypatch.setattr(PW, "_reduced", lambda *a: passes.append(1) or reduced(*a))
    m = M.Ranker([*COLS, *shared], 5.0).fit(df)
    assert m.weights[2:] == [0.0] * 9 and len(passes) < 12
    assert m.weights[:2] == pytest.approx(M.Ranker(COLS, 5.0).fit(df).weights[:2], rel=1e-9)


@pytest.mark.parametrize("half_life", [None, 3.0])
def test_residuals_are_those_of_the_score_column(spark, half_life):
    df = season(spark, 6, split_points=True).withColumn("y_points", F.when(F.col("driver_id") != 5, F.col("y_points"))).persist()
    models = [(k, [0.3 / k, -1.7, 0.1], 2.5, 0.3 * k, [0.0] * 3) for k in (2, 4, 9)]
    latest = {2: 1.0, 4: 3.0, 9: 5.0}
    got = PW.residuals(PW.event_arrays(df, COLS), models, 3, latest, half_life).collect()
    weights = spark.createDataFrame([m[:4] for m in models], "split long, weights array<double>, slope double, intercept double")
    rows = df.where("y_points IS NOT NULL").join(weights, F.col("event_index") < F.col("split")).withColumn("p", PW.score(COLS) * F.col("slope") + F.col("intercept")).collect()
    want = [(r["split"], r["p"], r["y_points"] - r["p"], 1.0 if half_life is None else 0.5 ** ((latest[r["split"]] - r["event_index"]) / half_life)) for r in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_worse_than_least_squares_on_held_out_weekends(spark):
    """Rank correlation on later weekends, against the linear model of centred points."""
    total = [0.0, 0.0]
    for seed in range(3):
        df = season(spark, 16, seed=seed).persist()
        train, test = df.where("event_index < 11"), df.where("event_index >= 11")
        pdf = train.toPandas()
        centred = pdf[COLS] - pdf.groupby("event_id")[COLS].transform("mean")
        w = np.linalg.lstsq(centred.to_numpy(), (pdf["y_points"] - pdf.groupby("event_id")["y_points"].transform("mean")).to_numpy(), rcond=1e-10)[0]
        out = M.make("race", COLS).fit(train).predict(test).toPandas()
        out["linear"] = out[COLS].to_numpy() @ w
        for k, c in enumerate(("score", "linear")):
            total[k] += out.groupby("event_id")[[c, "y_points"]].corr("spearman").xs(c, level=1)["y_points"].mean()
    assert total[0] >= total[1] - 0.01 and total[0] / 3 > 0.5


def test_predictions_have_ranks_ids_and_ordered_bounds(spark):
    df = season(spark, 10).persist()
    out = M.make("v4", COLS).fit(df.where("event_index < 9")).predict(df.where("event_index = 9")).toPandas()
    for _, g in out.groupby("event_id"):
        assert sorted(g["predicted_position"]) == list(range(1, len(g) + 1))
    assert len(out) == df.where("event_index = 9").count() and (out["lower"] < out["upper"]).all()
    with pytest.raises(RuntimeError):
        M.make("v4", COLS).predict(df)


def test_flat_scores_are_not_calibrated(spark):
    df = season(spark, 4).withColumns({c: F.lit(2.0) for c in COLS}).persist()
    row = M.make("race", COLS).fit(df)._fitted().first()
    assert (row["slope"], row["intercept"], row["weights"]) == (1.0, 0.0, [0.0] * 3)
    out = M.make("race", COLS).fit(df).predict(df)
    assert out.select("predicted_position").distinct().count() == 2  # the mean rank of either grid


def test_training_without_rows(spark):
    df = season(spark, 2)
    out = M.make("v4", COLS).fit(df.where("event_id < 0")).predict(df)
    assert out.count() == df.count() and out.where("predicted_points <> 0 OR lower <> upper").count() == 0


def test_walk_equals_a_fit_per_split(spark):
    df = season(spark, 8).persist()
    got = walk.rank_forward(df, df, COLS, 5.0, Params(min_train=4)).persist()
    assert {r["event_index"] for r in got.select("event_index").distinct().collect()} == {4, 5, 6, 7}
    for i in (4, 7):
        m = M.Ranker(COLS, 5.0).fit(df.where(F.col("event_index") < i))
        want = m.predict(df.where(F.col("event_index") == i)).toPandas().set_index(["event_id", "driver_id"]).sort_index()
        own = got.where(F.col("event_index") == i).toPandas().set_index(["event_id", "driver_id"]).sort_index()
        for c in ("predicted_position", "predicted_points", "lower", "upper"):
            assert own[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9), c


def test_weighted_quantiles(spark):
    rng = random.Random(3)
    rows = [("wide", rng.gauss(0, 50), 10 ** rng.uniform(-6, 0)) for _ in range(700)] + [("ties", float(rng.randrange(4)), 1.0) for _ in range(40)] + \
        [("one", -3.5, 1e-6), ("tiny", 1e-12, 1.0), ("tiny", 2e-12, 1.0), ("tiny", -1e-12, 1.0), ("wide", None, 1.0), ("wide", 1e9, 0.0), ("none", None, 1.0)]
    shares = (0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r["k"]: r["q"] for r in weighted_quantiles(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w", shares, "q").collect()}
    assert set(got) == {"wide", "ties", "one", "tiny"}
    for key, q in got.items():
        own = sorted((v, w) for k, v, w in rows if k == key and v is not None and w > 0)
        total = sum(w for _, w in own)
        for share, value in zip(shares, q):
            run, want = 0.0, own[-1][0]
            for v, w in own:
                run += w
                if run >= share * total * (1 - 1e-12):
                    want = v
                    break
            assert value == want, (key, share)


def test_tree_bounds_are_weighted(spark):
    df = season(spark, 8).persist()
    spec = M.SPECS["v3"]
    assert (spec.min_rows, spec.columns) == (3, 0.7)
    res = df.select(F.col("a").alias("_p"), F.col("y_points").alias("r"), F.pow(F.lit(0.01), F.col("event_index")).alias("w"))
    cuts, table = M.residual_bounds(res)
    pdf = res.toPandas()
    for t in table:
        own = pdf[[sum(c < p for c in cuts) == t["b"] for p in pdf["_p"]]].sort_values("r")
        share = own["w"].cumsum() / own["w"].sum()
        assert t["lo"] == own["r"][share >= 0.1 - 1e-12].iloc[0] and t["hi"] == own["r"][share >= 0.9 - 1e-12].iloc[0]
