"""Boosted trees grown side by side, against MLlib's and against plain numpy; the walk-forward run and the sweep on them."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from apexgrid.params import Params
from apexgrid.plans import backtest as BT, forest as FO, models as M
from tests.test_rankers import COLS, season


def plain_trees(x, y, bins, model, m, number):
    """The same boosting by loops: predictions of all rows."""
    now = np.zeros(len(y))
    for t in range(model.trees):
        model.grown = t
        columns = FO.tree_columns(m, model, x.shape[1])
        use = np.ones(len(y), bool) if model.subsample == 1 else FO._uniform(m, t, number) < model.subsample
        aim = y if t == 0 else 2 * (y - now)
        add = np.zeros(len(y))

        def node(rows, depth):
            own = rows[use[rows]]
            best = (1e-9 * max(1.0, aim[own].sum() ** 2 / max(1, len(own))), None)
            if depth < model.depth and len(own):
                for c in columns:
                    for b in range(FO.BINS):
                        left, right = own[bins[own, c] <= b], own[bins[own, c] > b]
                        if min(len(left), len(right)) >= max(1, model.min_rows):
                            gain = aim[left].sum() ** 2 / len(left) + aim[right].sum() ** 2 / len(right) - aim[own].sum() ** 2 / len(own)
                            if gain > best[0] * (1 + 1e-12):
                                best = (gain, (c, b))
            if best[1] is None:
                add[rows] = aim[own].mean() if len(own) else 0.0
                return
            c, b = best[1]
            node(rows[bins[rows, c] <= b], depth + 1)
            node(rows[bins[rows, c] > b], depth + 1)
        node(np.arange(len(y)), 0)
        now += (1.0 if t == 0 else model.step) * add
    return now


@pytest.mark.parametrize("min_rows,columns", [(1, 1.0), (4, 0.7)])
def test_trees_equal_loops(spark, min_rows, columns):
    df = season(spark, 4, 7).persist()
    model = FO.Grown(4, 2, 0.1, min_rows, 1.0, columns, 4, 9)
    rows = FO.predicted(df, COLS, ["y_position"], [model], ["event_id", "driver_id"]).toPandas().sort_values(["event_id", "driver_id"])
    pdf = df.toPandas().sort_values(["event_id", "driver_id"])
    x, edges = pdf[COLS].to_numpy(), FO.bin_edges(df, COLS)
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    want = plain_trees(x, pdf["y_position"].to_numpy(), bins, FO.Grown(4, 2, 0.1, min_rows, 1.0, columns, 4, 9), 0, np.arange(len(x)))
    assert rows["p"].to_numpy() == pytest.approx(want, rel=1e-9)


def test_errors_are_near_those_of_mllib(spark):
    """Same boosting, other split candidates: within a tenth on a small table."""
    df = season(spark, 16).persist()
    got = {r["spec_id"]: r["mae"] for r in M.search(df, COLS, [M.TreeSpec(trees=20, depth=2, min_rows=3), M.TreeSpec(trees=1, depth=1)], folds=2).collect()}
    data = M._assembled(df, COLS).select("x", "event_index", "y_position").persist()
    for i, s in enumerate([M.TreeSpec(trees=20, depth=2, min_rows=3), M.TreeSpec(trees=1, depth=1)]):
        own = []
        for lo, hi in ((5, 11), (11, 16)):
            m = s.regressor("y_position").fit(data.where(F.col("event_index") < lo))
            own.append(m.transform(data.where((F.col("event_index") >= lo) & (F.col("event_index") < hi))).agg(F.avg(F.abs(F.col("_p") - F.col("y_position")))).first()[0])
        assert got[i] == pytest.approx(sum(own) / 2, rel=0.1)


def test_models_do_not_meet(spark):
    """A model's trees do not depend on which others grow beside it; drawn rows and columns repeat."""
    df = season(spark, 8).persist()
    spec = lambda: FO.Grown(6, 3, 0.1, 2, 0.7, 0.7, 5, 8)
    alone = FO.fold_errors(df, COLS, "y_position", [spec()])
    beside = FO.fold_errors(df, COLS, "y_position", [spec(), FO.Grown(3, 2, 0.2, 1, 1.0, 1.0, 4, 5), FO.Grown(1, 1, 0.2, 1, 1.0, 1.0, 0, 0)])
    assert beside[0] == pytest.approx(alone[0]) and beside[2] is None
    u = FO._uniform(3, 5, np.arange(20_000))
    assert abs(u.mean() - 0.5) < 0.01 and 0 <= u.min() and u.max() < 1


def test_blocks_do_not_matter(spark, monkeypatch):
    df = season(spark, 8).persist()
    spec = lambda: [FO.Grown(5, 3, 0.1, 2, 1.0, 0.7, 5, 8, half_life=h) for h in (None, 2.0)]
    one = FO.fold_errors(df, COLS, "y_position", spec())
    monkeypatch.setattr(FO, "BLOCK_ROWS", 30)
    assert FO.fold_errors(df, COLS, "y_position", spec()) == pytest.approx(one) and one[0] != one[1]


def test_tree_walk_covers_every_event_and_orders_bounds(spark, monkeypatch):
    monkeypatch.setitem(M.SPECS, "v1", M.TreeSpec(trees=6, depth=2))
    monkeypatch.setitem(M.SPECS, "v3", M.TreeSpec(trees=6, depth=2, subsample=0.7, columns=0.7, min_rows=3, bounds="quantile", half_life=10.0))
    df = season(spark, 8).persist()
    got = BT.predictions(df, df, {"v1": ["a", "b"], "v3:wide": COLS}, Params(min_train=5)).toPandas()
    assert {(p, e) for p, e in zip(got["predictor"], got["event_index"])} == {(p, e) for p in ("v1", "v3:wide") for e in (5, 6, 7)}
    assert len(got) == 2 * df.where("event_index >= 5").count() and (got["lower"] <= got["upper"]).all()
    # nothing after a split is seen by it
    later = BT.predictions(df.where("event_index < 6"), df, {"v1": ["a", "b"]}, Params(min_train=5)).toPandas().set_index(["event_id", "driver_id"])["predicted_points"]
    first = got[(got["predictor"] == "v1") & (got["event_index"] == 5)].set_index(["event_id", "driver_id"])["predicted_points"]
    assert first.sort_index().to_numpy() == pytest.approx(later[first.index].sort_index().to_numpy(), rel=1e-6)


def test_equal_seasons_are_solved_once(spark):
    rows = [(c, 10 + s, s, [1.0, float(c // 2)], [5, 6]) for c in range(4) for s in (1, 2)]
    grid = spark.createDataFrame(rows, "config_id long, event_id long, season_id long, d_p array<double>, t_x array<long>")
    same = BT.distinct_seasons(grid, spark.createDataFrame([(0, "exact"), (1, "exact"), (2, "greedy"), (3, "exact")], "config_id long, optimizer string"))
    assert {(r["config_id"], r["season_id"]): r["same"] for r in same.collect()} == {(c, s): {0: 0, 1: 0, 2: 2, 3: 3}[c] for c in range(4) for s in (1, 2)}
