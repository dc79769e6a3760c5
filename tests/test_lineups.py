"""Line-up selection against brute force on small fields."""
import itertools
import random

import numpy as np
import pytest

from apexgrid.operators import lineup as LN, picks as X


def field(seed, n=9, m=4):
    r = random.Random(seed)
    d = [(r.randint(-5, 40), r.randint(30, 300)) for _ in range(n)]
    t = [(r.randint(-5, 60), r.randint(60, 280)) for _ in range(m)]
    arr = lambda x, i, ty: np.array([v[i] for v in x], ty)
    return arr(d, 0, float), arr(d, 1, np.int64), arr(t, 0, float), arr(t, 1, np.int64)


def brute(dp, dx, tp, tx, budget, dn=None, tn=None, thr=0.0, pen=0.0, free=0):
    best = None
    for c in itertools.combinations(range(len(dp)), 5):
        for q in itertools.combinations(range(len(tp)), 2):
            if dx[list(c)].sum() + tx[list(q)].sum() > budget:
                continue
            v = dp[list(c)].sum() + dp[list(c)].max() + tp[list(q)].sum()
            if dn is not None:
                news = dn[list(c)].sum() + tn[list(q)].sum()
                v -= thr * news + pen * max(0, news - free)
            best = v if best is None else max(best, v)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_exact_equals_brute_force(seed):
    f = field(seed)
    got, want = X.exact(*f, 1000), brute(*f, 1000)
    if want is None:
        assert got is None
    else:
        c, q = got
        assert len(set(c)) == 5 and len(set(q)) == 2 and f[1][c].sum() + f[3][q].sum() <= 1000
        assert f[0][c].sum() + f[0][c].max() + f[2][q].sum() == want


@pytest.mark.parametrize("seed", range(15))
def test_exact_with_transfers_equals_brute_force(seed):
    f, r = field(100 + seed), random.Random(seed)
    dn = np.array([r.random() < .6 for _ in f[0]]).astype(int)
    tn = np.array([r.random() < .6 for _ in f[2]]).astype(int)
    got, want = X.exact(*f, 1100, dn.astype(bool), tn.astype(bool), 10.0, 10.0, 2), brute(*f, 1100, dn, tn, 10.0, 10.0, 2)
    if want is None:
        assert got is None
        return
    c, q = got
    news = dn[c].sum() + tn[q].sum()
    assert f[0][c].sum() + f[0][c].max() + f[2][q].sum() - 10 * news - 10 * max(0, news - 2) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(12))
def test_looking_at_all_sets_gives_the_line_up_of_the_knapsack(seed):
    """The same picks in the same order, with many equal line-ups, few cars and nothing that fits, too."""
    r = np.random.default_rng(seed)
    for n, m, budget in ((20, 10, 1000), (14, 9, 700), (6, 3, 600), (5, 2, 2000), (4, 2, 1000), (9, 1, 1000), (20, 10, 200)):
        dp, tp = r.integers(-3, 6, n).astype(float), r.integers(-3, 6, m).astype(float)
        dx, tx = r.integers(1, 7, n) * 50, r.integers(2, 6, m) * 50
        for also in ((), (r.random(n) < .6, r.random(m) < .6, 10.0, 10.0, 2)):
            got, want = X.exact(dp, dx, tp, tx, budget, *also), X.knapsack(dp, dx, tp, tx, budget, *also)
            assert (got is None) == (want is None) and (got is None or [list(x) for x in got] == [list(x) for x in want])


@pytest.mark.parametrize("method", ["greedy", "upgraded", "sampled"])
def test_rows_of_a_batch_are_solved_together(monkeypatch, method):
    """As if each were alone, in far fewer steps than rows."""
    from types import SimpleNamespace
    rows = []
    for e in range(40):
        dp, dx, tp, tx = field(e, 12 - e % 2, 6)
        ids = lambda x: np.arange(1, len(x) + 1)
        rows.append(SimpleNamespace(event_id=e, d_id=ids(dp), d_x=dx, d_p=dp, d_lo=dp - 5, d_hi=dp + 8, t_id=ids(tp), t_x=tx, t_p=tp, t_lo=tp - 5, t_hi=tp + 8))
    calls, value_lineup = [], X.value_lineup
    monkeypatch.setattr(X, "value_lineup", lambda *a, **k: calls.append(1) or value_lineup(*a, **k))
    p, budgets = LN.DEFAULTS, np.array([900 + 10 * (e % 3) for e in range(40)])
    together = LN.ideals(rows, method, budgets, p)
    assert len(calls) <= 6
    assert together == [LN.ideals([r], method, budgets[[i]], p)[0] for i, r in enumerate(rows)] and all(x[5] for x in together)


def plain_greedy(p, x, k, budget):
    order = sorted(range(len(p)), key=lambda i: -(p[i] / x[i]))
    out, left = [], budget
    for pos, i in enumerate(order):
        if len(out) == k:
            break
        rest = sorted(x[j] for j in order[pos + 1:])[:k - len(out) - 1]
        if x[i] + sum(rest) <= left:
            out.append(i)
            left -= x[i]
    return set(out), order


def plain_upgrade(p, x, picked, order, budget):
    while True:
        cost = sum(x[i] for i in picked)
        for i in [j for j in order if j in picked]:
            better = [j for j in range(len(p)) if j not in picked and x[j] <= budget - cost + x[i] and p[j] > p[i]]
            if better:
                picked = picked - {i} | {max(better, key=lambda j: (p[j], -j))}
                break
        else:
            return picked


@pytest.mark.parametrize("seed", range(20))
def test_greedy_and_upgrade_equal_a_plain_loop(seed):
    dp, dx, tp, tx = field(seed, 14, 6)
    cars, order = X.greedy(dp[None], dx, 5, np.array([700]))
    want, plain_order = plain_greedy(dp, dx, 5, 700)
    assert set(np.flatnonzero(cars[0])) == want and list(order[0]) == plain_order
    up = X.upgrade(dp[None], dx, cars.copy(), order, np.array([700]))
    assert set(np.flatnonzero(up[0])) == plain_upgrade(dp, dx, want, plain_order, 700)


@pytest.mark.parametrize("seed", range(10))
def test_exact_is_never_below_the_greedy_forms(seed):
    dp, dx, tp, tx = field(seed, 20, 10)
    got = X.exact(dp, dx, tp, tx, 1000)
    best = dp[got[0]].sum() + dp[got[0]].max() + tp[got[1]].sum()
    for improve in (False, True):
        c, q = X.value_lineup(dp[None], dx, tp[None], tx, 1000, improve)
        if c[0].sum() == 5 and q[0].sum() == 2:
            assert dp[c[0]].sum() + dp[c[0]].max() + tp[q[0]].sum() <= best


def test_transfer_limit_takes_free_swaps_then_paid_ones_above_the_penalty():
    pts = ({1: 10., 2: 9., 3: 8., 4: 7., 5: 6., 6: 40., 7: 20., 8: 12.}, {1: 5., 2: 4., 3: 6.})
    price = ({i: 100 for i in range(1, 9)}, {i: 100 for i in range(1, 4)})
    now, _ = X.limit_transfers(([1, 2, 6, 7, 8], [1, 3]), ([1, 2, 3, 4, 5], [1, 2]), pts, price, 2, 10.0, 1000)
    # gains: 6 for 5 (+34), 7 for 4 (+13), 8 for 3 (+4), team 3 for 2 (+2)
    assert sorted(now[0]) == [1, 2, 3, 6, 7] and sorted(now[1]) == [1, 2]
    paid, _ = X.limit_transfers(([1, 2, 6, 7, 8], [1, 3]), ([1, 2, 3, 4, 5], [1, 2]), pts, price, 1, 10.0, 1000)
    assert sorted(paid[0]) == [1, 2, 3, 6, 7]


def test_unpriced_cars_are_forced_out_by_the_budget():
    pts = ({i: 1. for i in range(1, 7)}, {1: 1., 2: 1.})
    price = ({2: 100, 3: 100, 4: 100, 5: 100, 6: 100}, {1: 100, 2: 100})
    now, _ = X.limit_transfers(([2, 3, 4, 5, 6], [1, 2]), ([1, 2, 3, 4, 5], [1, 2]), pts, price, 2, 10.0, 1000)
    assert 1 not in now[0]


def test_sampled_lineup_is_reproducible_and_partition_independent(spark, views):
    from apexgrid.catalog.bindings import RACING
    v = views.stage(*RACING)
    g = LN.prediction_grid(v.b_pred.select("event_id", "driver_id", "predicted_points", "lower", "upper"), v.b_price, v.b_cprice, v.b_driver)
    a = LN.solve(g, ["event_id"], "sampled", spread=1).orderBy("event_id").collect()
    b = LN.solve(g, ["event_id"], "sampled", spread=7).orderBy("event_id").collect()
    assert a == b
    for r in a:
        if r["feasible"]:
            assert len(set(r["driver_ids"])) == 5 and len(set(r["team_ids"])) == 2
            assert r["boost_id"] in r["driver_ids"] and r["total_cost"] <= 100.0


def test_pruning_by_price_keeps_the_optimum(spark, views):
    from apexgrid.catalog.bindings import RACING
    v = views.stage(*RACING)
    p = v.b_pred.select("event_id", "driver_id", "predicted_points")
    best = [{r["event_id"]: r["predicted_points"] for r in LN.solve(
        LN.prediction_grid(p, v.b_price, v.b_cprice, v.b_driver, prune=x), ["event_id"], "exact").collect()} for x in (False, True)]
    assert best[0] == best[1] and len(best[0]) > 0


def test_season_walk_counts_transfers_and_restarts(spark, views):
    from apexgrid.catalog.bindings import RACING
    v = views.stage(*RACING)
    p = v.b_pred.select("event_id", "driver_id", "predicted_points")
    g = LN.prediction_grid(p, v.b_price, v.b_cprice, v.b_driver).join(v.b_event.select("event_id", "season_id", "round_no"), "event_id")
    rows = LN.season_walk(g, ["event_id"], "season_id", "round_no", "exact").orderBy("season_id", "round_no").collect()
    prev, season = None, None
    for r in rows:
        if r["season_id"] != season:
            prev, season = None, r["season_id"]
            assert r["n_transfers"] == 0
        elif prev and r["feasible"]:
            assert r["n_transfers"] == len(set(r["driver_ids"]) - set(prev[0])) + len(set(r["team_ids"]) - set(prev[1]))
        prev = (r["driver_ids"], r["team_ids"]) if r["feasible"] else prev


def test_draws_are_equal_in_columns_and_arrays(spark):
    import numpy as np
    from apexgrid.operators import draws as D
    rows = [(e, d, float(d % 7), float(d % 7 + d % 3), float(d % 7 + 5 * (d % 4))) for e in (19971, 2**40 + 3) for d in range(60)]
    df = spark.createDataFrame(rows, "event_id long, driver_id long, lower double, predicted_points double, upper double")
    got = {(r["event_id"], r["driver_id"], r["scenario"]): r["value"] for r in D.scenario_values(df, 40).collect()}
    for e in (19971, 2**40 + 3):
        own = [r for r in rows if r[0] == e]
        lo, mo, hi = (np.array([r[k] for r in own]) for k in (2, 3, 4))
        want = D.triangular(D.uniforms(e, D.DRIVER, np.array([r[1] for r in own]), 40), lo, mo, hi)
        assert all(abs(got[e, own[i][1], s] - want[s, i]) < 1e-12 for s in range(40) for i in range(60))
        assert ((want >= lo) & (want <= hi)).all()
    u = np.concatenate([D.uniforms(e, k, np.arange(50), 500).ravel() for e in range(4) for k in (D.DRIVER, D.TEAM)])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.003 and abs(u.std() - 12 ** -0.5) < 0.003
    a, b = D.uniforms(1, D.DRIVER, np.arange(200), 500), D.uniforms(2, D.DRIVER, np.arange(200), 500)
    assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.01 and abs(np.corrcoef(a[:, 0], a[:, 1])[0, 1]) < 0.2
