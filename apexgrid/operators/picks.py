"""Numpy helpers that choose one line-up from one event's field (a bounded grid).

Prices are whole tenths.  ``points`` may hold many scenarios (rows) at once, so a
sampled line-up costs a few vector operations per car instead of a loop per scenario.
"""
from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np

from .draws import triangular


def greedy(points: np.ndarray, price: np.ndarray, k: int, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value first; take a car only if the cheapest later cars can fill the rest. Prices are one row, or one per row of ``points``."""
    s, n = points.shape
    rows = np.arange(s)
    order = np.argsort(-(points / price), axis=1, kind="stable")
    p = np.ascontiguousarray(np.take_along_axis(np.broadcast_to(price, points.shape), order, axis=1).T)
    # before[i][j]: the sum of the j cheapest of the cars after i, kept in order while walking from the last
    before, low = [None] * n, []
    for i in range(n - 1, -1, -1):
        before[i] = np.stack([np.zeros(s, np.int64), *np.cumsum(low, axis=0)], axis=1) if low else np.zeros((s, 1), np.int64)
        x, kept = p[i], []
        for v in low:
            kept.append(np.minimum(v, x))
            x = np.maximum(v, x)
        low = [*kept, x][:k - 1]
    picked, left, got = np.zeros((s, n), bool), budget.astype(np.int64).copy(), np.zeros(s, int)
    for i in range(n):
        if (got == k).all():
            break
        need = np.clip(k - got - 1, 0, before[i].shape[1] - 1)
        ok = (got < k) & (p[i] + before[i][rows, need] <= left)
        picked[rows[ok], order[ok, i]] = True
        left -= np.where(ok, p[i], 0)
        got += ok
    return picked, order


def upgrade(points: np.ndarray, price: np.ndarray, picked: np.ndarray, order: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Swap a picked car for the best affordable one with more points, until none is left. Of the cars that can be swapped the first by value goes."""
    out = picked
    live = np.arange(len(points))  # rows that may still change
    points, price, budget = points, np.broadcast_to(price, points.shape), np.broadcast_to(budget, len(points))
    while len(live):
        rows = np.arange(len(live))
        room = budget - (picked * price).sum(axis=1)
        held = np.take_along_axis(picked, order, axis=1)
        free = np.where(picked, -np.inf, points)
        swapped = np.zeros(len(live), bool)
        for j in range(int(held.sum(axis=1).max(initial=0))):
            cur = order[rows, held.argmax(axis=1)]  # the next picked car by value
            some = held.any(axis=1) & ~swapped
            held[rows, held.argmax(axis=1)] = False
            reach = np.where(price <= (room + price[rows, cur])[:, None], free, -np.inf)
            best = reach.argmax(axis=1)
            hit = some & (reach[rows, best] > points[rows, cur])
            picked[rows[hit], cur[hit]] = False
            picked[rows[hit], best[hit]] = True
            swapped |= hit
        out[live] = picked
        live, points, price, picked, order, budget = (x[swapped] for x in (live, points, price, picked, order, budget))
    return out


def value_lineup(dp, dx, tp, tx, budget, improve: bool, kd: int = 5, kt: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Masks of chosen cars [S, n] and teams [S, m]; two cheapest teams are reserved first. Prices and budget hold for all rows, or are given by row."""
    total = np.broadcast_to(np.asarray(budget, np.int64), len(dp))
    car_budget = total - np.sort(tx, axis=-1)[..., :kt].sum(axis=-1)
    cars, order = greedy(dp, dx, kd, car_budget)
    if improve:
        cars = upgrade(dp, dx, cars, order, car_budget)
    team_budget = total - (cars * dx).sum(axis=1)
    teams, order = greedy(tp, tx, kt, team_budget)
    return cars, upgrade(tp, tx, teams, order, team_budget) if improve else teams


def _knapsack(gain: np.ndarray, price: np.ndarray, new: np.ndarray, k: int, budget: int, news: int):
    """Best value per (picked, new picks, spend limit); ``gain[i, j]`` is the value of item i as pick j."""
    best = np.full((k + 1, news + 1, budget + 1), -np.inf)
    best[0, 0, :] = 0.0
    took = np.zeros((len(price), k, news + 1, budget + 1), bool)
    for i, (p, w) in enumerate(zip(price, new)):
        if p > budget:
            continue
        cand = best[:-1, :news + 1 - w, :budget + 1 - p] + gain[i][:, None, None]
        view = best[1:, w:, p:]
        up = cand > view
        took[i, :, w:, p:] = up
        view[up] = cand[up]
    return best[k], took


def _trace(took, price, new, k, m, b):
    out = []
    for i in range(len(price) - 1, -1, -1):
        if k and took[i, k - 1, m, b]:
            out.append(i)
            k, m, b = k - 1, m - new[i], b - price[i]
    return out


#: Sets of cars up to which all are looked at; larger fields go by the knapsack, which gives the same line-up.
MOST_SETS = 40_000


@lru_cache(64)
def _sets(n: int, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """All sets of ``k`` of ``n`` items, by their largest item, then the next: per size (the set without its largest item, that item), and the members in rising order."""
    levels, members = [], np.zeros((1, 0), np.int64)
    for size in range(1, k + 1):
        # what can precede item i are the sets of items under i: the first ones in this order
        counts = [comb(i, size - 1) for i in range(n)]
        rest = np.concatenate([np.arange(c) for c in counts]) if n else np.zeros(0, np.int64)
        last = np.repeat(np.arange(n), counts)
        levels.append((rest, last))
        members = np.column_stack([members[rest], last])
    return levels, members


def _added(levels, first: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sums over sets, from the first item to the last; ``first`` holds for the first of a set, ``other`` for the rest."""
    out = first[levels[0][1]]
    for rest, last in levels[1:]:
        out = out[rest] + other[last]
    return out


def exact(dp, dx, tp, tx, budget: int, d_new=None, t_new=None, threshold=0.0, penalty=0.0, free=0, kd=5, kt=2):
    """Line-up of largest value: indexes of cars and teams, or None when nothing fits.

    Value = points + best car once more - threshold per new pick - penalty per paid transfer.
    Cars are taken in falling points, so the first pick is the boosted one. Of equal line-ups the one with fewer new cars, then fewer new teams,
    then the cheaper cars, then the set without the last items counts, as in ``knapsack``.
    """
    prev = d_new is not None
    if comb(len(dp), kd) > MOST_SETS or comb(len(tp), kt) > MOST_SETS or not (np.isfinite(dp).all() and np.isfinite(tp).all()):
        return knapsack(dp, dx, tp, tx, budget, d_new, t_new, threshold, penalty, free, kd, kt)
    if len(dp) < kd or len(tp) < kt or budget < 0:
        return None
    o = np.argsort(-dp, kind="stable")
    new = np.zeros(len(dp), np.int64) if d_new is None else d_new.astype(np.int64)[o]
    t_new = np.zeros(len(tp), np.int64) if t_new is None else t_new.astype(np.int64)
    levels, members = _sets(len(dp), kd)
    other = dp[o] - threshold * new
    value = _added(levels, other + dp[o], other)
    # cost and new cars of a set in one number
    both = _added(levels, *[dx[o].astype(np.int64) + (new << 32)] * 2)
    cost, news = both & ((1 << 32) - 1), both >> 32
    t_levels, t_members = _sets(len(tp), kt)
    t_value = _added(t_levels, *[tp - threshold * t_new] * 2)
    t_cost, t_news = _added(t_levels, *[np.asarray(tx, np.int64)] * 2), _added(t_levels, *[t_new] * 2)
    # best[c, r + 1]: the best teams with c new ones for r at most; nothing fits into a negative rest
    best = np.full((kt + 1, budget + 2), -np.inf)
    fits = t_cost <= budget
    np.maximum.at(best, (t_news[fits], t_cost[fits] + 1), t_value[fits])
    best = np.maximum.accumulate(best, axis=1)
    paid = penalty * np.maximum(0, np.arange(kd + 1)[:, None] + np.arange(kt + 1) - free) * prev
    about = (best[None] - paid[:, :, None]).max(axis=1)
    rest = np.maximum(budget - cost, -1) + 1
    total = value + about.ravel()[news * (budget + 2) + rest]
    top = total.max()
    if top == -np.inf:
        return None
    # the few sets within rounding of the best are told apart in the knapsack's order of sums
    near = np.flatnonzero(total >= top - 1e-9 * max(1.0, abs(top)))
    sums = (value[near, None] + best[:, rest[near]].T) - paid[news[near]]
    top = sums.max()
    i, c = np.nonzero(sums == top)
    a = news[near[i]]
    least = np.lexsort((cost[near[i]], c, a))[0]
    a, c, b = a[least], c[least], cost[near[i[least]]]
    own = near[(news[near] == a) & (cost[near] == b)]
    cars = own[value[own].argmax()]
    own = np.flatnonzero((t_news == c) & (t_cost <= budget - b))
    teams = own[t_value[own].argmax()]
    return o[members[cars][::-1]], t_members[teams][::-1]


def knapsack(dp, dx, tp, tx, budget: int, d_new=None, t_new=None, threshold=0.0, penalty=0.0, free=0, kd=5, kt=2):
    """``exact`` for fields of any size, by cost."""
    prev = d_new is not None
    d_new = np.zeros(len(dp), int) if d_new is None else d_new.astype(int)
    t_new = np.zeros(len(tp), int) if t_new is None else t_new.astype(int)
    o = np.argsort(-dp, kind="stable")
    gain = np.repeat((dp[o] - threshold * d_new[o])[:, None], kd, axis=1)
    gain[:, 0] += dp[o]
    md, mt = (kd, kt) if prev else (0, 0)
    cars, took_d = _knapsack(gain, dx[o], d_new[o], kd, budget, md)
    teams, took_t = _knapsack(np.repeat((tp - threshold * t_new)[:, None], kt, axis=1), tx, t_new, kt, budget, mt)
    best, where = -np.inf, None
    for a in range(md + 1):
        for c in range(mt + 1):
            v = cars[a] + teams[c][::-1] - penalty * max(0, a + c - free) * prev
            b = int(v.argmax())
            if v[b] > best:
                best, where = v[b], (a, c, b)
    if where is None:
        return None
    a, c, b = where
    return o[_trace(took_d, dx[o], d_new[o], kd, a, b)], np.array(_trace(took_t, tx, t_new, kt, c, budget - b), int)


def limit_transfers(ideal, current, pts: tuple[dict, dict], price: tuple[dict, dict], free: int, penalty: float, budget: int):
    """The line-up between ``current`` and ``ideal`` (pairs of id lists: cars, teams) that the transfer rules allow, and its cost.

    Leavers by rising points are zipped with arrivals by falling points. By falling gain, the swaps allowed are a
    prefix of the list: the free ones, and those whose gain exceeds the penalty. Costs after each prefix
    are one running sum; the longest allowed prefix within the budget is made. What has no price costs more than any budget.
    """
    swaps = []  # (gain, kind, leaver, arrival, cost)
    for kind in (0, 1):
        held, wanted = (set(map(int, x[kind])) for x in (current, ideal))
        worth = lambda x: pts[kind].get(x, 0.0)
        cost = lambda x: price[kind].get(x, budget + 10)
        leave, come = sorted(sorted(held - wanted), key=worth), sorted(sorted(wanted - held), key=lambda x: -worth(x))
        swaps += [(worth(c) - worth(a), kind, a, c, cost(c) - cost(a)) for a, c in zip(leave, come)]
    swaps.sort(key=lambda x: -x[0])
    allowed = max(min(free, len(swaps)), sum(x[0] > penalty for x in swaps))
    spent = total = sum(price[k].get(x, budget + 10) for k in (0, 1) for x in current[k])
    made = 0
    for n, swap in enumerate(swaps[:allowed], 1):
        total += swap[4]
        if total <= budget:
            made, spent = n, total
    to = [{a: c for _, kind, a, c, _ in swaps[:made] if kind == k} for k in (0, 1)]
    return [[to[k].get(int(x), int(x)) for x in current[k]] for k in (0, 1)], int(spent)


def best_of_scenarios(d, t, dx, tx, budget: int, du: np.ndarray, tu: np.ndarray):
    """Candidate line-ups from the scenarios; the one with the best mean over all of them.

    ``d`` and ``t`` are (lower, points, upper), ``du`` and ``tu`` the draws [scenario, item]; the boost follows the best car of each scenario.
    """
    dp, tp = triangular(du, *d), triangular(tu, *t)
    return best_candidate(dp, tp, *value_lineup(dp, dx, tp, tx, budget, improve=True))


def best_candidate(dp: np.ndarray, tp: np.ndarray, cars: np.ndarray, teams: np.ndarray):
    """Of the line-ups chosen per scenario the one with the best mean over all scenarios, and how many there are."""
    n = cars.shape[1]
    masks = np.concatenate([cars, teams], axis=1)
    if masks.shape[1] <= 62:
        # rows in the order of their bits, the first the highest
        _, at = np.unique(masks @ (1 << np.arange(masks.shape[1], dtype=np.int64)[::-1]), return_index=True)
        uniq = masks[at]
    else:
        uniq = np.unique(masks, axis=0)
    c, q = uniq[:, :n], uniq[:, n:]
    # the best car of a candidate by scenario: its cars one after the other, no car standing for those that it lacks
    by_car = np.concatenate([dp.T, np.full((1, len(dp)), -np.inf)])
    members = np.sort(np.where(c, np.arange(n), n), axis=1)[:, :int(c.sum(axis=1).max(initial=1)) or 1]
    boost = by_car[members[:, 0]]
    for k in range(1, members.shape[1]):
        np.maximum(boost, by_car[members[:, k]], out=boost)
    mean = (dp @ c.T + tp @ q.T + boost.T).mean(axis=0)
    i = int(mean.argmax())
    return np.flatnonzero(c[i]), np.flatnonzero(q[i]), len(uniq)
