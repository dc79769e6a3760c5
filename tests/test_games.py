"""Scoring, prices, ledger, metrics, models."""
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from apexgrid.operators import prices as PR, scoring as SC, windows as W
from apexgrid.plans import evaluation as E, models as M

RES = "event_id int, driver_id int, session_type string, position int, grid_position int, status string, classified_position string, fastest_lap_rank int"


def items(spark, row, overtakes=0):
    df = spark.createDataFrame([(1, 1, *row)], RES)
    ov = spark.createDataFrame([(1, 1, overtakes)], "event_id int, driver_id int, overtakes int")
    return sorted((r["scoring_item"], r["points"]) for r in SC.race_items(df, ov, ["event_id"]).collect())


def test_race_items(spark):
    assert items(spark, ("R", 1, 3, "Finished", "1", 1), 4) == [("Fastest Lap", 10), ("Overtake Bonus", 4), ("Positions Gained", 2), ("Race Position", 25)]
    assert items(spark, ("R", 12, 10, "+1 Lap", "12", 5)) == [("Positions Lost", -2)]
    assert items(spark, ("R", None, 3, "Engine", "R", 1), 4) == [("Race DNF", -20)]
    assert items(spark, ("R", 2, 3, "Finished", "d", 1), 4) == [("Race DSQ", -20)]
    assert items(spark, ("S", 8, 8, "Finished", "8", None)) == [("Sprint Position", 1)]
    assert items(spark, ("R", 15, 15, "Finished", "15", None)) == []


def test_quali_items(spark):
    def q(*row):
        return [(r["scoring_item"], r["points"]) for r in SC.quali_items(spark.createDataFrame([(1, 1, *row)], RES), ["event_id"]).collect()]
    assert q("Q", 1, None, "Finished", "1", None) == [("Qualifying Position", 10)]
    assert q("Q", None, None, "Finished", "", None) == [("Qualifying No Time", -5)]
    assert q("SQ", None, None, "Finished", "", None) == [("Sprint Qualifying No Time", -10)]
    assert q("Q", None, None, "Engine", "", None) == [] and q("Q", 11, None, "Finished", "11", None) == [] and q("Q", 1, None, "Finished", "D", None) == []


def test_progression_counts_the_primary_session_or_the_shared_list(spark):
    rows = [(1, d, t, p, None, "Finished", "", None) for t, ps in (("Q", (1, 2)), ("SQ", (3, 12))) for d, p in enumerate(ps)]
    df = spark.createDataFrame(rows, RES).withColumn("team_id", F.lit(5))
    assert SC.progression_items(df, ["event_id", "team_id"]).first()["points"] == 10
    assert SC.progression_items(df, ["event_id", "team_id"], shared_list=True).first()["points"] == -1


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_overtakes_do_not_depend_on_the_block(spark, block):
    r = random.Random(9)
    laps = [(1, d, n, None if r.random() < .1 else r.randint(1, 20), r.random() < .1, r.random() < .1) for d in range(3) for n in range(1, 30) if r.random() < .9]

    def plain(rows):
        tot = 0
        for (_, _, _, a, i1, o1), (_, _, _, b, i2, o2) in zip(rows, rows[1:]):
            if not (i1 or o1 or i2 or o2) and a is not None and b is not None and b < a:
                tot += a - b
        return tot

    df = spark.createDataFrame(laps, "event_id int, driver_id int, lap_number int, position int, is_pit_in boolean, is_pit_out boolean")
    got = {x["driver_id"]: x["overtakes"] for x in W.overtakes(df, block).collect()}
    assert got == {d: plain([x for x in laps if x[1] == d]) for d in range(3)}


def plain_chain(price, points):
    def change(avg, p):
        a = p >= Decimal("19.0")
        for lim, hi, lo in ((1.2, "0.3", "0.6"), (0.9, "0.1", "0.2"), (0.6, "-0.1", "-0.2")):
            if avg > lim:
                return Decimal(hi if a else lo)
        return Decimal("-0.3" if a else "-0.6")
    seen, out = [], []
    avg = lambda: sum(seen) / len(seen) if seen else 0.0
    for pts in points:
        out.append((price, change(avg(), price)))
        if pts is not None:
            seen = (seen + [pts / float(price)])[-3:]
        price = max(Decimal("3.0"), min(Decimal("34.0"), price + change(avg(), price)))
    return out


def test_price_chain_equals_a_plain_loop(spark):
    r = random.Random(5)
    pts = {k: [None if r.random() < .25 else r.randint(-20, 60) for _ in range(24)] for k in range(20)}
    start = {k: Decimal(r.randint(30, 340)) / 10 for k in pts}
    rounds = spark.createDataFrame([(k, n, n, p) for k in pts for n, p in enumerate(pts[k])], "k int, event_id bigint, round_no int, points int")
    s = spark.createDataFrame(list(start.items()), "k int, start_price decimal(5,1)")
    got = {}
    for x in PR.price_chain(s, rounds, ["k"]).orderBy("k", "event_id").collect():
        got.setdefault(x["k"], []).append((x["price"], x["price_change"]))
    assert got == {k: plain_chain(start[k], pts[k]) for k in pts}


def test_first_trajectory_step_ignores_the_prediction(spark):
    df = spark.range(1).select(F.lit(Decimal("10.0")).alias("p"), F.array().cast("array<double>").alias("seen"), F.array(F.lit(99.0)).alias("a"), F.array(F.lit(-99.0)).alias("b"))
    a, b = PR.trajectory(df, "p", "seen", "a").first()["path"], PR.trajectory(df, "p", "seen", "b").first()["path"]
    assert a == b == [Decimal("9.4")]


def test_metrics_by_hand(spark):
    rows = [(1, 1, 3., 1., 10., 6.), (1, 2, 2., 2., 5., 10.), (1, 3, 1., 3., 1., 2.)]
    # predicted order by points 1, 2, 3 with gains 6, 10, 2
    df = spark.createDataFrame(rows, "event_id int, driver_id int, predicted_position double, actual_position double, predicted_points double, actual_points double")
    m = E.bundle(df).first()
    dcg, ideal = 6 + 10 / math.log2(3) + 1, 10 + 6 / math.log2(3) + 1
    assert m["spearman"] == pytest.approx(-1.0) and m["ndcg10"] == pytest.approx(dcg / ideal)
    assert m["precision10"] == 0.0 and m["mae_position"] == pytest.approx(4 / 3)


def _easy(spark, events=12):
    r = random.Random(1)
    rows = []
    for e in range(events):
        skill = [r.random() for _ in range(20)]
        order = sorted(range(20), key=lambda d: -skill[d])
        rows += [(e, d, e, skill[d], r.random(), float(order.index(d) + 1), float(20 - order.index(d))) for d in range(20)]
    return spark.createDataFrame(rows, "event_id int, driver_id int, event_index int, a double, b double, y_position double, y_points double")


@pytest.mark.parametrize("version", ["v4", "race"])
def test_ranker_learns_an_easy_order(spark, version):
    df = _easy(spark).persist()
    m = M.make(version, ["a", "b"]).fit(df.where("event_index < 10"))
    p = m.predict(df.where("event_index >= 10"))
    assert p.select(F.corr("predicted_position", "y_position")).first()[0] > 0.99
    assert p.where("lower > upper").count() == 0 and m.importances()[0][0] == "a"


def test_tree_bounds_and_weights(spark):
    df = _easy(spark).persist()
    for spec in (M.TreeSpec(trees=5, depth=2), M.TreeSpec(trees=5, depth=2, bounds="quantile", half_life=10.0)):
        p = M.TreeModel(["a", "b"], spec).fit(df).predict(df)
        assert p.where("lower > upper").count() == 0
        assert p.select(F.corr("predicted_points", "y_points")).first()[0] > 0.8
    w = {r["event_index"]: r["w"] for r in M.weighted(df, 10.0).select("event_index", "w").distinct().collect()}
    assert w[11] == 1.0 and w[1] == pytest.approx(0.5)


def test_search_prefers_the_better_setting(spark):
    got = M.search(_easy(spark, 6), ["a", "b"], [M.TreeSpec(trees=1, depth=1), M.TreeSpec(trees=10, depth=3, step=0.3)], folds=2).orderBy("mae").first()
    assert got["depth"] == 3
