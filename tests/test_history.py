"""Point-in-time rules: windowed form = definition form, no leakage, null handling."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from apexgrid.functions.quantiles import exact_median
from apexgrid.operators import history as H
from apexgrid.plans import features as FS


def _random_frames(spark, seed):
    r = random.Random(seed)
    days = sorted(r.sample(range(9000, 9400), 30))
    spine = [(k, i, d) for k in range(8) for i, d in enumerate(days)]
    facts = [(k, d, None if r.random() < .2 else r.randint(1, 20)) for k in range(8) for d in days if r.random() < .7]
    return spark.createDataFrame(spine, "code int, event_id int, day int"), spark.createDataFrame(facts, "code int, day int, position int")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 3, 10])
def test_windowed_form_equals_definition(spark, seed, n):
    spine, facts = _random_frames(spark, seed)
    got = H.last_n(H.stack(spine, fact=facts), ["code"], "fact", n, "h").where("is_spine")
    got = got.select("code", "event_id", F.explode("h").alias("f")).select("code", "event_id", F.col("f.day").alias("fd"), "f.position")
    want = H.history_pairs(spine, facts, ["code"], n).select("code", "event_id", F.col("fact_day").alias("fd"), "position")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_same_day_and_future_rows_do_not_leak(spark):
    spine = spark.createDataFrame([(1, 7, 100)], "code int, event_id int, day int")
    facts = spark.createDataFrame([(1, 99, 4), (1, 100, 1), (1, 101, 2)], "code int, day int, position int")
    got = H.last_n(H.stack(spine, fact=facts), ["code"], "fact", 5, "h").where("is_spine").first()["h"]
    assert [f["position"] for f in got] == [4]


def test_asof_latest_is_inclusive(spark):
    left = spark.createDataFrame([(1, 10), (1, 12), (2, 10)], "k int, day int")
    right = spark.createDataFrame([(1, 10, "a"), (1, 11, "b")], "k int, day int, v string")
    got = {(r["k"], r["day"]): r["v"] for r in H.asof_latest(left, right, ["k"], ["v"]).collect()}
    assert got == {(1, 10): "a", (1, 12): "b", (2, 10): None}


def test_asof_nearest_looks_forward_then_back(spark):
    left = spark.createDataFrame([(5,), (10,), (30,)], "day int")
    right = spark.createDataFrame([(10, "x"), (20, "y")], "day int, v string")
    got = {r["day"]: r["v"] for r in H.asof_nearest(left, right, ["v"]).collect()}
    assert got == {5: "x", 10: "x", 30: "y"}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 999, 1000, 1001, 20000])
def test_exact_median_of_any_group_size(spark, size):
    import random
    import statistics
    rng = random.Random(size)
    groups = {1: [rng.choice([1.5, 2.5, 2.5, 1e9, rng.random()]) for _ in range(size)], 2: [float(k) for k in range(size)], 3: [7.0] * size}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(4, None), (1, None)]
    rng.shuffle(rows)
    got = {x["k"]: x["m"] for x in exact_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", "m").collect()}
    assert got == {k: statistics.median(vs) for k, vs in groups.items()}


def test_feature_columns_counts():
    assert [len(FS.SETS[s]) for s in ("v1", "v2", "v3", "v4", "race", "qualifying")] == [15, 25, 26, 43, 44, 43]
    assert "driver_vs_teammate_championship_gap" in FS.V3


def test_features_ignore_the_target_and_later_events(spark, views):
    """Dropping every result, price total and sample after a cut changes no feature up to the cut."""
    t = FS.Tables.of(views)
    cut = dt.date(1998, 4, 1)
    keep = F.col("event_date") < F.lit(cut)
    # laps of the target are allowed (practice is over when line-ups lock), results of that day are not
    cutoff = FS.Tables(t.spine, t.race.where(keep), t.quali.where(keep), t.laps, t.weather.where(F.col("event_date") <= F.lit(cut)),
                       t.price.where(F.col("event_date") <= F.lit(cut)), t.total.where(keep), t.session, t.stints)
    pick = lambda x: x.where(F.col("event_date") <= F.lit(cut)).drop("event_date")
    a, b = pick(FS.features(t, "v4")), pick(FS.features(cutoff, "v4"))
    order = ["event_id", "driver_id"]
    assert a.orderBy(order).collect() == b.orderBy(order).collect()
    assert a.groupBy(order).count().where("count > 1").count() == 0
