"""Events are numbered once, from the event table."""
import datetime as dt

from apexgrid.operators import picks as X
from apexgrid.plans import training as TR


def test_a_weekend_without_results_keeps_its_number(spark):
    day = dt.date(2026, 3, 1)
    events = spark.createDataFrame([(k, day + dt.timedelta(days=7 * k)) for k in range(5)], "event_id long, event_date date")
    feats = events.crossJoin(spark.createDataFrame([(1,), (2,)], "driver_id long")).withColumnRenamed("event_date", "event_date")
    race = feats.where("event_id <> 1").selectExpr("event_id", "driver_id", "CAST(driver_id AS int) AS position")
    totals = feats.selectExpr("event_id", "driver_id", "5 AS race_total")
    table = TR.race_training_set(feats, race, totals, events)
    assert {(r["event_id"], r["event_index"]) for r in table.collect()} == {(0, 0), (2, 2), (3, 3), (4, 4)}
    field = TR.numbered(feats, events)
    assert {(r["event_id"], r["event_index"]) for r in field.collect()} == {(k, k) for k in range(5)}
    # training rows strictly before weekend i never hold weekend i
    for i in range(5):
        assert not table.where(f"event_index < {i} AND event_id = {i}").count()


def test_transfers_over_budget_are_undone_to_an_affordable_prefix():
    pts = ({1: 1., 2: 2., 3: 30., 4: 20.}, {})
    price = ({1: 100, 2: 100, 3: 250, 4: 90}, {})
    # gains: 3 for 1 (+29), 4 for 2 (+18); both together cost 340, the first alone 350, none 200
    assert X.limit_transfers(([3, 4], []), ([1, 2], []), pts, price, 2, 10.0, 345) == ([[3, 4], []], 340)
    assert X.limit_transfers(([3, 4], []), ([1, 2], []), pts, price, 2, 10.0, 300) == ([[1, 2], []], 200)
    # nothing affordable: the cost says so
    assert X.limit_transfers(([3, 4], []), ([1, 2], []), pts, price, 2, 10.0, 150)[1] > 150
