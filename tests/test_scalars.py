from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from apexgrid.functions import lists as L, scalars as S


def one(spark, col, **vals):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in vals.items()]) if vals else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("$30.4M", "30.4"), ("-$0.1M", "-0.1"), ("$1,000M", "1000.0"), (" $5M ", "5.0"), ("bad", None)])
def test_money(spark, text, want):
    assert one(spark, S.money(F.col("t")), t=text) == (None if want is None else Decimal(want))


@pytest.mark.parametrize("ppm,name", [(1.21, "great"), (1.2, "good"), (0.91, "good"), (0.9, "poor"), (0.61, "poor"), (0.6, "terrible"), (0.0, "terrible")])
def test_band_boundaries_fall_down(spark, ppm, name):
    assert one(spark, S.band(F.col("p")), p=ppm) == name


@pytest.mark.parametrize("ppm,price,change", [(1.3, "19.0", "0.3"), (1.3, "18.9", "0.6"), (1.0, "25.0", "0.1"), (1.0, "10.0", "0.2"),
                                              (0.7, "19.0", "-0.1"), (0.7, "5.0", "-0.2"), (0.1, "19.0", "-0.3"), (0.1, "18.9", "-0.6")])
def test_price_change_by_tier(spark, ppm, price, change):
    assert one(spark, S.price_change(F.col("p"), F.col("x")), p=ppm, x=Decimal(price)) == Decimal(change)


@pytest.mark.parametrize("ppm,price,want", [(0.0, "3.2", "3.0"), (0.0, "3.0", "3.0"), (2.0, "33.9", "34.0"), (1.0, "10.0", "10.2")])
def test_next_price_is_clamped(spark, ppm, price, want):
    assert one(spark, S.next_price(F.col("p"), F.col("x")), p=ppm, x=Decimal(price)) == Decimal(want)


@pytest.mark.parametrize("q3,q2,pts", [(2, 0, 10), (1, 1, 5), (1, 0, 5), (0, 2, 3), (0, 1, 1), (0, 0, -1), (4, 0, -1)])
def test_progression_table(spark, q3, q2, pts):
    assert one(spark, S.progression_points(F.col("a"), F.col("b")), a=q3, b=q2) == pts


@pytest.mark.parametrize("pos,race,sprint,quali", [(1, 25, 8, 10), (2, 18, 7, 9), (8, 4, 1, 3), (10, 1, 0, 1), (11, 0, 0, 0)])
def test_points(spark, pos, race, sprint, quali):
    assert one(spark, S.race_points(F.col("p")), p=pos) == race
    assert one(spark, S.sprint_points(F.col("p")), p=pos) == sprint
    assert one(spark, S.quali_points(F.col("p")), p=pos) == quali


def test_dnf_notions_disagree(spark):
    assert one(spark, S.dnf_by_status(F.col("s")), s="Engine") is True
    assert one(spark, S.dnf_by_status(F.col("s")), s="+1 Lap") is False
    assert one(spark, S.dnf_for_scoring(F.col("p"), F.col("s")), p=4, s="Engine") is False


def test_file_dates(spark):
    assert str(one(spark, S.date_of_file(F.col("f")), f="2026-03-27-drivers.csv")) == "2026-03-27"
    with pytest.raises(Exception, match="no date in file name"):
        one(spark, S.date_of_file(F.col("f")), f="drivers.csv")


def test_interval_seconds(spark):
    assert one(spark, S.interval_seconds(F.expr("INTERVAL '1 02:03:04.5' DAY TO SECOND"))) == 93784.5


def test_scoring_text(spark):
    assert one(spark, S.scoring_event_type(F.col("t")), t="QF Not Classified") == "race"
    assert one(spark, S.ordinal_position(F.col("t")), t="2nd") == 2
    assert one(spark, S.plain_frequency(F.col("t")), t="-") is None
    assert one(spark, S.first_signed_int(F.col("t")), t="(-3 pts)") == -3
    assert one(spark, S.percent_in(F.col("t")), t="25.5% picked") == 25.5


def test_completion_rounds_half_to_even(spark):
    assert one(spark, S.completion_percent(F.col("a"), F.col("b")), a=1, b=8) == 12
    assert one(spark, S.completion_percent(F.col("a"), F.col("b")), a=3, b=8) == 38
    assert one(spark, S.completion_percent(F.col("a"), F.col("b")), a=0, b=0) == 0


def test_list_helpers(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")
    assert one(spark, L.slope(arr(1, 3, 5))) == 2.0
    assert one(spark, L.slope(arr(7))) == 0.0
    assert one(spark, L.mean(arr(), 10.0)) == 10.0
    assert abs(one(spark, L.sample_std(arr(2, 4, 6))) - 2.0) < 1e-12
    assert one(spark, L.sample_std(arr(2))) == 0.0
