"""Price paths.  A price depends on the clamped price before it, so a path is a fold over
the rounds of one season: a short array per entity, all entities at once, no UDF."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import params as P
from ..functions import lists as L, scalars as S
from . import history as H

_RATIOS = "array<double>"


def average_ppm(ratios: Column) -> Column:
    return L.mean(ratios, 0.0)


def _push(ratios: Column, points: Column, price: Column) -> Column:
    """Window of the last three points-per-million values; unchanged when nothing was scored."""
    grown = F.concat(ratios, F.array(points.cast("double") / price.cast("double")))
    return F.when(points.isNull(), ratios).otherwise(F.slice(grown, F.greatest(F.size(grown) - 2, F.lit(1)), F.lit(3)))


def price_chain(start: DataFrame, rounds: DataFrame, key: list[str]) -> DataFrame:
    """Price and change of every entity at every event of its season.

    ``rounds`` has one row per (key, event) with ``round_no`` and nullable ``points``;
    ``start`` has the ``start_price`` per key.  A season's rounds bound the array.
    """
    path = rounds.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("round_no", "event_id", F.col("points").cast("double").alias("points")))).alias("_r"))
    state = F.struct(F.col("start_price").cast("decimal(5,1)").alias("price"), F.array().cast(_RATIOS).alias("seen"),
                     F.array().cast("array<struct<event_id:bigint,price:decimal(5,1),price_change:decimal(4,1)>>").alias("out"))

    def step(s, r):
        change = S.price_change(average_ppm(s["seen"]), s["price"])
        row = F.struct(r["event_id"].alias("event_id"), s["price"].alias("price"), change.alias("price_change"))
        seen = _push(s["seen"], r["points"], s["price"])
        return F.struct(S.next_price(average_ppm(seen), s["price"]).alias("price"), seen.alias("seen"), F.concat(s["out"], F.array(row)).alias("out"))

    done = path.join(start, key).withColumn("_s", F.aggregate("_r", state, step))
    return done.select(*key, F.explode("_s.out").alias("_o")).select(*key, "_o.*")


def starting_prices(entities: DataFrame, listed: DataFrame, carried: DataFrame, key: str, default) -> DataFrame:
    """Listed price, else last season's final price, else the default; with its source."""
    j = entities.join(listed.select(key, F.col("price").alias("_l")), key, "left").join(carried.select(key, F.col("price").alias("_c")), key, "left")
    return j.select(key, F.coalesce("_l", "_c", F.lit(default)).cast("decimal(5,1)").alias("start_price"),
                    F.when(F.col("_l").isNotNull(), "listed").when(F.col("_c").isNotNull(), "carried").otherwise("default").alias("source"))


def unknown_codes(listed: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Listed prices of nobody in the entry list: their sorted keys are reported, their prices not used."""
    return listed.join(entities.select(key), key, "left_anti").select(key).distinct()


def carry_over(prices: DataFrame, entity: str, season: str = "season_year") -> DataFrame:
    """Price at the last round of each season, clamped, as the next season's start."""
    last = prices.groupBy(entity, season).agg(F.max_by("price", "round_no").alias("price"), F.max("round_no").alias("_r"))
    final = prices.groupBy(season).agg(F.max("round_no").alias("_r"))
    return last.join(final, [season, "_r"]).select(entity, (F.col(season) + 1).alias(season), S.clamp_price(F.col("price"), P.CARRY_FLOOR, P.CARRY_CEILING).alias("price"))


def trajectory(df: DataFrame, price: str, seen: str, points: str, out: str = "path") -> DataFrame:
    """Prices after each predicted race; the first step sees only the window so far."""
    state = F.struct(F.col(price).cast("decimal(5,1)").alias("price"), F.col(seen).alias("seen"), F.array().cast("array<decimal(5,1)>").alias("out"))

    def step(s, pts):
        nxt = S.next_price(average_ppm(s["seen"]), s["price"])
        return F.struct(nxt.alias("price"), _push(s["seen"], pts, s["price"]).alias("seen"), F.concat(s["out"], F.array(nxt)).alias("out"))

    return df.withColumn(out, F.aggregate(F.col(points), state, step)["out"])


def rolling_state(spine: DataFrame, scored: DataFrame, n: int = 3) -> DataFrame:
    """Last ``n`` points-per-million values of each season driver strictly before each event."""
    key = ["driver_id"]
    left = spine.select("driver_id", "event_id", H.day(F.col("event_date")).alias("day"))
    facts = scored.select("driver_id", H.day(F.col("event_date")).alias("day"), (F.col("race_total") / F.col("price").cast("double")).alias("ratio"))
    both = H.last_n(H.stack(left, fact=facts), key, "fact", n, "_f").where("is_spine")
    return both.select("event_id", "driver_id", F.transform("_f", lambda f: f["ratio"]).alias("seen"))


def adjust_for_price(pred: DataFrame, prices: DataFrame, state: DataFrame, sensitivity: float | Column = 1.0) -> DataFrame:
    """Add the expected next price move times ``sensitivity``; drivers without a price keep their points."""
    keys = ["event_id", "driver_id"]
    j = (pred.join(prices.select(*keys, F.col("price").alias("_p")), keys, "left").join(state, keys, "left")
         .withColumn("_seen", F.coalesce("seen", F.array().cast(_RATIOS))))
    move = (S.next_price(average_ppm(F.col("_seen")), F.col("_p")) - F.col("_p")).cast("double")
    s = sensitivity if isinstance(sensitivity, Column) else F.lit(sensitivity)
    return j.withColumn("predicted_points", F.col("predicted_points") + F.coalesce(move, F.lit(0.0)) * s).drop("_p", "_seen", "seen")
