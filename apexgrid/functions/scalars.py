"""Row-level functions: Column in, Column out (all inside whole-stage codegen)."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .. import params as P


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


# --- conversions -----------------------------------------------------------
def null_if_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def int_or_null(x: Column) -> Column:
    """Whole number of a text or number, null for bad text; ``'5.0'`` gives 5."""
    return x.try_cast("double").try_cast("bigint")


def text_or_null(x: Column) -> Column:
    t = F.trim(x.cast("string"))
    return F.when(~F.lower(t).isin("nan", "nat", "none", ""), t)


def money(x: Column) -> Column:
    """``'$30.4M'`` or ``'-$0.1M'`` or ``'$1,000M'`` to a decimal in millions."""
    return F.regexp_replace(F.trim(x), "[$M,]", "").try_cast("decimal(5,1)")


def strict_int(x: Column) -> Column:
    """Whole number written as plain digits, otherwise null."""
    return F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("bigint"))


def date_of_file(name: Column) -> Column:
    """Leading ``YYYY-MM-DD`` of a file name; a name without one is an error."""
    d = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(d == "", F.raise_error(F.concat(F.lit("no date in file name "), name)).cast("date")).otherwise(d.try_cast("date"))


def year_of_file(name: Column) -> Column:
    return F.year(date_of_file(name))


def interval_seconds(x: Column) -> Column:
    """Seconds of a day-time interval as a double; null stays null."""
    parts = [F.extract(F.lit(p), x).cast("double") * k
             for p, k in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))]
    return parts[0] + parts[1] + parts[2] + parts[3]


# --- status flags ----------------------------------------------------------
def classified(status: Column) -> Column:
    return (status == "Finished") | status.startswith("+")


def dnf_by_status(status: Column) -> Column:
    return ~classified(status)


def dnf_for_scoring(position: Column, status: Column) -> Column:
    return position.isNull() & ~classified(status)


def dsq(classified_position: Column) -> Column:
    return F.coalesce(F.upper(classified_position) == "D", F.lit(False))


# --- points ----------------------------------------------------------------
def points_for(position: Column, table: dict[int, int], default=0.0) -> Column:
    return F.coalesce(F.try_element_at(_map(table), position.cast("int")).cast("double"), F.lit(default))


def race_points(position: Column) -> Column:
    return points_for(position, P.RACE_POINTS)


def sprint_points(position: Column) -> Column:
    return points_for(position, P.SPRINT_POINTS)


def quali_points(position: Column) -> Column:
    return points_for(position, P.QUALI_POINTS)


def progression_points(q3: Column, q2: Column) -> Column:
    key = q3 * 100 + q2
    table = {a * 100 + b: v for (a, b), v in P.Q_PROGRESSION.items()}
    return F.coalesce(F.try_element_at(_map(table), key.cast("int")), F.lit(P.Q_PROGRESSION_OTHER))


# --- event context ---------------------------------------------------------
def corner_density(corners: Column, length: Column) -> Column:
    return F.coalesce(F.coalesce(corners, F.lit(0)) / F.nullif(length, F.lit(0.0)), F.lit(0.0))


def event_context(sprint_formats=("sprint",)) -> dict[str, Column]:
    c = F.col
    return {
        "circuit_length": F.coalesce(c("circuit_length"), F.lit(0.0)),
        "total_corners": F.coalesce(c("total_corners").cast("double"), F.lit(0.0)),
        "round_number": c("round_no").cast("double"),
        "is_sprint_weekend": c("event_format").isin(*sprint_formats).cast("double"),
    }


# --- price rules -----------------------------------------------------------
def band(avg_ppm: Column) -> Column:
    out = F.lit("terrible")
    for name, limit in reversed(P.BANDS):
        out = F.when(avg_ppm > limit, name).otherwise(out)
    return out


def price_change(avg_ppm: Column, price: Column) -> Column:
    tier_a = price >= F.lit(P.TIER_A_FROM)

    def pick(b):
        return F.when(tier_a, F.lit(P.PRICE_CHANGE[b, "A"])).otherwise(F.lit(P.PRICE_CHANGE[b, "B"])).cast("decimal(4,1)")

    out = pick("terrible")
    for name, limit in reversed(P.BANDS):
        out = F.when(avg_ppm > limit, pick(name)).otherwise(out)
    return out


def clamp_price(price: Column, low=P.PRICE_FLOOR, high=P.PRICE_CEILING) -> Column:
    return F.greatest(F.lit(low).cast("decimal(5,1)"), F.least(F.lit(high).cast("decimal(5,1)"), price)).cast("decimal(5,1)")


def next_price(avg_ppm: Column, price: Column) -> Column:
    return clamp_price((price + price_change(avg_ppm, price)).cast("decimal(5,1)"))


# --- other -----------------------------------------------------------------
def recency_weight(index: Column, latest: Column, half_life: float = P.DEFAULTS.half_life) -> Column:
    """Halves every ``half_life`` events; weight 1 where there is no index."""
    return F.coalesce(F.exp((latest - index) * F.lit(-0.6931471805599453 / half_life)), F.lit(1.0))


def completion_percent(done: Column, total: Column) -> Column:
    """Whole percent, ties to even, 0 for an empty total."""
    return F.coalesce(F.bround(F.lit(100.0) * done / F.nullif(total, F.lit(0)), 0), F.lit(0.0)).cast("bigint")


# The words and patterns of scoring texts and price cards.
def scoring_event_type(text: Column) -> Column:
    t = F.lower(text)
    return (F.when(t.contains("qualifying"), "qualifying").when(t.contains("sprint"), "sprint")
            .when(t.contains("weekend"), "weekend").otherwise("race"))


def ordinal_position(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^(\d+)[a-z]{2}$", 1).try_cast("bigint")


def plain_frequency(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^(\d+)$", 1).try_cast("bigint")


def first_signed_int(text: Column) -> Column:
    return F.regexp_extract(text, r"(-?\d+)", 1).try_cast("bigint")


def percent_in(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+\.\d+)%", 1).try_cast("double")


def points_in(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)\s*Pts", 1).try_cast("bigint")


def signed_change(amount: Column, falling: Column) -> Column:
    return F.when(falling, -F.abs(amount)).otherwise(F.abs(amount))
