"""Counter-based random draws: a number is a hash of what it is for, so it does not depend on order, partitions or the engine.

The same numbers come from columns and, inside a solver, from numpy.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Multiplier of the hash: products of 32 bits with it stay within 64. Kinds of entities.
FACTOR, WORD = 73_244_475, 1 << 32
DRIVER, TEAM = 0, 1


def _hash(x):
    for _ in range(2):
        x = ((x >> 16) ^ x) * FACTOR & (WORD - 1)
    return (x >> 16) ^ x


def uniforms(event: int, kind: int, ids: np.ndarray, n: int) -> np.ndarray:
    """Draws in (0, 1) of ``n`` scenarios by entities."""
    entity = (2 * np.asarray(ids, np.int64) + kind) % WORD
    first = _hash(_hash(np.int64(int(event) % WORD)) ^ entity)
    return (_hash(_hash(first[None, :] ^ np.arange(n, dtype=np.int64)[:, None])) + 0.5) / WORD


def _hash_column(x: Column) -> Column:
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(FACTOR)).bitwiseAND(F.lit(WORD - 1))
    return F.shiftright(x, 16).bitwiseXOR(x)


def uniform(event: Column, kind: int, entity: Column, scenario: Column) -> Column:
    """The draw of one scenario as a column."""
    word = lambda c: F.pmod(c.cast("bigint"), F.lit(WORD))
    first = _hash_column(_hash_column(word(event)).bitwiseXOR(word(2 * entity.cast("bigint") + kind)))
    return (_hash_column(_hash_column(first.bitwiseXOR(scenario.cast("bigint")))) + 0.5) / F.lit(float(WORD))


def triangular(u, lower, mode, upper):
    """Inverse distribution of the triangle (lower, mode, upper), for arrays; without spread the lower value."""
    mode = np.clip(mode, lower, upper)
    width = upper - lower
    safe = np.where(width > 0, width, 1.0)
    left = lower + np.sqrt(u * safe * (mode - lower))
    right = upper - np.sqrt((1 - u) * safe * (upper - mode))
    return np.where(width > 0, np.where(u < (mode - lower) / safe, left, right), lower)


def triangular_column(u: Column, lower: Column, mode: Column, upper: Column) -> Column:
    mode = F.least(F.greatest(mode, lower), upper)
    width = upper - lower
    left, right = lower + F.sqrt(u * width * (mode - lower)), upper - F.sqrt((1 - u) * width * (upper - mode))
    return F.when(width > 0, F.when(u < (mode - lower) / width, left).otherwise(right)).otherwise(lower)


def scenario_values(pred: DataFrame, n: int, entity: str = "driver_id", kind: int = DRIVER) -> DataFrame:
    """(event_id, entity, scenario, value) of every prediction with bounds in ``n`` scenarios."""
    rows = pred.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = uniform(F.col("event_id"), kind, F.col(entity), F.col("scenario"))
    # a column of its own, so that the optimizer does not repeat the hash
    return rows.withColumn("u", u).select("event_id", entity, "scenario", triangular_column(F.col("u"), F.col("lower"), F.col("predicted_points"), F.col("upper")).alias("value"))
