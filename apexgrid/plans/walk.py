"""Walk-forward rankers: every weekend is predicted by the ranker of all weekends before it.

All splits are fitted together by ``pairwise``, the implementation that a single fit uses too, so a split of a run and a fit on the same
events give the same model.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..params import DEFAULTS, Params
from ..session import stage
from . import pairwise as PW


def rank_forward(table: DataFrame, field: DataFrame, cols: list[str], half_life: float | None = DEFAULTS.half_life, p: Params = DEFAULTS, ridge: float = PW.RIDGE) -> DataFrame:
    """Predictions of every weekend from ``min_train`` on; ``table`` is a training set, ``field`` all cars with features."""
    first, last = max(1, p.min_train), table.agg(F.max("event_index")).first()[0]
    if last is None:
        return PW.ranked(field.limit(0).join(table.sparkSession.createDataFrame([], PW.MODEL + ", quantiles map<int,array<double>>, cuts array<double>"), F.lit(True)), cols)
    models = PW.fit_splits(table, cols, list(range(first, int(last) + 2)), half_life, ridge)
    return PW.ranked(field.join(models, field["event_index"] == models["split"]).drop("split"), cols)


def model_weights(table: DataFrame, cols: list[str], half_life: float | None = DEFAULTS.half_life, p: Params = DEFAULTS, ridge: float = PW.RIDGE) -> DataFrame:
    """(event_index, feature, weight) of every split's ranker."""
    last = table.agg(F.max("event_index")).first()[0]
    models = stage(PW.fit_splits(table, cols, list(range(max(1, p.min_train), int(last) + 2)), half_life, ridge).select("split", "weights"), "split-weights")
    named = F.arrays_zip(F.array(*map(F.lit, cols)).alias("feature"), F.col("weights").alias("weight"))
    return models.select(F.col("split").alias("event_index"), F.explode(named).alias("f")).select("event_index", "f.feature", "f.weight")
