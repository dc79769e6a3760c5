"""Position and points models on pyspark.ml.

Regressors: two boosted-tree models with bounds from training residuals.
Rankers: a pairwise logistic model of the order inside an event (``pairwise``).
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S
from ..functions.quantiles import weighted_quantiles
from ..params import DEFAULTS
from . import forest as FO, pairwise as PW

BUCKETS = 10


@dataclass
class TreeSpec:
    trees: int = 100
    depth: int = 4
    step: float = 0.1
    subsample: float = 1.0
    bounds: str = "std"           # "std" or "quantile"
    half_life: float | None = None
    seed: int = 7
    min_rows: int = 1             # rows that a leaf needs
    columns: float = 1.0          # share of the columns that a split may use

    def regressor(self, label: str, weight: str | None = None) -> GBTRegressor:
        out = GBTRegressor(featuresCol="x", labelCol=label, predictionCol="_p", maxIter=self.trees, maxDepth=self.depth, stepSize=self.step,
                           subsamplingRate=self.subsample, minInstancesPerNode=self.min_rows, featureSubsetStrategy=str(self.columns) if self.columns < 1 else "all", seed=self.seed)
        return out.setWeightCol(weight) if weight else out


SPECS = {
    "v1": TreeSpec(),
    "v2": TreeSpec(trees=50, depth=2, subsample=0.7, bounds="quantile", min_rows=3, columns=0.7),
    "v3": TreeSpec(trees=50, depth=2, subsample=0.7, bounds="quantile", min_rows=3, columns=0.7, half_life=DEFAULTS.half_life),
}


def weighted(train: DataFrame, half_life: float | None) -> DataFrame:
    """Column ``w``: halves every ``half_life`` events back from the newest training event."""
    if half_life is None:
        return train.withColumn("w", F.lit(1.0))
    latest = train.agg(F.max("event_index")).scalar()
    return train.withColumn("w", S.recency_weight(F.col("event_index"), latest, half_life))


def _bucket(cuts: list[float], p):
    """Prediction bucket: how many cuts lie below."""
    return sum((F.when(p > c, 1).otherwise(0) for c in cuts), F.lit(0))


def residual_bounds(res: DataFrame) -> tuple[list[float], list[dict]]:
    """Deciles of the predictions ``_p`` and, per bucket between them, residual quantiles of ``r``; both exact, weighted by ``w``."""
    res = res.select("_p", "r", "w")
    cut = weighted_quantiles(res.withColumn("k", F.lit(0)), ["k"], "_p", "w", tuple(i / BUCKETS for i in range(1, BUCKETS)), "cuts").first()
    cuts = list(cut["cuts"]) if cut else []
    per = weighted_quantiles(res.withColumn("b", _bucket(cuts, F.col("_p"))), ["b"], "r", "w", (0.1, 0.9), "q")
    return cuts, [{"b": r["b"], "lo": r["q"][0], "hi": r["q"][1]} for r in per.collect()]  # at most BUCKETS rows


def bounded(p, cuts: list[float], table: list[dict]) -> dict:
    """Columns ``lower`` and ``upper`` around a prediction, by its bucket."""
    if not table:
        return {"lower": p, "upper": p}
    known = F.create_map(*[x for t in table for x in (F.lit(t["b"]), F.struct(F.lit(t["lo"]).alias("lo"), F.lit(t["hi"]).alias("hi")))])
    hit = F.try_element_at(known, _bucket(cuts, p))
    lo, hi = p + F.coalesce(hit["lo"], F.lit(0.0)), p + F.coalesce(hit["hi"], F.lit(0.0))
    return {"lower": F.least(lo, hi), "upper": F.greatest(lo, hi)}


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="x").transform(df)


@dataclass
class TreeModel:
    """Fitted position and points trees with point bounds."""

    cols: list[str]
    spec: TreeSpec
    position: object = None
    points: object = None
    sd: float = 0.0
    cuts: list[float] = field(default_factory=list)
    table: list[dict] = field(default_factory=list)

    def fit(self, train: DataFrame) -> "TreeModel":
        s = self.spec
        data = _assembled(weighted(train, s.half_life), self.cols).select("x", "w", "y_position", "y_points").persist()
        gbt = lambda label: s.regressor(label, "w").fit(data)
        with ThreadPoolExecutor(2) as pool:  # two independent fits
            self.position, self.points = pool.map(gbt, ("y_position", "y_points"))
        res = self.points.transform(data).select("w", "_p", (F.col("y_points") - F.col("_p")).alias("r"))
        if s.bounds == "std":
            self.sd = float(res.agg(F.stddev_pop("r")).first()[0] or 0.0)
        else:
            self.cuts, self.table = residual_bounds(res)
        data.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = _assembled(df, self.cols)
        out = self.position.transform(out).withColumnRenamed("_p", "predicted_position")
        out = self.points.transform(out).withColumnRenamed("_p", "predicted_points").drop("x")
        p = F.col("predicted_points")
        if self.spec.bounds == "std":
            return out.withColumns({"lower": p - F.lit(self.sd), "upper": p + F.lit(self.sd)})
        return out.withColumns(bounded(p, self.cuts, self.table))

    def importances(self) -> list[tuple[str, float]]:
        v = self.points.featureImportances.toArray()
        return sorted(zip(self.cols, map(float, v)), key=lambda t: -t[1])


@dataclass
class Ranker:
    """Pairwise logistic ranker with calibrated points and bounds of its own: one split of ``pairwise``."""

    cols: list[str]
    half_life: float | None = DEFAULTS.half_life
    ridge: float = PW.RIDGE
    model: DataFrame | None = None

    def fit(self, train: DataFrame) -> "Ranker":
        top = train.agg(F.max("event_index")).first()[0]
        self.model = PW.fit_splits(train, self.cols, [(-1 if top is None else int(top)) + 1], self.half_life, self.ridge)
        return self

    @property
    def weights(self) -> list[float]:
        return list(self._fitted().first()["weights"])  # one row

    def _fitted(self) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit before predict")
        return self.model

    def predict(self, df: DataFrame) -> DataFrame:
        return PW.ranked(df.crossJoin(self._fitted().drop("split")), self.cols)  # the model is one row

    def importances(self) -> list[tuple[str, float]]:
        row = self._fitted().first()
        return sorted(((c, abs(w * s)) for c, w, s in zip(self.cols, row["weights"], row["spread"])), key=lambda t: -t[1])


def make(version: str, cols: list[str]):
    """Model by name: regressors v1-v3, rankers v4 (recency), qualifying and race (no recency)."""
    if version in SPECS:
        return TreeModel(cols, SPECS[version])
    return Ranker(cols, DEFAULTS.half_life if version == "v4" else None)


# The search grid of the regressors. Ridge weights of leaves have no counterpart in MLlib.
GRID = {"trees": (20, 50, 100), "depth": (2, 3, 4), "step": (0.05, 0.1, 0.2), "min_rows": (3, 5, 10), "subsample": (0.7, 0.8), "columns": (0.7, 0.8)}
#: Settings that a full search draws.
SEARCH_DRAWS = 50


def draw_specs(n: int = SEARCH_DRAWS, grid: dict = GRID, seed: int = 42) -> list[TreeSpec]:
    """``n`` distinct settings of the grid."""
    import itertools
    import random
    combos = list(itertools.product(*grid.values()))
    return [TreeSpec(**dict(zip(grid, c))) for c in random.Random(seed).sample(combos, min(n, len(combos)))]


def search(train: DataFrame, cols: list[str], specs: list[TreeSpec], folds: int = 4) -> DataFrame:
    """Mean absolute position error per setting over expanding folds of whole events, and what it gains on the first setting.

    All (setting, fold) models grow side by side (``forest``).
    """
    last = train.agg(F.max("event_index")).first()[0]
    cuts = [round(((-1 if last is None else last) + 1) * (i + 1) / (folds + 1)) for i in range(folds + 1)]
    keys = [(i, f) for i in range(len(specs)) for f in range(folds)]
    models = [FO.Grown(s.trees, s.depth, s.step, s.min_rows, s.subsample, s.columns, cuts[f], cuts[f + 1]) for i, f in keys for s in [specs[i]]]
    maes = FO.fold_errors(train, cols, "y_position", models)
    rows = [(i, s.trees, s.depth, s.step, s.min_rows, s.subsample, s.columns, f, mae) for (i, f), mae in zip(keys, maes) for s in [specs[i]]]
    out = train.sparkSession.createDataFrame(rows, "spec_id int, trees int, depth int, step double, min_rows int, subsample double, columns double, fold int, mae double")
    mean = out.groupBy("spec_id", "trees", "depth", "step", "min_rows", "subsample", "columns").agg(F.avg("mae").alias("mae"))
    first = mean.where("spec_id = 0").agg(F.max("mae").alias("first"))
    return mean.join(first, F.lit(True)).withColumn("gain", F.col("first") - F.col("mae")).drop("first")
