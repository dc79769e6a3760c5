"""Prediction quality per event, for all events and configurations in one job."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEY = ["event_id"]


def pairs(pred: DataFrame, actual: DataFrame, also: list[str] = []) -> DataFrame:
    """Every driver with an actual position and points, with the prediction where there is one; ``also`` names further keys of both."""
    a = actual.where(F.col("position").isNotNull() & F.col("actual_points").isNotNull()).select(
        *also, "event_id", "driver_id", F.col("position").cast("double").alias("actual_position"), F.col("actual_points").cast("double").alias("actual_points"))
    return a.join(pred, [*also, "event_id", "driver_id"], "left")


def mae(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    return df.where(F.col("predicted_position").isNotNull()).groupBy(*key).agg(
        F.avg(F.abs(F.col("predicted_position") - F.col("actual_position"))).alias("mae_position"),
        F.avg(F.abs(F.col("predicted_points") - F.col("actual_points"))).alias("mae_points"))


def rank_metrics(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Spearman rho, precision and recall of the top ten scorers, NDCG@10: one shuffle by event."""
    df = df.withColumn("_m", F.col("predicted_position").isNotNull())
    alone, all_ = Window.partitionBy(*key, "_m"), Window.partitionBy(*key)
    rk = lambda w, c: F.row_number().over(w.orderBy(c, F.col("driver_id")))
    df = df.withColumns({
        "pr": rk(alone, F.col("predicted_position").asc()), "ar": rk(alone, F.col("actual_position").asc()),
        "pp": rk(alone, F.col("predicted_points").desc()), "ap": rk(alone, F.col("actual_points").desc()),
        "top": rk(all_, F.col("actual_points").desc())})
    m = F.col("_m")
    n, n_all = F.count_if(m), F.count(F.lit(1))
    gain = lambda r: F.sum(F.when(m & (r <= 10), F.col("actual_points") / F.log2(r + F.lit(1.0))))
    dcg, ideal = gain(F.col("pp")), gain(F.col("ap"))
    overlap = F.count_if(m & (F.col("pp") <= 10) & (F.col("top") <= 10)) / 10.0
    rho = F.corr(F.when(m, F.col("pr").cast("double")), F.when(m, F.col("ar").cast("double")))
    enough = (n >= 10) & (n_all >= 10)
    return df.groupBy(*key).agg(
        F.when(n < 2, 0.0).otherwise(F.coalesce(F.nanvl(rho, F.lit(0.0)), F.lit(0.0))).alias("spearman"),
        F.when(enough, overlap).otherwise(0.0).alias("precision10"), F.when(enough, overlap).otherwise(0.0).alias("recall10"),
        F.when((n < 2) | (ideal == 0), 0.0).otherwise(dcg / F.nullif(ideal, F.lit(0.0))).alias("ndcg10"))


def bundle(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """All metrics in one row; events without matched drivers have zero errors."""
    return rank_metrics(df, key).join(mae(df, key), key, "left").fillna(0.0, ["mae_position", "mae_points"])
