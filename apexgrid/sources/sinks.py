"""Parquet sinks.  A rerun of the same delivery leaves the same table.

Tables are partitioned by session, season, event or snapshot day.  A merge reads and
rewrites only the partitions that the delivery touches.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sinks_logic as L
from ..session import stage


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace exactly the partitions present in ``df``.

    Rows are range-partitioned by the partition column, so a partition with a third of
    the rows is written by several tasks.
    """
    df.repartitionByRange(by, *[c for c in df.columns if c != by][:1]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _touched(spark: SparkSession, path: str, new: DataFrame, by: str) -> DataFrame:
    """Stored rows of the partitions in ``new``; the semi join prunes partitions at run time."""
    if not exists(spark, path):
        return new.limit(0)
    types = {f.name: f.dataType for f in new.schema.fields}
    old = spark.read.parquet(path).select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    return old.join(new.select(by).distinct(), by, "left_semi")


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], by: str, order: str | None = None) -> dict[str, int]:
    """Update or create by ``key`` (which contains ``by``); counts of created, updated, kept rows."""
    assert by in key, "the partition column must be part of the key"
    if order:
        new = L.last_in_file(new, key, order).drop(order)
    new = stage(new, "delivery")
    merged = stage(L.merge(_touched(spark, path, new, by), new, key), "merged")  # a partition can not be overwritten while it is read
    done = {r["_action"]: r["n"] for r in merged.groupBy("_action").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows at most
    replace_partitions(merged.drop("_action"), path, by)
    return done


def insert_missing(spark: SparkSession, path: str, new: DataFrame, key: list[str], by: str) -> None:
    """Append only rows whose key is not stored yet."""
    fresh = new.dropDuplicates(key).join(_touched(spark, path, new, by).select(*key), key, "left_anti")
    stage(fresh, "fresh").write.mode("append").partitionBy(by).parquet(path)


def write_run(spark: SparkSession, root: str, run_id: int, races: DataFrame, **settings) -> str | None:
    """The files of one attempt of a run: a row per race, and a row with its aggregates. Nobody reads them before ``publish_run``; null for an empty run."""
    races = stage(races, "races")
    agg = races.agg(F.count(F.lit(1)).alias("races"), F.avg("mae_position").alias("mae_position"), F.avg("mae_points").alias("mae_points"),
                    F.sum("lineup_actual").alias("lineup_actual"), F.sum("optimal_actual").alias("optimal_actual"))
    if agg.first()["races"] == 0:
        return None
    attempt = f"run={run_id}-{uuid.uuid4().hex}"
    races.withColumn("run_id", F.lit(run_id).cast("long")).write.parquet(f"{root}/attempts/{attempt}/races")
    agg.withColumns({"run_id": F.lit(run_id).cast("long"), **{k: F.lit(x) for k, x in settings.items()}}).write.parquet(f"{root}/attempts/{attempt}/run")
    return attempt


def publish_run(spark: SparkSession, root: str, run_id: int, attempt: str) -> None:
    """One line of the manifest, written in one commit, makes an attempt the run's."""
    line = spark.range(1).select(F.lit(run_id).cast("long").alias("run_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("published_at"))
    line.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def append_run(spark: SparkSession, root: str, run_id: int, races: DataFrame, **settings) -> bool:
    """One run row with its aggregates and one row per race; nothing is written for an empty run.

    A crash on the way leaves the run as it was; doing a run again replaces it.
    """
    attempt = write_run(spark, root, run_id, races, **settings)
    if attempt is None:
        return False
    publish_run(spark, root, run_id, attempt)
    return True


def read_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(run rows, race rows) of the attempt of each run that was published last; the manifest has a line per attempt."""
    lines = spark.read.parquet(f"{root}/manifest").groupBy("run_id").agg(F.max(F.struct("published_at", "attempt")).alias("m"))
    attempts = sorted(r[0] for r in lines.select("m.attempt").collect())
    return tuple(spark.read.option("mergeSchema", "true").parquet(*[f"{root}/attempts/{a}/{part}" for a in attempts]) for part in ("run", "races"))
