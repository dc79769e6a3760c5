"""Keyed merge of new rows into a table, as frames; the writers are in ``sources.sinks``."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def last_in_file(new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of a key wins inside one delivery."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The merged table with what became of each row in ``_action``: created, updated or kept. New values replace old ones by key."""
    vals = [c for c in new.columns if c not in key]
    o = old.select(*key, F.struct(*vals).alias("_old"))
    n = new.select(*key, F.struct(*vals).alias("_new"))
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return o.join(n, key, "full").withColumn("_v", F.coalesce("_new", "_old")).select(*key, "_v.*", action.alias("_action"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged table, counts of created / updated / kept)."""
    rows = merge(old, new, key)
    return rows.drop("_action"), rows.groupBy(F.col("_action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows stay untouched; only unknown keys are added."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def replace_keys(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All old rows of the delivered keys are replaced by the delivered rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def upsert_with_rename(old: DataFrame, new: DataFrame) -> DataFrame:
    """Teams by canonical name, else by label (renamed in place, id kept), else created.

    ``old``: season_id, team_id, name, code; ``new``: season_id, name, label, code, fresh_id.
    An empty code never blanks an old one.
    """
    by_name = old.select("season_id", "name", F.col("team_id").alias("_n_id"), F.col("code").alias("_n_code"))
    by_label = old.select("season_id", F.col("name").alias("label"), F.col("team_id").alias("_l_id"), F.col("code").alias("_l_code"))
    j = new.join(by_name, ["season_id", "name"], "left").join(by_label, ["season_id", "label"], "left")
    hit = j.select("season_id", F.coalesce("_n_id", "_l_id", "fresh_id").alias("team_id"), "name",
                   F.coalesce(F.nullif(F.col("code"), F.lit("")), "_n_code", "_l_code", F.lit("")).alias("code"),
                   F.when(F.col("_n_id").isNotNull(), "updated").when(F.col("_l_id").isNotNull(), "renamed").otherwise("created").alias("action"))
    rest = old.join(hit.select("team_id"), "team_id", "left_anti").withColumn("action", F.lit("kept"))
    return hit.unionByName(rest.select(*hit.columns))
