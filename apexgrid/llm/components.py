"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


def connected(edges: DataFrame) -> DataFrame:
    """(id, comp): for every endpoint of ``edges(a, b)`` the smallest id of its component.

    Alternates star contractions: every vertex links its larger neighbours to its smallest neighbour, then its
    smaller ones. A hub's edges are only ever reduced by ``min`` before the shuffle and joined back, so no
    neighbourhood is gathered in a task. Rounds are about the logarithm of the longest path; each is written to
    the shared folder, which cuts the lineage. Only two sums of the edge table reach the driver per round.
    """
    e = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp") \
        .union(e.select("v", "v").distinct().toDF("id", "comp"))
