"""Tables to landed files, partition-wise: what an export delivers, the scans of ``files`` read back.

An export is a folder named like the file it stands for (``file=2026-03-27-drivers.csv``) with parts that each have the header.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def money(c: str) -> Column:
    """``23.8`` as ``$23.8M``, ``-0.3`` as ``-$0.3M``; null stays null."""
    x = F.col(c).cast("decimal(10,1)")
    return F.concat(F.when(x < 0, "-$").otherwise("$"), F.abs(x).cast("string"), F.lit("M"))


def write_files(rows: DataFrame, root: str, file: Column, layout: list[tuple[str, Column]]) -> None:
    """One export per value of ``file``; ``layout`` names the header columns in their order. Several tasks may write one export."""
    rows.select(file.alias("file"), *[c.cast("string").alias(name) for name, c in layout]).write.mode("append").partitionBy("file").option("header", True).option("escape", '"').csv(root)


def write_price_files(prices: DataFrame, root: str, kind: str, layout: list[str]) -> None:
    """``prices(snapshot_date, name, team, price, price_change, pick_percentage, season_points)`` with the header columns that ``layout`` names."""
    who, suffix = ("Driver Name", "drivers") if kind == "driver_price" else ("Constructor Name", "constructors")
    columns = {"% Picked": F.col("pick_percentage"), "Current Value": money("price"), who: F.col("name"), "Price Change": money("price_change"),
               "Season Points": F.col("season_points"), "Team": F.col("team")}
    write_files(prices, root, F.concat(F.col("snapshot_date").cast("date").cast("string"), F.lit(f"-{suffix}.csv")), [(c, columns[c]) for c in layout if c in columns])


def write_score_files(scores: DataFrame, root: str, kind: str, layout: list[str]) -> None:
    """``scores(delivered, name, team, race, event_type, scoring_item, frequency, position, points, race_total, season_total)``."""
    who, suffix = ("Driver Name", "all-drivers") if kind == "driver_score" else ("Constructor Name", "all-constructors")
    columns = {who: F.col("name"), "Team": F.col("team"), "Race": F.col("race"), "Event Type": F.col("event_type"), "Scoring Item": F.col("scoring_item"), "Frequency": F.col("frequency"),
               "Position": F.col("position"), "Points": F.col("points"), "Race Total": F.col("race_total"), "Season Total": F.col("season_total")}
    write_files(scores, root, F.concat(F.col("delivered").cast("date").cast("string"), F.lit(f"-{suffix}-performance.csv")), [(c, columns[c]) for c in layout if c in columns])


def write_starting_prices(prices: DataFrame, path: str) -> None:
    """``prices(key, price)`` as ``key,price`` lines without a header, each part under a comment."""
    lines = prices.select(F.concat_ws(",", "key", F.col("price").cast("string")).alias("value"), F.lit(1).alias("n"))
    note = prices.sparkSession.createDataFrame([("# starting prices", 0), ("", 0)], "value string, n int")
    note.union(lines).select("value").write.text(path)


def write_rosters(teams: DataFrame, drivers: DataFrame, path: str) -> None:
    """One document per season of ``teams(season, name, code)`` and ``drivers(season, code, full_name, driver_number, team)``; entry lists are short."""
    t = teams.groupBy("season").agg(F.array_sort(F.collect_list(F.struct("name", F.col("name").alias("fastf1_name"), "code"))).alias("teams"))
    d = drivers.groupBy("season").agg(F.array_sort(F.collect_list(F.struct("code", "full_name", F.col("full_name").alias("fastf1_full_name"), "driver_number", "team"))).alias("drivers"))
    t.join(d, "season").write.option("maxRecordsPerFile", 1).json(path)
