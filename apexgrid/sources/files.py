"""Landed files to typed frames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S

# Headers of the exported files; columns are read by name, never by position.
PRICE_COLUMNS = ["% Picked", "Current Value", "Driver Name", "Constructor Name", "Price Change", "Season Points", "Team"]
SCORE_COLUMNS = ["Driver Name", "Constructor Name", "Team", "Driver Value", "Constructor Value", "Race", "Event Type", "Scoring Item",
                 "Frequency", "Position", "Points", "Race Total", "Season Total"]
# File-name endings of the four kinds.
KINDS = {"driver_price": "*-drivers.csv", "constructor_price": "*-constructors.csv",
         "driver_score": "*-all-drivers-performance.csv", "constructor_score": "*-all-constructors-performance.csv"}


#: Most columns of a file; the widest known export has eleven.
WIDTH = 64
_SCHEMA = ", ".join(f"f{i} string" for i in range(WIDTH))


def csv_fields(line) -> Column:
    """Fields of one CSV line by the engine's own reader: quoted fields may hold commas and doubled quotes. Fields that are empty or not there are null."""
    parsed = F.from_csv(F.regexp_replace(line, "[\ufeff\r]", ""), _SCHEMA, {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return F.array(*[parsed[f"f{i}"] for i in range(WIDTH)])


def export_name(path: Column) -> Column:
    """Name of the file, or of the folder of parts (``file=...``) that stands for one."""
    folder = F.regexp_extract(path, r"/file=([^/]+)/part-[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1))


def csv_lines(reader, root: str, kind: str) -> DataFrame:
    """Lines of all files of one kind with the file they come from; ``reader`` is ``spark.read`` or ``spark.readStream``."""
    lines = (reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{KINDS[kind]},part-*.csv}}").format("text").load(root)
             .select("value", F.col("_metadata.file_path").alias("path"), export_name(F.col("_metadata.file_path")).alias("file_name"),
                     F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("delivered_at")))
    lines = lines.where(F.col("file_name").endswith(KINDS[kind][1:]))
    return lines.where(~F.col("file_name").contains("performance")) if kind.endswith("price") else lines


def by_header(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns by header name, whatever the order, width and quoting of each file's header.

    Exports differ in their headers, so each line meets the header of its own file (an equi-join on the file path);
    nothing is listed or opened on the driver.
    """
    # the header is the first line of the first block of each file
    heads = (lines.where("block = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "n").alias("head"))
             .withColumn("names", F.transform(csv_fields(F.col("head")), lambda x: F.trim(x))))
    rows = lines.join(heads, "path").where((F.col("value") != F.col("head")) & (F.trim("value") != "")).withColumn("_f", csv_fields(F.col("value")))

    def named(c: str) -> Column:
        at = F.array_position("names", c).cast("int")
        return F.when(at > 0, F.nullif(F.try_element_at("_f", at), F.lit(""))).alias(c)

    return rows.select(*[named(c) for c in columns], "file_name", "delivered_at")


def _csv_by_name(spark: SparkSession, root: str, kind: str, columns: list[str]) -> DataFrame:
    return by_header(csv_lines(spark.read, root, kind), columns).drop("delivered_at")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All CSV files below ``root`` with their kind; null kind = not recognised."""
    names = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root)
             .select("path", export_name(F.col("path")).alias("file_name")))
    n = F.col("file_name")
    perf = n.contains("performance")
    return names.withColumn("kind", F.when(n.endswith("-drivers.csv") & ~perf, "driver_price").when(n.endswith("-constructors.csv") & ~perf, "constructor_price")
                            .when(n.endswith("-all-drivers-performance.csv"), "driver_score").when(n.endswith("-all-constructors-performance.csv"), "constructor_score"))


def price_snapshots(spark: SparkSession, root: str, kind: str = "driver_price") -> DataFrame:
    """Price snapshots: one file per day, the day from the file name."""
    return type_prices(_csv_by_name(spark, root, kind, PRICE_COLUMNS))


def type_prices(raw: DataFrame, *also: str) -> DataFrame:
    return raw.select(
        S.date_of_file(F.col("file_name")).alias("snapshot_date"), S.year_of_file(F.col("file_name")).alias("season_year"),
        F.trim(F.coalesce("Driver Name", "Constructor Name")).alias("name"), F.col("Team").alias("team"),
        S.money(F.col("Current Value")).alias("price"), S.money(F.col("Price Change")).cast("decimal(4,1)").alias("price_change"),
        F.col("`% Picked`").try_cast("double").alias("pick_percentage"), S.strict_int(F.col("Season Points")).alias("season_points"), "file_name", *also)


def score_lines(spark: SparkSession, root: str, kind: str = "driver_score") -> DataFrame:
    """Scoring line items as exported."""
    return type_scores(_csv_by_name(spark, root, kind, SCORE_COLUMNS))


def type_scores(raw: DataFrame, *also: str) -> DataFrame:
    return raw.select(
        S.year_of_file(F.col("file_name")).alias("season_year"), F.trim(F.coalesce("Driver Name", "Constructor Name")).alias("name"),
        F.trim("Race").alias("race"), F.col("Event Type").alias("event_type"), F.col("Scoring Item").alias("scoring_item"),
        S.strict_int(F.col("Frequency")).alias("frequency"), S.strict_int(F.col("Position")).alias("position"),
        S.strict_int(F.col("Points")).alias("points"), S.strict_int(F.col("Race Total")).alias("race_total"),
        S.strict_int(F.col("Season Total")).alias("season_total"), "file_name", F.lit("import").alias("source"), *also)


def starting_prices(spark: SparkSession, path: str) -> DataFrame:
    """``key,price`` without header; comments, blank and short rows dropped."""
    raw = spark.read.schema("k STRING, p STRING").csv(path, header=False, comment="#", mode="PERMISSIVE")
    return raw.select(F.trim("k").alias("key"), F.trim("p").try_cast("decimal(5,1)").alias("price")).where("key <> '' AND price IS NOT NULL")


def roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(teams, drivers) of a roster document."""
    doc = spark.read.schema(
        "season INT, teams ARRAY<STRUCT<name:STRING,fastf1_name:STRING,code:STRING>>, "
        "drivers ARRAY<STRUCT<code:STRING,full_name:STRING,fastf1_full_name:STRING,driver_number:INT,team:STRING>>").json(path, multiLine=True)
    teams = doc.select("season", F.explode("teams").alias("t")).select(
        "season", F.col("t.name").alias("label"), F.coalesce("t.fastf1_name", "t.name").alias("name"), F.coalesce("t.code", F.lit("")).alias("code"))
    drivers = doc.select("season", F.explode("drivers").alias("d")).select("season", "d.code", "d.full_name", "d.driver_number", F.col("d.team").alias("team_label"))
    return teams, drivers
