"""Raw session frames to table rows: unknown names are dropped and reported."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..params import SESSION_CODES


def laps(raw: DataFrame, drivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lap rows, sorted distinct unknown codes per session)."""
    known = drivers.select(F.col("code").alias("Driver"), "driver_id")
    num = lambda c: S.null_if_nan(F.col(c).cast("double"))
    rows = raw.join(known, "Driver").select(
        "session_id", "driver_id", F.col("LapNumber").cast("int").alias("lap_number"), num("LapTime").alias("lap_time"),
        *[num(f"Sector{i}Time").alias(f"sector{i}") for i in (1, 2, 3)], num("PitInTime").alias("pit_in"), num("PitOutTime").alias("pit_out"),
        num("PitInTime").isNotNull().alias("is_pit_in"), num("PitOutTime").isNotNull().alias("is_pit_out"),
        S.int_or_null(num("Stint")).alias("stint"), S.text_or_null(F.col("Compound")).alias("compound"), S.int_or_null(num("TyreLife")).alias("tyre_life"),
        S.text_or_null(F.col("TrackStatus")).alias("track_status"), S.int_or_null(num("Position")).alias("position"),
        F.col("IsPersonalBest").alias("is_personal_best"), F.col("IsAccurate").alias("is_accurate"))
    return rows, unknown(raw, known, ["Driver"], "Driver")


def unknown(raw: DataFrame, known: DataFrame, on: list[str], name: str) -> DataFrame:
    """Names without a match, as one sorted list per session (bounded by the entry list)."""
    return raw.join(known, on, "left_anti").groupBy("session_id").agg(F.array_sort(F.collect_set(name)).alias("skipped"))


def results(raw: DataFrame, drivers: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result rows, skipped codes); a row needs both a known driver and a known team."""
    if "FastestLapRank" not in raw.columns:
        raw = raw.withColumn("FastestLapRank", F.lit(None).cast("double"))
    d = drivers.select(F.col("code").alias("Abbreviation"), "driver_id")
    t = teams.select(F.col("name").alias("TeamName"), "team_id")
    both = raw.join(d, "Abbreviation", "left").join(t, "TeamName", "left").withColumn("_ok", F.col("driver_id").isNotNull() & F.col("team_id").isNotNull())
    num = lambda c: S.null_if_nan(F.col(c).cast("double"))
    rows = both.where("_ok").select(
        "session_id", "driver_id", "team_id", S.int_or_null(num("Position")).alias("position"), F.col("ClassifiedPosition").cast("string").alias("classified_position"),
        S.int_or_null(num("GridPosition")).alias("grid_position"), F.col("Status").cast("string").alias("status"),
        F.coalesce(num("Points"), F.lit(0.0)).alias("points"), num("Time").alias("time"), S.int_or_null(num("FastestLapRank")).alias("fastest_lap_rank"))
    skipped = both.where("NOT _ok").groupBy("session_id").agg(F.array_sort(F.collect_set("Abbreviation")).alias("skipped"))
    return rows, skipped


def weather(raw: DataFrame) -> DataFrame:
    """Sample time = session start + offset (a day-time interval)."""
    return raw.select("session_id", (F.col("session_date") + F.col("Time")).alias("timestamp"), F.col("AirTemp").cast("double").alias("air_temp"),
                      F.col("TrackTemp").cast("double").alias("track_temp"), F.col("Humidity").cast("double").alias("humidity"), F.col("Pressure").cast("double").alias("pressure"),
                      F.col("WindSpeed").cast("double").alias("wind_speed"), F.col("WindDirection").cast("int").alias("wind_direction"), F.col("Rainfall").cast("boolean").alias("rainfall"))


def schedule(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Wide schedule to one row per session; unknown labels and testing events drop out."""
    slots = F.array(*[F.struct(F.col(f"Session{i}").alias("label"), F.col(f"Session{i}Date").alias("date")) for i in range(1, 6)])
    codes = F.create_map(*[F.lit(x) for kv in SESSION_CODES.items() for x in kv])
    long = raw.where(F.col("EventFormat") != "testing").select(*keys, F.explode(slots).alias("s"))
    return long.select(*keys, F.try_element_at(codes, F.col("s.label")).alias("session_type"), F.col("s.date").alias("date")).where(F.col("session_type").isNotNull())


def failures(raw: DataFrame) -> DataFrame:
    """Sessions with lap records that name no driver or no lap: nothing of such a session is stored."""
    broken = F.col("Driver").isNull() | S.null_if_nan(F.col("LapNumber").cast("double")).isNull()
    return raw.groupBy("session_id").agg(F.count_if(broken).alias("broken")).where("broken > 0") \
        .select("session_id", F.concat(F.col("broken").cast("string"), F.lit(" unusable lap records")).alias("error_message"))


def audit(laps_df: DataFrame, results_df: DataFrame, weather_df: DataFrame, skipped: DataFrame, failed: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One status row per session: row counts and the skipped names as text; ``failed(session_id, error_message)`` stored nothing.

    ``earlier(session_id, retry_count)`` is the status before; each failure adds one to its count.
    """
    n = lambda df, c: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(c))
    counts = ["lap_count", "result_count", "weather_sample_count"]
    df = n(laps_df, "lap_count").join(n(results_df, "result_count"), "session_id", "full").join(n(weather_df, "weather_sample_count"), "session_id", "full")
    df = df.join(skipped, "session_id", "left")
    df = df.join(failed, "session_id", "full") if failed is not None else df.withColumn("error_message", F.lit(None).cast("string"))
    df = df.join(earlier.select("session_id", F.col("retry_count").alias("before")), "session_id", "left") if earlier is not None else df.withColumn("before", F.lit(0))
    bad = F.col("error_message").isNotNull()
    names = F.when(~bad, F.concat_ws(", ", "skipped"))
    return df.select("session_id", F.when(bad, "failed").otherwise("completed").alias("status"), *[F.when(bad, 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in counts],
                     F.coalesce(names, F.lit("")).alias("skipped"), (F.coalesce("before", F.lit(0)) + bad.cast("int")).alias("retry_count"), F.coalesce("error_message", F.lit("")).alias("error_message"))


def run_totals(audited: DataFrame) -> DataFrame:
    """What a collection run reports: sessions stored and failed, and the rows they brought."""
    done = F.col("status") == "completed"
    return audited.agg(F.count_if(done).alias("sessions_processed"), F.count_if(~done).alias("sessions_skipped"), F.sum("lap_count").alias("lap_count"), F.sum("retry_count").alias("retry_count"))
