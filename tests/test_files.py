"""File scans, sinks and the drop-folder stream."""
import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from apexgrid.operators import sinks_logic as SK
from apexgrid.sources import files, mappers, sinks
from apexgrid.streaming.ingest import ingest


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


@pytest.fixture
def drop(tmp_path):
    root = str(tmp_path / "in")
    put(root + "/2025", "2025-11-07-drivers.csv", "% Picked,Current Value,Driver Name,Price Change,Season Points,Team\n25.00,$23.8M,Ann Fast,$0.3M,100,Alpha\n3.00,$4.5M,Bo Slow,-$0.1M,-7,Beta\n")
    put(root + "/2026", "2026-03-27-drivers.csv", "% Picked,Current Value,Driver Name,Price Change,Season Points\n26.00,$24.1M,Ann Fast,$0.3M,x\n")
    put(root + "/2026", "2026-03-27-constructors.csv", "% Picked,Constructor Name,Current Value,Price Change,Season Points\n33.00,Alpha,$29.9M,$0.3M,211\n")
    put(root + "/2026", "2026-03-27-all-drivers-performance.csv", "Driver Name,Team,Driver Value,Race,Event Type,Scoring Item,Frequency,Position,Points,Race Total,Season Total\n"
        "Ann Fast,Alpha,$23.8M,China,sprint,Sprint Positions Lost,3,,-3,68,100\nAnn Fast,Alpha,$23.8M,China,race,Race Position,,2,18,68,100\n")
    put(root, "notes.csv", "a,b\n1,2\n")
    return root


def test_listing_routes_by_suffix(spark, drop):
    got = {r["file_name"]: r["kind"] for r in files.listing(spark, drop).collect()}
    assert got == {"2025-11-07-drivers.csv": "driver_price", "2026-03-27-drivers.csv": "driver_price", "2026-03-27-constructors.csv": "constructor_price",
                   "2026-03-27-all-drivers-performance.csv": "driver_score", "notes.csv": None}


def test_prices_are_read_by_header_name(spark, drop):
    rows = {(str(r["snapshot_date"]), r["name"]): r for r in files.price_snapshots(spark, drop).collect()}
    assert len(rows) == 3
    a = rows["2025-11-07", "Ann Fast"]
    assert (a["price"], a["price_change"], a["team"], a["season_points"], a["pick_percentage"]) == (Decimal("23.8"), Decimal("0.3"), "Alpha", 100, 25.0)
    assert rows["2025-11-07", "Bo Slow"]["season_points"] == -7
    b = rows["2026-03-27", "Ann Fast"]
    assert b["team"] is None and b["season_points"] is None and b["season_year"] == 2026
    c = files.price_snapshots(spark, drop, "constructor_price").collect()
    assert [(r["name"], r["price"]) for r in c] == [("Alpha", Decimal("29.9"))]


def test_score_lines(spark, drop):
    rows = files.score_lines(spark, drop).orderBy("points").collect()
    assert [(r["scoring_item"], r["frequency"], r["position"], r["points"], r["race_total"]) for r in rows] == [
        ("Sprint Positions Lost", 3, None, -3, 68), ("Race Position", None, 2, 18, 68)]
    assert {r["source"] for r in rows} == {"import"}


def test_starting_prices(spark, tmp_path):
    put(str(tmp_path), "p.csv", "# start\n\nVER , 26.9\nHAM\n#x,1\nNOR,bad\nLEC,20\n")
    got = {r["key"]: r["price"] for r in files.starting_prices(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {"VER": Decimal("26.9"), "LEC": Decimal("20.0")}


def test_roster(spark, tmp_path):
    put(str(tmp_path), "r.json", json.dumps({"season": 2026, "teams": [{"name": "A", "fastf1_name": "A Racing"}, {"name": "B", "code": "b"}],
                                             "drivers": [{"code": "AAA", "full_name": "A A", "driver_number": 1, "team": "A"}]}, indent=1))
    teams, drivers = files.roster(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in teams.orderBy("label").collect()] == [(2026, "A", "A Racing", ""), (2026, "B", "B", "b")]
    assert drivers.first()["team_label"] == "A"


def test_partition_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "session_id int, v string"), path, "session_id")
    for _ in range(2):
        sinks.replace_partitions(spark.createDataFrame([(1, "z")], "session_id int, v string"), path, "session_id")
    assert sorted((r["session_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


def test_upsert_counts_and_idempotence(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "event_id int, driver_id int, v string, n int")
    assert sinks.upsert(spark, path, df([(1, 1, "a", 1), (1, 1, "b", 2), (2, 1, "c", 1)]), ["event_id", "driver_id"], "event_id", order="n") == {"created": 2}
    again = df([(1, 1, "d", 1), (1, 2, "e", 1)])
    assert sinks.upsert(spark, path, again, ["event_id", "driver_id"], "event_id", order="n") == {"created": 1, "updated": 1}
    first = sorted(map(str, spark.read.parquet(path).collect()))
    assert sinks.upsert(spark, path, again, ["event_id", "driver_id"], "event_id", order="n") == {"updated": 2}
    assert sorted(map(str, spark.read.parquet(path).collect())) == first and len(first) == 3


def test_insert_missing_keeps_existing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "year int, name string, v string")
    sinks.insert_missing(spark, path, df([(1, "a", "old")]), ["year", "name"], "year")
    sinks.insert_missing(spark, path, df([(1, "a", "new"), (1, "b", "new")]), ["year", "name"], "year")
    assert sorted((r["name"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", "old"), ("b", "new")]


def test_rename_keeps_id_and_code(spark):
    old = spark.createDataFrame([(1, 10, "Cad", "cad"), (1, 11, "Haas", "haas")], "season_id int, team_id int, name string, code string")
    new = spark.createDataFrame([(1, "Cad F1 Team", "Cad", "", 90), (1, "Haas", "Haas", "", 91), (1, "New", "New", "n", 92)], "season_id int, name string, label string, code string, fresh_id int")
    got = {r["team_id"]: (r["name"], r["code"], r["action"]) for r in SK.upsert_with_rename(old, new).collect()}
    assert got == {10: ("Cad F1 Team", "cad", "renamed"), 11: ("Haas", "haas", "updated"), 92: ("New", "n", "created")}


def test_runs_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "runs")
    races = spark.createDataFrame([(1, 1.0, 2.0, 3.0, None), (2, 3.0, 2.0, 5.0, 9.0)], "event_id int, mae_position double, mae_points double, lineup_actual double, optimal_actual double")
    assert sinks.append_run(spark, root, 1, races.limit(0)) is False and not os.path.exists(f"{root}/manifest")
    assert sinks.append_run(spark, root, 2, races, optimizer="exact") is True
    sinks.write_run(spark, root, 3, races, optimizer="greedy")  # a crash before the manifest
    runs, rows = sinks.read_runs(spark, root)
    assert [(r["run_id"], r["races"], r["lineup_actual"], r["optimizer"]) for r in runs.collect()] == [(2, 2, 8.0, "exact")] and rows.count() == 2
    assert sinks.append_run(spark, root, 2, races.where("event_id = 2"), optimizer="exact") and sinks.append_run(spark, root, 3, races, optimizer="greedy")
    runs, rows = sinks.read_runs(spark, root)
    assert {r["run_id"]: r["races"] for r in runs.collect()} == {2: 1, 3: 2} and rows.count() == 3


def test_failed_sessions_are_audited(spark):
    raw = spark.createDataFrame([(1, "AAA", 1.0), (2, None, 1.0), (2, "AAA", float("nan")), (2, "AAA", 2.0)], "session_id int, Driver string, LapNumber double")
    failed = mappers.failures(raw)
    assert [tuple(r) for r in failed.collect()] == [(2, "2 unusable lap records")]
    one = raw.select("session_id")
    got = mappers.audit(one, one, one, spark.createDataFrame([(1, ["ZZZ"]), (2, ["YYY"])], "session_id int, skipped array<string>"), failed,
                        spark.createDataFrame([(1, 4), (2, 1)], "session_id int, retry_count int"))
    assert {r["session_id"]: (r["status"], r["lap_count"], r["skipped"], r["retry_count"]) for r in got.collect()} == {1: ("completed", 1, "ZZZ", 4), 2: ("failed", 0, "", 2)}
    assert tuple(mappers.run_totals(got).first()) == (1, 1, 1, 6)


def test_lap_mapper_reports_unknown_codes(spark):
    raw = spark.createDataFrame([(1, "AAA", 1.0, 90.0, float("nan"), 30.0, 30.0, None, 5.0, 1.0, "nan", 2.0, "1", 3.0, False, True),
                                 (1, "ZZZ", 1.0, 90.0, 30.0, 30.0, 30.0, None, None, 1.0, "SOFT", 2.0, "1", 3.0, False, True)],
                                "session_id int, Driver string, LapNumber double, LapTime double, Sector1Time double, Sector2Time double, Sector3Time double, PitInTime double, PitOutTime double, "
                                "Stint double, Compound string, TyreLife double, TrackStatus string, Position double, IsPersonalBest boolean, IsAccurate boolean")
    rows, skipped = mappers.laps(raw, spark.createDataFrame([("AAA", 7)], "code string, driver_id int"))
    r = rows.first()
    assert (r["driver_id"], r["sector1"], r["is_pit_in"], r["is_pit_out"], r["compound"], r["stint"]) == (7, None, False, True, None, 1)
    assert skipped.first()["skipped"] == ["ZZZ"]


def test_stream_ingests_each_file_once(spark, tmp_path, drop):
    folder, table, ck = str(tmp_path / "drop"), str(tmp_path / "table"), str(tmp_path / "ck")
    head = "% Picked,Current Value,Driver Name,Price Change,Season Points\n"
    put(folder, "2026-03-27-drivers.csv", head + "26.00,$24.1M,Ann Fast,$0.3M,5\n")
    ingest(spark, folder, table, ck)
    ingest(spark, folder, table, ck)  # nothing new
    put(folder, "2026-04-03-drivers.csv", head + "27.00,$24.4M,Ann Fast,$0.3M,9\n")
    put(folder + "/again", "2026-03-27-drivers.csv", head + "26.50,$24.2M,Ann Fast,$0.3M,5\n")  # same day once more: replaced by key
    ingest(spark, folder, table, ck)
    rows = spark.read.parquet(table).orderBy("snapshot_date").collect()
    assert [(r["snapshot_date"], r["price"]) for r in rows] == [(dt.date(2026, 3, 27), Decimal("24.2")), (dt.date(2026, 4, 3), Decimal("24.4"))]


def test_stream_reads_any_header_by_name(spark, tmp_path):
    folder, table, ck = str(tmp_path / "drop"), str(tmp_path / "table"), str(tmp_path / "ck")
    put(folder, "2026-03-27-drivers.csv", '\ufeffDriver Name,% Picked,Current Value,"Note, long",Team,Price Change,Season Points,A,B,C,D\r\n"Fast, Ann",25.00,$23.8M,"say ""x"", y",T,$0.3M,5,1,2,3,4\r\n')
    put(folder, "2026-03-28-drivers.csv", "% Picked,Current Value,Driver Name,Price Change,Season Points\n26.00,$24.1M,Bob,$0.3M,7\n")
    ingest(spark, folder, table, ck)
    rows = {r["name"]: r for r in spark.read.parquet(table).collect()}
    assert (rows["Fast, Ann"]["price"], rows["Fast, Ann"]["pick_percentage"], rows["Fast, Ann"]["season_points"], rows["Fast, Ann"]["team"]) == (Decimal("23.8"), 25.0, 5, "T")
    assert (rows["Bob"]["price"], rows["Bob"]["team"]) == (Decimal("24.1"), None)


def test_stream_ingests_teams_and_scores(spark, tmp_path):
    folder = str(tmp_path / "drop")
    put(folder, "2026-03-27-constructors.csv", "Constructor Name,Current Value,% Picked,Price Change,Season Points\nRed,$30.0M,40.0,$0.1M,50\n")
    put(folder, "2026-03-27-drivers.csv", "Driver Name,Current Value,% Picked,Price Change,Season Points\nAnn,$20.0M,40.0,$0.1M,50\n")
    ingest(spark, folder, str(tmp_path / "cp"), str(tmp_path / "ck1"), "constructor_price")
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "cp")).collect()] == ["Red"]
    head = "Points,Driver Name,Team,Race,Event Type,Scoring Item,Frequency,Position,Race Total,Season Total\n"
    put(folder, "2026-03-27-all-drivers-performance.csv", head + "25,Ann,T,Oz,race,Race Position,,1,25,25\n")
    for turn in (1, 2):
        ingest(spark, folder, str(tmp_path / "ds"), str(tmp_path / "ck2"), "driver_score")
        put(folder + "/again", "2026-03-27-all-drivers-performance.csv", head + "26,Ann,T,Oz,race,Race Position,,1,26,26\n")
    rows = spark.read.parquet(str(tmp_path / "ds")).collect()
    assert [(r["name"], r["race"], r["points"], r["race_total"]) for r in rows] == [("Ann", "Oz", 26, 26)]


def test_constructor_items_are_scored_once(spark, monkeypatch):
    """Two headers a delivery read them, and each delivery again: from a written table, not from all laps."""
    from apexgrid.catalog import files as CF
    from apexgrid.catalog.bindings import Bindings
    v = Bindings(spark, "/root/testdata/sf0.001")
    rows = CF._scores(v, "constructor_score")
    assert not any("lineitem" in f for f in rows.inputFiles()) and any("constructor-items" in f for f in rows.inputFiles())
    assert CF._scores(Bindings(spark, "/root/testdata/sf0.001"), "constructor_score").inputFiles() == rows.inputFiles()
