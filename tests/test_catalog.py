"""Every registered query has a stable schema; entry works; oracles name registered queries."""
import __spark_entry__ as entry
from apexgrid.schemas import TABLES, ddl_of, key_of


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ddl_parses_and_holds_its_key(spark):
    for t in TABLES:
        cols = spark.createDataFrame([], ddl_of(t)).columns
        assert set(key_of(t)) <= set(cols), t


def test_event_grain_keys_are_unique(views):
    for name, key in (("b_result", ["event_id", "driver_id"]), ("b_spine", ["event_id", "driver_id"]), ("b_price", ["event_id", "driver_id"]),
                      ("b_lineup", ["event_id"]), ("b_total", ["event_id", "driver_id"])):
        df = getattr(views, name)
        assert df.count() == df.select(*key).distinct().count()
