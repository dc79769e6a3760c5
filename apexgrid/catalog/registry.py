"""Registry of queries and their SQL oracles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .bindings import Bindings, oracle_text, unthinned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def presentable(df: DataFrame) -> DataFrame:
    """Plain comparable column types: bigint, double (6 digits), string, boolean."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _typed(sql: str, d: str, i: str, s: str) -> str:
    """Wrap an oracle so that its columns have the plain types of ``presentable``."""
    casts = ([f"round(cast({c} AS double), 6) + 0.0 AS {c}" for c in d.split()]
             + [f"cast({c} AS bigint) AS {c}" for c in i.split()]
             + [f"cast({c} AS varchar) AS {c}" for c in s.split()])
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) oracle" if casts else sql


#: Queries that are registered once more over views without left-out rows.
WHOLE = ("flagship_form_and_standings", "fs04_feature_set_v4", "fs05_feature_set_race", "fs07_race_training_set", "sc01_race_and_sprint_items", "sc03_constructor_items", "sc04_season_driver_scores",
         "sc05_lineup_points", "evl06_metric_bundle", "pr01_driver_price_chain", "pr04_price_trajectory", "jn17_ln04_exact_lineup", "ln01_greedy_lineup", "ln02_upgraded_lineup", "ln07_oracle_score",
         "rp01_season_dashboard", "rp06_session_list")


def query(name: str, sql: str | None = None, d: str = "", i: str = "", s: str = ""):
    """Register ``fn(v: Bindings) -> DataFrame`` under ``name`` with an optional oracle body.

    ``d``, ``i``, ``s`` name the oracle columns to present as double, bigint and string.
    """

    def wrap(fn: Callable[[Bindings], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(Bindings(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _typed(oracle_text(sql), d, i, s)
        if name in WHOLE:
            QUERIES[f"{name}_whole"] = lambda spark, sf_dir: presentable(fn(Bindings(spark, sf_dir, whole=True)))
            ORACLES[f"{name}_whole"] = unthinned(ORACLES[name])
        return fn

    return wrap
