"""Racing views over the given star-schema tables.

Every view is one portable SELECT, so the Spark query and its SQL oracle start
from the same definition.  ``{name}`` marks another view or a given table.

The field is split into championships ("series") of twenty suppliers, ten teams
of two.  That keeps the racing rule that one event has a bounded grid at every
scale: events grow with the suppliers, the rows of one event do not.
"""
from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import overtakes
from ..session import stage

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the game rules, as SQL.
_RACE_PTS = ("CASE {p} WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10 "
             "WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END")
_SPRINT_PTS = "CASE WHEN {p} BETWEEN 1 AND 8 THEN 9 - {p} ELSE 0 END"
_QUALI_PTS = "CASE WHEN {p} BETWEEN 1 AND 10 THEN 11 - {p} ELSE 0 END"


def race_pts(p: str) -> str:
    return _RACE_PTS.format(p=p)


def quali_pts(p: str) -> str:
    return _QUALI_PTS.format(p=p)


def sprint_pts(p: str) -> str:
    return _SPRINT_PTS.format(p=p)


_KEYS = """code, code*10000+season_year AS driver_id, team_no*10000+season_year AS team_id,
    concat('T', cast(team_no AS string)) AS team_code, series,
    series*10000+season_year AS season_id, season_year, round_no, season_year*10+round_no AS weekend_id,
    series*100000+season_year*10+round_no AS event_id,
    make_date(cast(season_year AS int), cast(round_no*3-2 AS int), 1) AS event_date"""

_LI_KEYS = """l_suppkey AS code, cast((l_suppkey - l_suppkey % 20) / 20 AS bigint) AS series,
    cast((l_suppkey - l_suppkey % 2) / 2 AS bigint) AS team_no,
    cast(year(l_shipdate) AS bigint) AS season_year, cast(quarter(l_shipdate) AS bigint) AS round_no"""

#: Rows that the views leave out, so that defaults for absent rows have something to do; queries named ``..._whole`` run without.
THINNED = {"result": "(3*code + season_year*4 + round_no) % 17 <> 0", "price": "(code+round_no) % 19 <> 0", "status": "hh <> 5"}


def unthinned(text: str) -> str:
    """A view's or oracle's text without those filters."""
    for condition in THINNED.values():
        text = text.replace(f"WHERE {condition}", "WHERE true")
    return text


VIEWS: dict[str, str] = {
    # one row per supplier and quarter: the only full scan most queries need
    "b_agg": f"""
SELECT {_LI_KEYS},
    sum(cast(l_extendedprice AS decimal(18,2))) AS sum_price,
    sum(cast(round(l_quantity) AS bigint)) AS sum_qty,
    max(cast(l_extendedprice AS decimal(18,2))) AS max_price,
    min(cast(l_extendedprice AS decimal(18,2))) AS min_price
FROM {{lineitem}} GROUP BY 1, 2, 3, 4, 5""",
    "b_event": """
SELECT DISTINCT series*100000+season_year*10+round_no AS event_id, series,
    series*10000+season_year AS season_id, season_year, round_no,
    season_year*10+round_no AS weekend_id,
    make_date(cast(season_year AS int), cast(round_no*3-2 AS int), 1) AS event_date,
    round_no AS circuit_id,
    CASE WHEN round_no = 4 THEN NULL ELSE cast(round_no*1.5 AS double) END AS circuit_length,
    CASE WHEN round_no = 3 THEN 19 ELSE round_no+10 END AS total_corners,
    CASE WHEN round_no = 2 THEN 'sprint' ELSE 'conventional' END AS event_format,
    concat('Region ', cast(round_no AS string), ' Grand Prix') AS event_name
FROM {b_agg}""",
    "b_driver": """
SELECT DISTINCT code, code*10000+season_year AS driver_id, team_no*10000+season_year AS team_id,
    concat('T', cast(team_no AS string)) AS team_code, series, series*10000+season_year AS season_id, season_year
FROM {b_agg}""",
    "b_team": """
SELECT DISTINCT team_id, team_code, series, season_id, season_year FROM {b_driver}""",
    # every season driver at every event of the season, with or without a result
    "b_spine": """
SELECT e.event_id, e.event_date, e.weekend_id, e.season_year, e.season_id, e.series, e.round_no, e.circuit_id,
    e.circuit_length, e.total_corners, e.event_format, d.driver_id, d.code, d.team_id, d.team_code
FROM {b_event} e JOIN {b_driver} d ON d.season_id = e.season_id""",
    "b_rank": f"""
SELECT {_KEYS},
    cast(row_number() OVER (PARTITION BY series, season_year, round_no ORDER BY sum_price DESC, code) AS bigint) AS r_pos,
    cast(row_number() OVER (PARTITION BY series, season_year, round_no ORDER BY sum_qty DESC, code) AS bigint) AS q_pos,
    cast(row_number() OVER (PARTITION BY series, season_year, round_no ORDER BY max_price DESC, code) AS bigint) AS fl_pos,
    cast(row_number() OVER (PARTITION BY series, season_year, round_no ORDER BY min_price DESC, code) AS bigint) AS s_pos,
    (7*code + 3*(season_year*4+round_no)) % 13 AS h
FROM {{b_agg}}""",
    "b_result": f"""
SELECT *, cast({race_pts('position')} AS double) AS points FROM (
  SELECT event_id, event_date, weekend_id, season_year, season_id, series, round_no, round_no AS circuit_id,
    driver_id, code, team_id, team_code, 'R' AS session_type,
    CASE WHEN h = 0 AND code % 2 = 0 THEN NULL ELSE r_pos END AS position,
    q_pos AS grid_position,
    CASE h WHEN 0 THEN 'Engine' WHEN 1 THEN '+1 Lap' ELSE 'Finished' END AS status,
    CASE WHEN (code+season_year) % 97 = 0 THEN 'd' ELSE cast(r_pos AS string) END AS classified_position,
    fl_pos AS fastest_lap_rank
  FROM {{b_rank}} WHERE {THINNED["result"]}) x""",
    "b_quali": f"""
SELECT *, cast({quali_pts('position')} AS double) AS points FROM (
  SELECT event_id, event_date, weekend_id, season_year, season_id, series, round_no, round_no AS circuit_id,
    driver_id, code, team_id, team_code, 'Q' AS session_type,
    CASE WHEN (5*code+round_no) % 17 = 0 THEN NULL ELSE q_pos END AS position,
    cast(NULL AS bigint) AS grid_position,
    CASE WHEN (5*code+round_no) % 17 = 0 AND code % 2 = 0 THEN 'Engine' ELSE 'Finished' END AS status,
    CASE WHEN (code+season_year) % 89 = 0 THEN 'D' ELSE cast(q_pos AS string) END AS classified_position,
    cast(NULL AS bigint) AS fastest_lap_rank
  FROM {{b_rank}}) x""",
    "b_sprint": f"""
SELECT *, cast({sprint_pts('position')} AS double) AS points FROM (
  SELECT event_id, event_date, weekend_id, season_year, season_id, series, round_no, round_no AS circuit_id,
    driver_id, code, team_id, team_code, 'S' AS session_type,
    CASE WHEN h = 2 AND code % 2 = 1 THEN NULL ELSE fl_pos END AS position,
    s_pos AS grid_position,
    CASE h WHEN 2 THEN 'Engine' WHEN 3 THEN '+1 Lap' ELSE 'Finished' END AS status,
    cast(fl_pos AS string) AS classified_position, q_pos AS fastest_lap_rank
  FROM {{b_rank}} WHERE round_no = 2) x""",
    "b_sq": """
SELECT event_id, event_date, weekend_id, season_year, season_id, series, round_no, round_no AS circuit_id,
    driver_id, code, team_id, team_code, 'SQ' AS session_type,
    CASE WHEN (5*code+season_year) % 17 = 0 THEN NULL ELSE s_pos END AS position,
    cast(NULL AS bigint) AS grid_position, 'Finished' AS status,
    cast(s_pos AS string) AS classified_position, cast(NULL AS bigint) AS fastest_lap_rank,
    cast(0 AS double) AS points
FROM {b_rank} WHERE round_no = 2""",
    "b_results_all": """
SELECT * FROM {b_result} UNION ALL SELECT * FROM {b_quali}
UNION ALL SELECT * FROM {b_sprint} UNION ALL SELECT * FROM {b_sq}""",
    # practice laps, one per line item
    "b_lap": f"""
SELECT {_KEYS}, session_type, lap_time, stint, compound,
    CASE WHEN l_returnflag = 'R' AND tax_pct = 7 THEN NULL ELSE qty END AS tyre_life,
    lap_time*0.3 AS sector1, CASE WHEN tax_pct = 5 THEN NULL ELSE lap_time*0.35 END AS sector2,
    lap_time*0.4 AS sector3,
    tax_pct > 0 AS is_accurate, tax_pct = 1 AS is_pit_in, tax_pct = 2 AS is_pit_out
FROM (
  SELECT {_LI_KEYS}, CASE WHEN l_linenumber = 1 THEN 'FP1' WHEN l_linenumber <= 5 THEN 'FP2' ELSE 'FP3' END AS session_type,
    l_extendedprice / l_quantity AS lap_time, cast(l_linenumber % 2 AS bigint) AS stint, l_linestatus AS compound,
    cast(round(l_quantity) AS bigint) AS qty, cast(round(l_tax*100) AS bigint) AS tax_pct, l_returnflag
  FROM {{lineitem}}) x""",
    # race laps: one per (event, driver, order), the order key is the lap number
    "b_racelap": f"""
SELECT {_KEYS}, lap_number, CASE WHEN pos = 20 THEN NULL ELSE pos END AS position, is_pit_in, is_pit_out
FROM (
  SELECT {_LI_KEYS}, l_orderkey AS lap_number, 1 + max(cast(round(l_quantity) AS bigint)) % 20 AS pos,
    max(cast(round(l_tax*100) AS bigint)) = 1 AS is_pit_in, max(cast(round(l_tax*100) AS bigint)) = 2 AS is_pit_out
  FROM {{lineitem}} GROUP BY 1, 2, 3, 4, 5, 6) x""",
    "b_weather": """
SELECT season_year*10+round_no AS weekend_id, season_year, round_no, round_no AS circuit_id,
    make_date(cast(season_year AS int), cast(round_no*3-2 AS int), 1) AS event_date,
    CASE sess WHEN 0 THEN 'FP1' WHEN 1 THEN 'FP2' WHEN 2 THEN 'FP3' WHEN 3 THEN 'Q' ELSE 'R' END AS session_type,
    track_temp, track_temp - 10 AS air_temp,
    urgent AND (season_year*4+round_no) % 3 = 0 AS rainfall
FROM (SELECT cast(year(o_orderdate) AS bigint) AS season_year, cast(quarter(o_orderdate) AS bigint) AS round_no,
    o_orderkey % 5 AS sess, o_totalprice / 10000 AS track_temp, o_orderpriority = '1-URGENT' AS urgent FROM {orders}) x""",
    "b_price": """
SELECT event_id, event_date, season_id, season_year, round_no, driver_id, code, team_id, team_code, series,
    cast(3.0 + ((code*31+weekend_id*17) % 310) / 10.0 AS decimal(5,1)) AS price,
    cast(((code+weekend_id) % 13 - 6) / 10.0 AS decimal(4,1)) AS price_change,
    cast((code*round_no) % 100 AS double) AS pick_percentage
FROM {b_spine} WHERE """ + THINNED["price"],
    "b_cprice": """
SELECT e.event_id, e.event_date, e.season_id, e.season_year, e.round_no, t.team_id, t.team_code, t.series,
    cast(8.0 + ((((t.team_id - t.season_year) / 10000)*13 + e.weekend_id*7) % 220) / 10.0 AS decimal(5,1)) AS price
FROM {b_event} e JOIN {b_team} t ON t.season_id = e.season_id""",
    "b_pred": f"""
SELECT event_id, event_date, season_id, season_year, round_no, driver_id, code, team_id, team_code, series,
    cast(q_pos AS double) AS predicted_position, pts AS predicted_points, pts - 5 AS lower, pts + 8 AS upper
FROM (SELECT *, cast(({race_pts('q_pos')})*2 + code % 5 AS double) AS pts FROM {{b_rank}}) x""",
    # race laps -> overtakes per (event, driver)
    "b_overtake": """
SELECT event_id, driver_id, sum(gain) AS overtakes FROM (
  SELECT event_id, driver_id, CASE WHEN pit OR prev_pit OR prev IS NULL OR position IS NULL OR position >= prev
      THEN 0 ELSE prev - position END AS gain FROM (
    SELECT event_id, driver_id, position, is_pit_in OR is_pit_out AS pit,
      lag(position) OVER (PARTITION BY event_id, driver_id ORDER BY lap_number) AS prev,
      lag(is_pit_in OR is_pit_out) OVER (PARTITION BY event_id, driver_id ORDER BY lap_number) AS prev_pit
    FROM {b_racelap}) l) g GROUP BY event_id, driver_id""",
    # the scoring line items, by the published rules
    "b_score": f"""
WITH r AS (
  SELECT x.*, CASE WHEN session_type = 'R' THEN 'race' ELSE 'sprint' END AS et,
    CASE WHEN session_type = 'R' THEN 'Race' ELSE 'Sprint' END AS pre,
    upper(classified_position) = 'D' AS dsq,
    position IS NULL AND NOT (status = 'Finished' OR status LIKE '+%') AS dnf,
    CASE WHEN session_type = 'R' THEN {race_pts('position')} ELSE {sprint_pts('position')} END AS pts,
    CASE WHEN session_type = 'R' THEN coalesce(o.overtakes, 0) ELSE 0 END AS ov
  FROM (SELECT * FROM {{b_result}} UNION ALL SELECT * FROM {{b_sprint}}) x
  LEFT JOIN {{b_overtake}} o ON o.event_id = x.event_id AND o.driver_id = x.driver_id),
q AS (
  SELECT *, upper(classified_position) = 'D' AS dsq,
    position IS NULL AND NOT (status = 'Finished' OR status LIKE '+%') AS dnf,
    CASE WHEN session_type = 'Q' THEN 'qualifying' ELSE 'sprint_qualifying' END AS et,
    CASE WHEN session_type = 'Q' THEN 'Qualifying' ELSE 'Sprint Qualifying' END AS pre
  FROM (SELECT * FROM {{b_quali}} UNION ALL SELECT * FROM {{b_sq}}) y),
items AS (
  SELECT event_id, driver_id, et, concat(pre, ' DSQ') AS item, cast(NULL AS bigint) AS freq, cast(NULL AS bigint) AS pos, -20 AS points FROM r WHERE dsq
  UNION ALL SELECT event_id, driver_id, et, concat(pre, ' DNF'), NULL, NULL, -20 FROM r WHERE NOT dsq AND dnf
  UNION ALL SELECT event_id, driver_id, et, concat(pre, ' Position'), NULL, position, pts FROM r WHERE NOT dsq AND NOT dnf AND pts > 0
  UNION ALL SELECT event_id, driver_id, et, 'Positions Gained', grid_position - position, NULL, grid_position - position FROM r WHERE NOT dsq AND NOT dnf AND grid_position > position
  UNION ALL SELECT event_id, driver_id, et, 'Positions Lost', position - grid_position, NULL, grid_position - position FROM r WHERE NOT dsq AND NOT dnf AND grid_position < position
  UNION ALL SELECT event_id, driver_id, et, 'Fastest Lap', NULL, NULL, 10 FROM r WHERE NOT dsq AND NOT dnf AND fastest_lap_rank = 1
  UNION ALL SELECT event_id, driver_id, et, 'Overtake Bonus', ov, NULL, ov FROM r WHERE NOT dsq AND NOT dnf AND ov > 0
  UNION ALL SELECT event_id, driver_id, et, concat(pre, ' Position'), NULL, position, 11 - position FROM q WHERE NOT dsq AND position <= 10
  UNION ALL SELECT event_id, driver_id, et, concat(pre, ' No Time'), NULL, NULL, CASE WHEN session_type = 'Q' THEN -5 ELSE -10 END FROM q WHERE NOT dsq AND position IS NULL AND NOT dnf)
SELECT i.event_id, e.event_date, e.season_id, e.season_year, e.round_no, i.driver_id, d.code, d.team_id, d.team_code,
  i.et AS event_type, i.item AS scoring_item, cast(i.freq AS bigint) AS frequency, cast(i.pos AS bigint) AS position,
  cast(i.points AS bigint) AS points
FROM items i JOIN {{b_event}} e ON e.event_id = i.event_id JOIN {{b_driver}} d ON d.driver_id = i.driver_id""",
    "b_total": """
SELECT event_id, event_date, season_id, season_year, round_no, driver_id, code, team_id, team_code,
    cast(sum(points) AS bigint) AS race_total
FROM {b_score} GROUP BY event_id, event_date, season_id, season_year, round_no, driver_id, code, team_id, team_code""",
    "b_qprog": """
SELECT event_id, event_date, season_id, season_year, round_no, team_id, team_code,
    cast(CASE WHEN q3 = 2 AND q2 = 0 THEN 10 WHEN q3 = 1 AND q2 IN (0, 1) THEN 5 WHEN q3 = 0 AND q2 = 2 THEN 3
         WHEN q3 = 0 AND q2 = 1 THEN 1 ELSE -1 END AS bigint) AS points
FROM (SELECT event_id, event_date, season_id, season_year, round_no, team_id, team_code,
        count(CASE WHEN position <= 10 THEN 1 END) AS q3, count(CASE WHEN position BETWEEN 11 AND 15 THEN 1 END) AS q2
      FROM {b_quali} GROUP BY event_id, event_date, season_id, season_year, round_no, team_id, team_code) x""",
    "b_ctotal": """
SELECT event_id, event_date, season_id, season_year, round_no, team_id, team_code, cast(sum(points) AS bigint) AS race_total
FROM (SELECT event_id, event_date, season_id, season_year, round_no, team_id, team_code, points FROM {b_score} WHERE event_type IN ('race', 'sprint')
      UNION ALL SELECT * FROM {b_qprog}) x
GROUP BY event_id, event_date, season_id, season_year, round_no, team_id, team_code""",
    # submitted line-ups: the first five cars and first two teams of the previous round
    "b_lineup": """
SELECT e.event_id, e.event_date, e.season_id, e.season_year, e.round_no,
    max(CASE WHEN rk = 1 THEN driver_id END) AS d1, max(CASE WHEN rk = 2 THEN driver_id END) AS d2,
    max(CASE WHEN rk = 3 THEN driver_id END) AS d3, max(CASE WHEN rk = 4 THEN driver_id END) AS d4,
    max(CASE WHEN rk = 5 THEN driver_id END) AS d5,
    max(CASE WHEN trk = 1 THEN team_id END) AS c1, max(CASE WHEN trk = 2 THEN team_id END) AS c2,
    max(CASE WHEN rk = 1 THEN driver_id END) AS boost
FROM (
  SELECT season_id, round_no, driver_id, team_id, rk,
    CASE WHEN tf = 1 THEN sum(tf) OVER (PARTITION BY season_id, round_no ORDER BY rk ROWS UNBOUNDED PRECEDING) END AS trk
  FROM (
    SELECT season_id, round_no, driver_id, team_id,
      row_number() OVER (PARTITION BY season_id, round_no ORDER BY r_pos) AS rk,
      CASE WHEN row_number() OVER (PARTITION BY season_id, round_no, team_id ORDER BY r_pos) = 1 THEN 1 ELSE 0 END AS tf
    FROM {b_rank}) a) p
JOIN {b_event} e ON e.season_id = p.season_id AND e.round_no = p.round_no + 1
GROUP BY e.event_id, e.event_date, e.season_id, e.season_year, e.round_no""",
    "b_session": """
SELECT e.event_id*10+k.k AS session_id, e.event_id, e.season_id, e.season_year, e.round_no, e.event_date,
    k.st AS session_type, (e.event_id + k.k*7) % 10 AS hh
FROM {b_event} e JOIN (SELECT * FROM (VALUES ('conventional', 1, 'FP1'), ('conventional', 2, 'FP2'), ('conventional', 3, 'FP3'),
    ('conventional', 4, 'Q'), ('conventional', 5, 'R'), ('sprint', 1, 'FP1'), ('sprint', 2, 'SQ'), ('sprint', 3, 'S'),
    ('sprint', 4, 'Q'), ('sprint', 5, 'R')) AS v(fmt, k, st)) k ON k.fmt = e.event_format""",
    "b_status": """
SELECT session_id, CASE WHEN hh = 0 THEN 'failed' WHEN hh = 1 THEN 'pending' ELSE 'completed' END AS status,
    cast(CASE WHEN hh = 0 THEN 2 ELSE 0 END AS bigint) AS retry_count
FROM {b_session} WHERE """ + THINNED["status"],
    "b_snapshot": """
SELECT user_id, cast(ts AS date) AS snapshot_date, cast(value AS decimal(18,2)) AS value, event_id AS row_id, event_type FROM {events}""",
    # one evaluation row per (configuration, event): three ways of scaling the stand-in predictions
    "b_run_race": """
SELECT c.config_id, c.optimizer, c.sensitivity, c.event_id, c.event_date, c.season_id, c.season_year, c.round_no,
    avg(abs(c.predicted_position + (c.config_id - 1) - r.position)) AS mae_position,
    avg(abs(c.predicted_points * c.sensitivity - t.race_total)) AS mae_points,
    CASE WHEN (c.event_id + c.config_id) % 7 = 0 THEN NULL ELSE sum(CASE WHEN c.predicted_position <= 4 + c.config_id THEN t.race_total END) END AS lineup_actual,
    sum(CASE WHEN r.position <= 5 + c.config_id THEN t.race_total END) AS optimal_actual
FROM (SELECT 1 AS config_id, 'greedy' AS optimizer, 0.5 AS sensitivity, a.* FROM {b_pred} a
      UNION ALL SELECT 2, 'exact', 1.0, a.* FROM {b_pred} a UNION ALL SELECT 3, 'sampled', 1.5, a.* FROM {b_pred} a) c
JOIN {b_result} r ON r.event_id = c.event_id AND r.driver_id = c.driver_id AND r.position IS NOT NULL
JOIN {b_total} t ON t.event_id = c.event_id AND t.driver_id = c.driver_id
GROUP BY c.config_id, c.optimizer, c.sensitivity, c.event_id, c.event_date, c.season_id, c.season_year, c.round_no""",
}

_REF = re.compile(r"\{(\w+)\}")
_NAME = re.compile(r"\b[bo]_\w+\b")


def oracle_text(body: str) -> str:
    """Complete SQL for the oracle engine: needed views as CTEs in order, then ``body``."""
    from .oracle_views import VIEWS as ORACLE_VIEWS
    known = {**VIEWS, **ORACLE_VIEWS}
    body, needed, todo = body.strip(), set(), [n for n in _NAME.findall(body) if n in known]
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in _NAME.findall(known[n]) if m in known]
    ctes = [f"{n} AS ({_REF.sub(lambda m: m.group(1), t).strip()})" for n, t in known.items() if n in needed]
    head = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if head:
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[head.end():]])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


def _needs(name: str) -> set[str]:
    """All views below ``name``."""
    direct = {n for n in _REF.findall(VIEWS[name]) if n in VIEWS}
    return direct.union(*map(_needs, direct)) if direct else direct


_STAGED: dict[tuple[str, str, str], DataFrame] = {}
# event-grain inputs of the larger jobs, in dependency order
RACING = ("b_agg", "b_event", "b_driver", "b_spine", "b_rank", "b_result", "b_quali", "b_overtake", "b_score", "b_total", "b_ctotal", "b_price", "b_cprice", "b_pred")


class Bindings:
    """Lazy views over one data directory: ``v.b_result``, ``v.lineitem`` …"""

    def __init__(self, spark: SparkSession, sf_dir: str, whole: bool = False):
        self.spark, self.dir, self.whole, self._made = spark, sf_dir.rstrip("/"), whole, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._define(name)
        return self._made[name]

    def _define(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name == "b_overtake":
            # same rows as the SQL text, but no window over all laps of one driver
            return overtakes(self.b_racelap)
        return self.sql(unthinned(VIEWS[name]) if self.whole else VIEWS[name])

    def keep(self, name: str, make) -> DataFrame:
        """A derived table, written once per application and data directory."""
        key = (self.spark.sparkContext.applicationId, self.dir, f"{name}-whole" if self.whole else name)
        if key not in _STAGED:
            _STAGED[key] = stage(make(), name)
        return _STAGED[key]

    def stage(self, *names: str) -> "Bindings":
        """Use the named views as written tables; independent ones are written side by side."""
        todo = [n for n in VIEWS if n in names]
        while todo:
            ready = [n for n in todo if not _needs(n) & set(todo)]
            with ThreadPoolExecutor(4) as pool:
                tables = list(pool.map(lambda n: self.keep(n, lambda: self._define(n)), ready))
            self._made.update(zip(ready, tables))
            todo = [n for n in todo if n not in ready]
        return self

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(_REF.findall(text))})
