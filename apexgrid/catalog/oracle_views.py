"""Definition-form SQL of the feature columns, used by oracles only (range joins and row numbers)."""
CLEAN = "is_accurate AND lap_time IS NOT NULL AND NOT is_pit_in AND NOT is_pit_out"
RUN = f"{CLEAN} AND compound IS NOT NULL AND stint IS NOT NULL AND tyre_life IS NOT NULL"


def avg_rank(v: str, part: str = "event_id") -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL ELSE rank() OVER (PARTITION BY {part} ORDER BY {v} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2.0 END")


def rank_last(v: str) -> str:
    return (f"CASE WHEN count({v}) OVER (PARTITION BY event_id) = 0 THEN 10.0 WHEN {v} IS NULL THEN count({v}) OVER (PARTITION BY event_id) + 1.0 "
            f"ELSE 0.0 + row_number() OVER (PARTITION BY event_id ORDER BY {v} NULLS LAST, driver_id) END")


def team_mean(src: str) -> str:
    return f"""
WITH ev AS (SELECT team_id, team_code, season_year, event_id, event_date, avg(position) AS m FROM {src} WHERE position IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
cur AS (SELECT s.event_id, s.team_id, ev.m, row_number() OVER (PARTITION BY s.event_id, s.team_id ORDER BY ev.event_date DESC) AS rn
  FROM (SELECT DISTINCT event_id, team_id, event_date FROM b_spine) s JOIN ev ON ev.team_id = s.team_id AND ev.event_date < s.event_date),
c3 AS (SELECT event_id, team_id, avg(m) AS m FROM cur WHERE rn <= 3 GROUP BY 1, 2),
p3 AS (SELECT team_code, season_year + 1 AS season_year, avg(m) AS m FROM (SELECT *, row_number() OVER (PARTITION BY team_code, season_year ORDER BY event_date DESC) AS rn FROM ev) x WHERE rn <= 3 GROUP BY 1, 2)
SELECT s.event_id, s.team_id, coalesce(c3.m, p3.m, 18.0) AS m FROM (SELECT DISTINCT event_id, team_id, team_code, season_year FROM b_spine) s
LEFT JOIN c3 ON c3.event_id = s.event_id AND c3.team_id = s.team_id LEFT JOIN p3 ON p3.team_code = s.team_code AND p3.season_year = s.season_year"""


VIEWS = {
    "o_hr": """
SELECT s.event_id, s.driver_id, s.circuit_id AS target_circuit, r.circuit_id, r.position, r.grid_position, r.status, r.points, r.driver_id AS past_id, r.weekend_id,
  r.event_id AS past_event, r.event_date AS past_date,
  row_number() OVER (PARTITION BY s.event_id, s.driver_id ORDER BY r.event_date DESC) AS rn
FROM b_spine s JOIN b_result r ON r.code = s.code AND r.event_date < s.event_date""",
    "o_hq": """
SELECT s.event_id, s.driver_id, q.position, q.weekend_id, row_number() OVER (PARTITION BY s.event_id, s.driver_id ORDER BY q.event_date DESC) AS rn
FROM b_spine s JOIN b_quali q ON q.code = s.code AND q.event_date < s.event_date""",
    "o_hs": """
SELECT s.event_id, s.driver_id, t.race_total, row_number() OVER (PARTITION BY s.event_id, s.driver_id ORDER BY t.event_date DESC) AS rn
FROM b_spine s JOIN b_total t ON t.code = s.code AND t.event_date < s.event_date""",
    "o_form": """
SELECT s.event_id, s.driver_id,
  CASE WHEN max(h.rn) IS NULL THEN 18.0 ELSE coalesce(avg(CASE WHEN h.prn <= 3 THEN h.position END), 0) END AS position_mean_last3,
  CASE WHEN max(h.rn) IS NULL THEN 18.0 ELSE coalesce(avg(CASE WHEN h.prn <= 5 THEN h.position END), 0) END AS position_mean_last5,
  coalesce(stddev_samp(CASE WHEN h.prn <= 5 THEN h.position END), 0) AS position_std_last5,
  coalesce(avg(CASE WHEN h.rn IS NULL THEN NULL WHEN h.status = 'Finished' OR h.status LIKE '+%' THEN 0.0 ELSE 1.0 END), 0) AS dnf_rate_last10,
  coalesce(avg(CASE WHEN h.rn <= 5 THEN h.grid_position - h.position END), 0) AS positions_gained_mean_last5
FROM b_spine s LEFT JOIN (SELECT *, CASE WHEN position IS NOT NULL THEN row_number() OVER (PARTITION BY event_id, driver_id, position IS NULL ORDER BY rn) END AS prn
  FROM o_hr WHERE rn <= 10) h ON h.event_id = s.event_id AND h.driver_id = s.driver_id GROUP BY 1, 2""",
    "o_quali3": """
SELECT s.event_id, s.driver_id, coalesce(avg(h.position), 18.0) AS qualifying_position_mean_last3
FROM b_spine s LEFT JOIN o_hq h ON h.event_id = s.event_id AND h.driver_id = s.driver_id AND h.rn <= 3 GROUP BY 1, 2""",
    "o_circuit": """
SELECT s.event_id, s.driver_id, coalesce(avg(h.position), 10.0) AS circuit_position_mean_last3
FROM b_spine s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event_id, driver_id ORDER BY rn) AS crn FROM o_hr WHERE circuit_id = target_circuit) h
  ON h.event_id = s.event_id AND h.driver_id = s.driver_id AND h.crn <= 3 GROUP BY 1, 2""",
    "o_team_form": """
SELECT s.event_id, s.team_id, coalesce(avg(h.position), 10.0) AS team_position_mean_last5
FROM (SELECT DISTINCT event_id, team_id FROM b_spine) s LEFT JOIN (
  SELECT s.event_id, s.team_id, r.position, row_number() OVER (PARTITION BY s.event_id, s.team_id ORDER BY r.event_date DESC, r.driver_id) AS rn
  FROM (SELECT DISTINCT event_id, event_date, team_id FROM b_spine) s JOIN b_result r ON r.team_id = s.team_id AND r.event_date < s.event_date) h
ON h.event_id = s.event_id AND h.team_id = s.team_id AND h.rn <= 10 GROUP BY 1, 2""",
    "o_points": """
SELECT s.event_id, s.driver_id, coalesce(avg(CASE WHEN h.rn <= 3 THEN h.race_total END), 0) AS fantasy_points_mean_last3,
  coalesce(CASE WHEN count(CASE WHEN h.rn <= 5 THEN 1 END) >= 2 THEN regr_slope(CASE WHEN h.rn <= 5 THEN h.race_total END, -h.rn) END, 0) AS fantasy_points_trend_last5
FROM b_spine s LEFT JOIN o_hs h ON h.event_id = s.event_id AND h.driver_id = s.driver_id GROUP BY 1, 2""",
    "o_pace": f"""
SELECT event_id, driver_id, best, best5, {rank_last('best')} AS practice_best_lap_rank, {rank_last('best5')} AS practice_avg_best_5_rank FROM (
  SELECT s.event_id, s.driver_id, min(l.lap_time) AS best, avg(CASE WHEN l.rn <= 5 THEN l.lap_time END) AS best5
  FROM b_spine s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event_id, driver_id ORDER BY lap_time) AS rn FROM b_lap WHERE is_accurate AND lap_time IS NOT NULL) l
  ON l.event_id = s.event_id AND l.driver_id = s.driver_id GROUP BY 1, 2) x""",
    "o_context": """
SELECT event_id, driver_id, coalesce(circuit_length, 0.0) AS circuit_length, total_corners, round_no AS round_number,
  CASE WHEN event_format = 'sprint' THEN 1 ELSE 0 END AS is_sprint_weekend, coalesce(total_corners / circuit_length, 0.0) AS circuit_corner_density FROM b_spine""",
    "o_team_points": """
SELECT s.event_id, s.team_id, sum(r.points) AS pts FROM (SELECT DISTINCT event_id, event_date, team_id FROM b_spine) s
JOIN b_result r ON r.team_id = s.team_id AND r.event_date < s.event_date GROUP BY 1, 2""",
    "o_standing": """
SELECT s.event_id, s.team_id, coalesce(r.rk, 5.0) AS team_constructor_standing_rank FROM (SELECT DISTINCT event_id, team_id FROM b_spine) s
LEFT JOIN (SELECT event_id, team_id, row_number() OVER (PARTITION BY event_id ORDER BY pts DESC, team_id) AS rk FROM o_team_points) r
ON r.event_id = s.event_id AND r.team_id = s.team_id""",
    "o_down": """
WITH p AS (SELECT e.event_id, r.team_code, r.position, pe.total_corners / pe.circuit_length AS dens
  FROM b_event e JOIN b_result r ON r.series = e.series AND r.season_year IN (e.season_year, e.season_year - 1) AND r.event_date < e.event_date AND r.position IS NOT NULL
  JOIN b_event pe ON pe.event_id = r.event_id AND pe.circuit_length IS NOT NULL AND pe.total_corners IS NOT NULL),
m AS (SELECT event_id, median(dens) AS med FROM p GROUP BY 1)
SELECT p.event_id, p.team_code, coalesce(avg(CASE WHEN dens < med THEN position END), 10.0) AS team_low_df_avg_pos,
  coalesce(avg(CASE WHEN dens >= med THEN position END), 10.0) AS team_high_df_avg_pos FROM p JOIN m ON m.event_id = p.event_id GROUP BY 1, 2""",
    "o_mate": """
SELECT driver_id, team_id, mate_id FROM (SELECT a.driver_id, a.team_id, b.driver_id AS mate_id, row_number() OVER (PARTITION BY a.driver_id ORDER BY b.driver_id) AS rn
FROM b_driver a JOIN b_driver b ON b.team_id = a.team_id AND b.driver_id <> a.driver_id) x WHERE rn = 1""",
    "o_gap": """
WITH own AS (SELECT h.*, row_number() OVER (PARTITION BY event_id, driver_id ORDER BY rn) AS k FROM o_hr h WHERE past_id = driver_id AND position IS NOT NULL),
sh AS (SELECT o.event_id, o.driver_id, o.position, r.position AS mate_pos, row_number() OVER (PARTITION BY o.event_id, o.driver_id ORDER BY o.k) AS sk
  FROM own o JOIN o_mate m ON m.driver_id = o.driver_id JOIN b_result r ON r.driver_id = m.mate_id AND r.event_id = o.past_event AND r.position IS NOT NULL WHERE o.k <= 20)
SELECT s.event_id, s.driver_id, coalesce(avg(sh.mate_pos) - avg(sh.position), 0.0) AS driver_vs_teammate_gap_last5
FROM b_spine s LEFT JOIN sh ON sh.event_id = s.event_id AND sh.driver_id = s.driver_id AND sh.sk <= 5 GROUP BY 1, 2""",
    "o_signal": """
SELECT s.event_id, s.driver_id, coalesce(p.pick_percentage, 0) AS pick_percentage, coalesce(p.price_change, 0) AS price_change_last_race
FROM b_spine s ASOF LEFT JOIN b_price p ON p.code = s.code AND p.event_date <= s.event_date""",
    "o_weather": """
WITH w AS (SELECT DISTINCT weekend_id, circuit_id, event_date FROM b_spine),
fp AS (SELECT weekend_id, max(CASE WHEN rainfall THEN 1.0 ELSE 0.0 END) AS any_rain, avg(CASE WHEN rainfall THEN 1.0 ELSE 0.0 END) AS frac, avg(track_temp) AS track, avg(air_temp) AS air
  FROM b_weather WHERE session_type IN ('FP1', 'FP2', 'FP3') GROUP BY 1),
ev AS (SELECT weekend_id, circuit_id, event_date, max(CASE WHEN rainfall THEN 1.0 ELSE 0.0 END) AS any_rain, sum(track_temp) AS st, count(*) AS n FROM b_weather GROUP BY 1, 2, 3),
past AS (SELECT w.weekend_id, avg(ev.any_rain) AS rate, sum(ev.st) / sum(ev.n) AS mean FROM w JOIN ev ON ev.circuit_id = w.circuit_id AND ev.event_date < w.event_date GROUP BY 1)
SELECT w.weekend_id, coalesce(fp.any_rain, 0) AS weather_practice_rainfall, coalesce(fp.track, 0) AS weather_track_temp_mean, coalesce(fp.frac, 0) AS weather_practice_rain_fraction,
  coalesce(past.rate, 0) AS circuit_historical_rain_rate, coalesce(fp.track - past.mean, 0) AS track_temp_deviation_from_circuit_mean, coalesce(fp.air, 0) AS weather_air_temp_mean
FROM w LEFT JOIN fp ON fp.weekend_id = w.weekend_id LEFT JOIN past ON past.weekend_id = w.weekend_id""",
    "o_wet": """
WITH rain AS (SELECT DISTINCT weekend_id, session_type FROM b_weather WHERE rainfall AND session_type IN ('Q', 'R')),
r AS (SELECT h.event_id, h.driver_id, count(*) AS starts, count(w.weekend_id) AS wet_starts,
    avg(CASE WHEN w.weekend_id IS NOT NULL THEN h.position END) AS wm, avg(CASE WHEN w.weekend_id IS NULL THEN h.position END) AS dm,
    count(CASE WHEN w.weekend_id IS NOT NULL THEN h.position END) AS wn, count(CASE WHEN w.weekend_id IS NULL THEN h.position END) AS dn
  FROM o_hr h LEFT JOIN rain w ON w.weekend_id = h.weekend_id AND w.session_type = 'R' GROUP BY 1, 2),
q AS (SELECT h.event_id, h.driver_id, count(w.weekend_id) AS wet_starts FROM o_hq h LEFT JOIN rain w ON w.weekend_id = h.weekend_id AND w.session_type = 'Q' GROUP BY 1, 2)
SELECT s.event_id, s.driver_id, coalesce(r.starts, 0) AS driver_races, coalesce(r.wet_starts, 0) + coalesce(q.wet_starts, 0) AS driver_wet_session_count,
  CASE WHEN coalesce(wn, 0) < 3 THEN 2.0 WHEN dn < 3 THEN 0.0 ELSE wm - dm END AS driver_wet_vs_dry_position_delta
FROM b_spine s LEFT JOIN r ON r.event_id = s.event_id AND r.driver_id = s.driver_id LEFT JOIN q ON q.event_id = s.event_id AND q.driver_id = s.driver_id""",
    "o_team_race3": team_mean("b_result"),
    "o_team_quali3": team_mean("b_quali"),
    "o_title": """
WITH cur AS (SELECT event_id, driver_id, sum(points) AS pts FROM o_hr WHERE past_id = driver_id GROUP BY 1, 2),
prev AS (SELECT code, season_year + 1 AS season_year, sum(points) AS pts FROM b_result GROUP BY 1, 2),
x AS (SELECT s.event_id, s.driver_id, s.code, cur.pts AS c, CASE WHEN cur.driver_id IS NULL THEN prev.pts END AS p
  FROM b_spine s LEFT JOIN cur ON cur.event_id = s.event_id AND cur.driver_id = s.driver_id LEFT JOIN prev ON prev.code = s.code AND prev.season_year = s.season_year)
SELECT event_id, driver_id, CASE WHEN c IS NOT NULL THEN row_number() OVER (PARTITION BY event_id, c IS NULL ORDER BY c DESC, code)
  WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY event_id, p IS NULL ORDER BY p DESC, code) ELSE 20 END AS title_rank FROM x""",
    "o_title_gap": """
SELECT s.event_id, s.driver_id, coalesce(a.title_rank - b.title_rank, 0) AS driver_vs_teammate_championship_gap
FROM b_spine s LEFT JOIN o_mate m ON m.driver_id = s.driver_id JOIN o_title a ON a.event_id = s.event_id AND a.driver_id = s.driver_id
LEFT JOIN o_title b ON b.event_id = s.event_id AND b.driver_id = m.mate_id""",
    "o_last5": """
WITH r AS (SELECT event_id, driver_id, rn, CASE WHEN position IS NULL OR NOT (status = 'Finished' OR status LIKE '+%') THEN 20.0 ELSE position END AS p FROM o_hr WHERE rn <= 5),
q AS (SELECT event_id, driver_id, rn, coalesce(position, 20.0) AS p FROM o_hq WHERE rn <= 5),
ra AS (SELECT event_id, driver_id, max(CASE WHEN rn = 1 THEN p END) AS last1, min(p) AS best, CASE WHEN count(*) < 2 THEN 0.0 ELSE regr_slope(p, -rn) END AS slope FROM r GROUP BY 1, 2),
qa AS (SELECT event_id, driver_id, max(CASE WHEN rn = 1 THEN p END) AS last1, CASE WHEN count(*) < 2 THEN 0.0 ELSE regr_slope(p, -rn) END AS slope FROM q GROUP BY 1, 2)
SELECT s.event_id, s.driver_id, s.team_id, coalesce(ra.last1, 18) AS position_last1, coalesce(ra.slope, 0) AS position_slope, coalesce(ra.best, 18) AS best_position_last5,
  coalesce(min(ra.best) OVER (PARTITION BY s.event_id, s.team_id), 18) AS team_best_position,
  coalesce(qa.last1, 18) AS quali_last1, coalesce(qa.slope, 0) AS quali_slope, count(*) OVER (PARTITION BY s.event_id, s.team_id) AS crew
FROM b_spine s LEFT JOIN ra ON ra.event_id = s.event_id AND ra.driver_id = s.driver_id LEFT JOIN qa ON qa.event_id = s.event_id AND qa.driver_id = s.driver_id""",
    "o_last5_team": """
SELECT a.*, CASE WHEN a.crew = 2 THEN a.position_last1 - b.position_last1 ELSE 0 END AS teammate_delta
FROM o_last5 a LEFT JOIN o_mate m ON m.driver_id = a.driver_id LEFT JOIN o_last5 b ON b.event_id = a.event_id AND b.driver_id = m.mate_id""",
    "o_runs": f"""
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY event_id, driver_id, session_type, stint, compound) AS stint_n FROM b_lap WHERE {RUN}) z WHERE stint_n >= 5""",
    "o_fp": f"""
WITH n AS (SELECT event_id, count(*) AS field FROM b_spine GROUP BY 1),
ch AS (SELECT n.event_id, coalesce(x.c, 0) * 2 >= n.field AS fp2_only FROM n LEFT JOIN (SELECT event_id, count(DISTINCT driver_id) AS c FROM o_runs WHERE session_type = 'FP2' GROUP BY 1) x ON x.event_id = n.event_id),
med AS (SELECT r.event_id, r.driver_id, median(r.lap_time) AS pace FROM o_runs r JOIN ch ON ch.event_id = r.event_id
  WHERE r.session_type = 'FP2' OR (r.session_type = 'FP1' AND NOT ch.fp2_only) GROUP BY 1, 2),
sl AS (SELECT event_id, driver_id, avg(k) AS deg FROM (SELECT event_id, driver_id, stint, compound,
    CASE WHEN min(tyre_life) < max(tyre_life) THEN regr_slope(lap_time, tyre_life) END AS k FROM o_runs WHERE session_type = 'FP2' GROUP BY 1, 2, 3, 4) y GROUP BY 1, 2),
sec AS (SELECT event_id, driver_id, min(sector1) AS s1, min(sector2) AS s2, min(sector3) AS s3, count(*) AS laps FROM b_lap WHERE {CLEAN} GROUP BY 1, 2),
j AS (SELECT s.event_id, s.driver_id, med.pace, sl.deg, sec.s1, sec.s2, sec.s3, sec.laps FROM b_spine s
  LEFT JOIN med ON med.event_id = s.event_id AND med.driver_id = s.driver_id LEFT JOIN sl ON sl.event_id = s.event_id AND sl.driver_id = s.driver_id
  LEFT JOIN sec ON sec.event_id = s.event_id AND sec.driver_id = s.driver_id)
SELECT event_id, driver_id, pace, deg, coalesce({avg_rank('pace')}, 10.5) AS fp_long_run_pace_rank, coalesce({avg_rank('deg')}, 10.5) AS fp_tyre_deg_rank,
  coalesce({avg_rank('s1')}, 10.5) AS fp_sector1_rank, coalesce({avg_rank('s2')}, 10.5) AS fp_sector2_rank, coalesce({avg_rank('s3')}, 10.5) AS fp_sector3_rank,
  coalesce(laps, 0) AS fp_total_laps FROM j""",
    "o_avail": "SELECT event_id, count(DISTINCT session_type) AS fp_session_availability FROM b_session WHERE session_type IN ('FP1', 'FP2', 'FP3') GROUP BY 1",
    "o_all": f"""
SELECT s.event_id, s.driver_id, f.position_mean_last3, f.position_mean_last5, f.position_std_last5, f.dnf_rate_last10, f.positions_gained_mean_last5,
  q3.qualifying_position_mean_last3, ci.circuit_position_mean_last3, tf.team_position_mean_last5, po.fantasy_points_mean_last3, po.fantasy_points_trend_last5,
  pa.practice_best_lap_rank, pa.practice_avg_best_5_rank, cx.circuit_length, cx.total_corners, cx.round_number, cx.is_sprint_weekend, cx.circuit_corner_density,
  st.team_constructor_standing_rank, coalesce(dn.team_low_df_avg_pos, 10) AS team_low_df_avg_pos, coalesce(dn.team_high_df_avg_pos, 10) AS team_high_df_avg_pos,
  g.driver_vs_teammate_gap_last5, sg.pick_percentage, sg.price_change_last_race, we.weather_practice_rainfall, we.weather_track_temp_mean,
  we.weather_practice_rain_fraction, we.circuit_historical_rain_rate, we.track_temp_deviation_from_circuit_mean, we.weather_air_temp_mean,
  wt.driver_wet_vs_dry_position_delta, wt.driver_races, wt.driver_wet_session_count, tq.m AS team_qualifying_position_mean_last3, tr.m AS team_recent_finish_mean_last3,
  tg.driver_vs_teammate_championship_gap, l5.position_last1, l5.position_slope, l5.best_position_last5, l5.teammate_delta, l5.team_best_position, l5.quali_last1, l5.quali_slope,
  fp.fp_long_run_pace_rank, fp.fp_tyre_deg_rank, fp.fp_sector1_rank, fp.fp_sector2_rank, fp.fp_sector3_rank, fp.fp_total_laps, coalesce(av.fp_session_availability, 0) AS fp_session_availability,
  pa.practice_best_lap_rank - fp.fp_long_run_pace_rank AS fp_short_vs_long_delta, CASE WHEN we.weather_practice_rain_fraction > 0 THEN 1 ELSE 0 END AS practice_rainfall_any,
  rank() OVER (PARTITION BY s.event_id ORDER BY wt.driver_wet_vs_dry_position_delta) + (count(*) OVER (PARTITION BY s.event_id, wt.driver_wet_vs_dry_position_delta) - 1) / 2.0 AS driver_wet_performance_rank,
  coalesce(qp.position, 10.5) AS qualifying_position
FROM b_spine s JOIN o_form f ON f.event_id = s.event_id AND f.driver_id = s.driver_id JOIN o_quali3 q3 ON q3.event_id = s.event_id AND q3.driver_id = s.driver_id
JOIN o_circuit ci ON ci.event_id = s.event_id AND ci.driver_id = s.driver_id JOIN o_team_form tf ON tf.event_id = s.event_id AND tf.team_id = s.team_id
JOIN o_points po ON po.event_id = s.event_id AND po.driver_id = s.driver_id JOIN o_pace pa ON pa.event_id = s.event_id AND pa.driver_id = s.driver_id
JOIN o_context cx ON cx.event_id = s.event_id AND cx.driver_id = s.driver_id JOIN o_standing st ON st.event_id = s.event_id AND st.team_id = s.team_id
LEFT JOIN o_down dn ON dn.event_id = s.event_id AND dn.team_code = s.team_code JOIN o_gap g ON g.event_id = s.event_id AND g.driver_id = s.driver_id
JOIN o_signal sg ON sg.event_id = s.event_id AND sg.driver_id = s.driver_id JOIN o_weather we ON we.weekend_id = s.weekend_id
JOIN o_wet wt ON wt.event_id = s.event_id AND wt.driver_id = s.driver_id JOIN o_team_quali3 tq ON tq.event_id = s.event_id AND tq.team_id = s.team_id
JOIN o_team_race3 tr ON tr.event_id = s.event_id AND tr.team_id = s.team_id JOIN o_title_gap tg ON tg.event_id = s.event_id AND tg.driver_id = s.driver_id
JOIN o_last5_team l5 ON l5.event_id = s.event_id AND l5.driver_id = s.driver_id JOIN o_fp fp ON fp.event_id = s.event_id AND fp.driver_id = s.driver_id
LEFT JOIN o_avail av ON av.event_id = s.event_id LEFT JOIN b_quali qp ON qp.event_id = s.event_id AND qp.driver_id = s.driver_id""",
}
