"""DDL of the stored tables (natural or per-season keys; one row per key)."""

TABLES = {
    "season": ("year", "year INT"),
    "circuit": ("circuit_key", "circuit_key STRING, name STRING, country STRING, city STRING, circuit_length DOUBLE, total_corners INT"),
    "team": ("season_id, name", "team_id BIGINT, season_id BIGINT, name STRING, full_name STRING, code STRING"),
    "driver": ("season_id, code", "driver_id BIGINT, season_id BIGINT, code STRING, full_name STRING, driver_number INT, team_id BIGINT"),
    "event": ("season_id, round_no", "event_id BIGINT, season_id BIGINT, round_no INT, event_name STRING, country STRING, circuit_id STRING, event_date DATE, event_format STRING"),
    "session": ("event_id, session_type", "session_id BIGINT, event_id BIGINT, session_type STRING, date TIMESTAMP"),
    "session_result": ("session_id, driver_id", "session_id BIGINT, driver_id BIGINT, team_id BIGINT, position INT, classified_position STRING, grid_position INT, status STRING, points DOUBLE, time DOUBLE, fastest_lap_rank INT"),
    "lap": ("session_id, driver_id, lap_number", "session_id BIGINT, driver_id BIGINT, lap_number INT, lap_time DOUBLE, sector1 DOUBLE, sector2 DOUBLE, sector3 DOUBLE, pit_in DOUBLE, pit_out DOUBLE, is_pit_in BOOLEAN, is_pit_out BOOLEAN, stint INT, compound STRING, tyre_life INT, track_status STRING, position INT, is_personal_best BOOLEAN, is_accurate BOOLEAN"),
    "weather_sample": ("session_id, timestamp", "session_id BIGINT, timestamp TIMESTAMP, air_temp DOUBLE, track_temp DOUBLE, humidity DOUBLE, pressure DOUBLE, wind_speed DOUBLE, wind_direction INT, rainfall BOOLEAN"),
    "collection_run": ("run_id", "run_id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, sessions_processed INT, sessions_skipped INT, error_message STRING"),
    "session_collection_status": ("session_id", "session_id BIGINT, status STRING, collected_at TIMESTAMP, lap_count INT, weather_sample_count INT, result_count INT, error_message STRING, retry_count INT"),
    "fantasy_driver_price": ("driver_id, event_id", "driver_id BIGINT, event_id BIGINT, snapshot_date DATE, price DECIMAL(5,1), price_change DECIMAL(4,1), pick_percentage DOUBLE, season_points INT"),
    "fantasy_constructor_price": ("team_id, event_id", "team_id BIGINT, event_id BIGINT, snapshot_date DATE, price DECIMAL(5,1), price_change DECIMAL(4,1), pick_percentage DOUBLE, season_points INT"),
    "fantasy_driver_score": ("driver_id, event_id, event_type, scoring_item", "driver_id BIGINT, event_id BIGINT, event_type STRING, scoring_item STRING, frequency INT, position INT, points INT, race_total INT, season_total INT, source STRING"),
    "fantasy_constructor_score": ("team_id, event_id, event_type, scoring_item", "team_id BIGINT, event_id BIGINT, event_type STRING, scoring_item STRING, frequency INT, position INT, points INT, race_total INT, season_total INT, source STRING"),
    "race_prediction": ("event_id, driver_id, model_version", "event_id BIGINT, driver_id BIGINT, model_version STRING, predicted_position DOUBLE, predicted_points DOUBLE, lower DOUBLE, upper DOUBLE, actual_position INT, actual_points DOUBLE, created_at TIMESTAMP"),
    "lineup_recommendation": ("event_id, strategy, model_version", "event_id BIGINT, strategy STRING, model_version STRING, driver_ids ARRAY<BIGINT>, team_ids ARRAY<BIGINT>, boost_id BIGINT, total_cost DECIMAL(6,1), predicted_points DOUBLE, actual_points DOUBLE, oracle_points DOUBLE, created_at TIMESTAMP"),
    "backtest_run": ("run_id", "run_id BIGINT, feature_version STRING, model_version STRING, optimizer STRING, seasons STRING, min_train INT, budget DOUBLE, price_sensitivity DOUBLE, created_at TIMESTAMP, mae_position DOUBLE, mae_points DOUBLE, lineup_actual DOUBLE, optimal_actual DOUBLE"),
    "backtest_race_result": ("run_id, event_id", "run_id BIGINT, event_id BIGINT, n_train INT, mae_position DOUBLE, mae_points DOUBLE, lineup_predicted DOUBLE, lineup_actual DOUBLE, optimal_actual DOUBLE, n_transfers INT"),
    "my_lineup": ("event_id", "event_id BIGINT, driver_ids ARRAY<BIGINT>, team_ids ARRAY<BIGINT>, boost_id BIGINT, team_cost DECIMAL(6,1), budget_cap DECIMAL(6,1), actual_points DOUBLE, submitted_at TIMESTAMP"),
}


def key_of(table: str) -> list[str]:
    return [c.strip() for c in TABLES[table][0].split(",")]


def ddl_of(table: str) -> str:
    return TABLES[table][1]
