"""Queries that write the tables as landed files and read them back: scans, routing and the drop-folder stream."""
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import scoring as SC
from ..session import shared_folder
from ..sources import export as X, files as FI
from ..streaming.ingest import ingest
from .registry import query
from .scores_prices import _CITEMS, _TEAM

# two headers of each kind: columns differ in order, and one has no team
PRICE_LAYOUTS = (["% Picked", "Current Value", "Driver Name", "Constructor Name", "Price Change", "Season Points", "Team"],
                 ["Driver Name", "Constructor Name", "Season Points", "Price Change", "Current Value", "% Picked"])
SCORE_LAYOUTS = (["Driver Name", "Constructor Name", "Team", "Race", "Event Type", "Scoring Item", "Frequency", "Position", "Points", "Race Total", "Season Total"],
                 ["Race", "Scoring Item", "Event Type", "Points", "Position", "Frequency", "Constructor Name", "Driver Name"])
FILES_PER_BATCH = 12


def _folder(v, name: str) -> str:
    return f"{shared_folder(v.spark)}/landed/{name}-{uuid.uuid4().hex}"


def _prices(v, kind: str):
    no = lambda t: F.lit(None).cast(t)
    if kind == "driver_price":
        return v.b_price.select(F.col("event_date").alias("snapshot_date"), "round_no", F.concat(F.lit('Driver, "D" '), F.col("code")).alias("name"), F.col("team_code").alias("team"), "price",
                                "price_change", "pick_percentage", F.col("code").cast("bigint").alias("season_points"))
    return v.b_cprice.select(F.col("event_date").alias("snapshot_date"), "round_no", F.concat(F.lit("T"), F.col("team_id")).alias("name"), no("string").alias("team"), "price",
                             no("decimal(4,1)").alias("price_change"), no("double").alias("pick_percentage"), no("bigint").alias("season_points"))


def _scores(v, kind: str):
    """Scoring items, delivered once a season."""
    no = lambda t: F.lit(None).cast(t)
    if kind == "driver_score":
        v.stage("b_agg", "b_rank", "b_score")
        rows = v.b_score.select("event_id", "event_type", "scoring_item", "points", F.concat(F.lit("D"), F.col("driver_id")).alias("name"))
    else:
        v.stage("b_agg", "b_rank")
        def scored():
            items = SC.driver_items(v.b_results_all, v.b_racelap, ["event_id", "season_id", "round_no", "driver_id", "code", "team_id"])
            return SC.constructor_items(items, v.b_results_all, _TEAM).select("event_id", "event_type", "scoring_item", "points", F.concat(F.lit("T"), F.col("team_id")).alias("name"))

        rows = v.keep("constructor-items", scored)  # written once: each delivery and header would score all laps again
    return rows.join(v.b_event.select("event_id", "round_no", "season_year"), "event_id").select(
        F.make_date(F.col("season_year").cast("int"), F.lit(12), F.lit(31)).alias("delivered"), "round_no", "name", no("string").alias("team"), F.concat(F.lit("E"), F.col("event_id")).alias("race"),
        "event_type", "scoring_item", no("int").alias("frequency"), no("int").alias("position"), "points", no("int").alias("race_total"), no("int").alias("season_total"))


def _delivered(v, kind: str, root: str, rows) -> str:
    """Rows as files, odd and even rounds under different headers."""
    write, layouts = (X.write_price_files, PRICE_LAYOUTS) if kind.endswith("price") else (X.write_score_files, SCORE_LAYOUTS)
    for k, layout in enumerate(layouts):
        write(rows.where(F.col("round_no") % 2 == k), root, kind, layout)
    return root


_PRICE_SQL = {
    "driver_price": """SELECT cast(event_date AS varchar) AS snapshot_date, season_year, concat('Driver, "D" ', code) AS name, CASE WHEN round_no % 2 = 0 THEN team_code END AS team,
price, price_change, pick_percentage, code AS season_points, concat(cast(event_date AS varchar), '-drivers.csv') AS file_name FROM b_price""",
    "constructor_price": """SELECT cast(event_date AS varchar) AS snapshot_date, season_year, concat('T', team_id) AS name, cast(NULL AS varchar) AS team, price, cast(NULL AS double) AS price_change,
cast(NULL AS double) AS pick_percentage, cast(NULL AS bigint) AS season_points, concat(cast(event_date AS varchar), '-constructors.csv') AS file_name FROM b_cprice"""}
_SCORE_SQL = {
    "driver_score": """SELECT e.season_year, concat('D', s.driver_id) AS name, concat('E', s.event_id) AS race, s.event_type, s.scoring_item, s.points,
concat(e.season_year, '-12-31-all-drivers-performance.csv') AS file_name FROM b_score s JOIN b_event e ON e.event_id = s.event_id""",
    "constructor_score": f"""SELECT e.season_year, concat('T', s.team_id) AS name, concat('E', s.event_id) AS race, s.event_type, s.scoring_item, s.points,
concat(e.season_year, '-12-31-all-constructors-performance.csv') AS file_name FROM ({_CITEMS}) s JOIN b_event e ON e.event_id = s.event_id"""}
_PRICE_OUT = ["snapshot_date", "season_year", "name", "team", "price", "price_change", "pick_percentage", "season_points", "file_name"]
_SCORE_OUT = ["season_year", "name", "race", "event_type", "scoring_item", "points", "file_name"]
_TYPES = {"price": {"d": "price price_change pick_percentage", "i": "season_year season_points"}, "score": {"i": "season_year points"}}

for _kind, _sql in {**_PRICE_SQL, **_SCORE_SQL}.items():
    _src = "src01" if _kind in _PRICE_SQL else "src02"
    _out = _PRICE_OUT if _kind in _PRICE_SQL else _SCORE_OUT
    _t = _TYPES[_kind.split("_")[1]]

    @query(f"{_src}_{_kind}_scan", _sql, **_t)
    def _(v, kind=_kind, out=_out):
        prices = kind in _PRICE_SQL
        root = _delivered(v, kind, _folder(v, kind), (_prices if prices else _scores)(v, kind))
        return (FI.price_snapshots if prices else FI.score_lines)(v.spark, root, kind).select(*out)

    # two deliveries, the second repeats the first; the stream fails after a batch is merged and before it is committed
    @query(f"str01_{_kind}_ingest", _sql, **_t)
    def _(v, kind=_kind, out=_out):
        rows, root = (_prices if kind in _PRICE_SQL else _scores)(v, kind), _folder(v, f"{kind}-drop")
        table, mark = f"{root}-table", f"{root}-checkpoint"
        failed = []

        def fail_once(number: int) -> None:
            if not failed:
                failed.append(number)
                raise RuntimeError("between batches")

        take = lambda **also: ingest(v.spark, root, table, mark, kind, FILES_PER_BATCH, **also)
        _delivered(v, kind, root, rows.where("round_no <= 2"))
        try:
            take(merged=fail_once)
        except StreamingQueryException:
            take()
        _delivered(v, kind, root, rows)
        take()
        return v.spark.read.parquet(table).select(*out)


@query("src03_starting_prices", "SELECT cast(driver_id AS varchar) AS key, price FROM b_price WHERE round_no = 1", d="price")
def _(v):
    path = _folder(v, "starting")
    X.write_starting_prices(v.b_price.where("round_no = 1").select(F.col("driver_id").cast("string").alias("key"), "price"), path)
    return FI.starting_prices(v.spark, path)


_ROSTER = "concat('Team ', team_code)"


def _rosters(v):
    path = _folder(v, "rosters")
    label = F.expr(_ROSTER)
    X.write_rosters(v.b_team.select(F.col("season_id").cast("int").alias("season"), label.alias("name"), F.col("team_code").alias("code")),
                    v.b_driver.select(F.col("season_id").cast("int").alias("season"), F.concat(F.lit("D"), F.col("driver_id")).alias("code"), F.concat(F.lit("Driver "), F.col("code")).alias("full_name"),
                                      F.col("code").cast("int").alias("driver_number"), label.alias("team")), path)
    return FI.roster(v.spark, path)


@query("src04_roster_teams", f"SELECT season_id AS season, {_ROSTER} AS label, {_ROSTER} AS name, team_code AS code FROM b_team", i="season")
def _(v):
    return _rosters(v)[0]


@query("src04_roster_drivers", f"SELECT season_id AS season, concat('D', driver_id) AS code, concat('Driver ', code) AS full_name, code AS driver_number, {_ROSTER} AS team_label FROM b_driver", i="season driver_number")
def _(v):
    return _rosters(v)[1]


@query("src05_routing", """SELECT DISTINCT concat(cast(event_date AS varchar), '-drivers.csv') AS file_name, 'driver_price' AS kind FROM b_price
UNION ALL SELECT DISTINCT concat(cast(event_date AS varchar), '-constructors.csv'), 'constructor_price' FROM b_cprice
UNION ALL SELECT DISTINCT concat(e.season_year, '-12-31-all-drivers-performance.csv'), 'driver_score' FROM b_score s JOIN b_event e ON e.event_id = s.event_id
UNION ALL SELECT DISTINCT concat(cast(event_date AS varchar), '-notes.csv'), NULL FROM b_event""")
def _(v):
    root = _folder(v, "mixed")
    for kind, rows in (("driver_price", _prices(v, "driver_price")), ("constructor_price", _prices(v, "constructor_price")), ("driver_score", _scores(v, "driver_score"))):
        _delivered(v, kind, f"{root}/{kind}", rows)
    X.write_files(v.b_event, f"{root}/other", F.concat(F.col("event_date").cast("date").cast("string"), F.lit("-notes.csv")), [("a", F.col("event_id"))])
    return FI.listing(v.spark, root).select("file_name", "kind").distinct()
