"""Incremental ingest of a drop folder: each file is parsed once, by its own header, and its rows are merged by key."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import PRICE_COLUMNS, SCORE_COLUMNS, by_header, csv_lines, type_prices, type_scores
from ..sources.sinks import upsert

#: Header columns, typing, key and partition column of the four kinds of files.
_PRICES = (PRICE_COLUMNS, type_prices, ["name", "snapshot_date"], "snapshot_date")
_SCORES = (SCORE_COLUMNS, type_scores, ["season_year", "name", "race", "event_type", "scoring_item"], "season_year")
KIND_RULES = {"driver_price": _PRICES, "constructor_price": _PRICES, "driver_score": _SCORES, "constructor_score": _SCORES}


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, kind: str = "driver_price", files_per_batch: int = 1000,
           merged: Callable[[int], None] | None = None) -> None:
    """Take in all files of one kind not seen before, then stop. Merging by key makes a repeated batch harmless.

    ``merged`` is called with a batch's number once its rows are in the table; if it fails, the batch is not committed and comes again.

    The stream carries lines; a file is never split between batches, so a batch holds the headers of its own lines.
    """
    columns, typed, key, by = KIND_RULES[kind]

    def merge(batch: DataFrame, number: int) -> None:
        upsert(spark, table, typed(by_header(batch, columns), "delivered_at"), key, by=by, order="delivered_at")
        if merged is not None:
            merged(number)

    lines = csv_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch), folder, kind)
    lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
