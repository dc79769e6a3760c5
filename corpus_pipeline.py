"""Training-data pipeline over ``documents``: five stages, each written to the shared folder and read back.

All stages but the last return the columns of ``documents``, further columns included, whatever their names.

Defined cases: null and empty texts pass every stage and are packed as their end token; rows without an id stay; rows that repeat both id and
text are one after the third stage, rows that share an id only all stay; an empty table gives no pieces; very long texts are taken whole. Ties are
those of the operators: the smaller id stays.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from apexgrid.llm.catalog import table
from apexgrid.llm.decontaminate import decontaminated
from apexgrid.llm.jaccard_join import jaccard_components
from apexgrid.llm.line_dedup import without_repeated_lines
from apexgrid.llm.quality import classify
from apexgrid.llm.queries import packed
from apexgrid.session import BATCH_ROWS, stage


def _small_batches(spark: SparkSession) -> None:
    """For the session, as a stage's plan is executed by its caller."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    _small_batches(spark)
    return classify(docs, table(spark, sf_dir, "labels")).filter("keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has."""
    _small_batches(spark)
    return without_repeated_lines(docs, exact_words=1)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; rows without an id stay, and different texts of one id."""
    _small_batches(spark)
    first = stage(jaccard_components(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct(), "first")
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("hash"))
    kept = rows.join(first, F.col("own") == F.col("first"), "left_semi").dropDuplicates(["own", "hash"])
    return kept.select(*[F.col("whole")[c].alias(c) for c in docs.columns]).union(docs.filter("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    _small_batches(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their training sequences."""
    _small_batches(spark)
    return packed(docs)


STAGES = [(f.__name__, f) for f in (quality_classifier, line_dedup, ngram_jaccard_join, benchmark_decontamination, packing)]

#: The classifier, the components and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
