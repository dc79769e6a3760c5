"""License scan by diagonal voting. DataFrame functions only.

Every window of ``K`` words of every text is hashed and joined with the window positions of the templates. A match votes for
the diagonal ``place in the text - place in the template``: a template that stands in the text puts all its votes on one
diagonal, words put in or left out move the rest to a neighbouring one. Votes are summed by diagonal, neighbouring
diagonals merged, and a merged span is accepted when its windows, compared word by word, cover enough of the template and it is not
much longer than that.

Phrases (``PHRASES``) must stand word by word: all their windows on one diagonal. Templates (``TEMPLATES``) add labels.
Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Defined cases: null and empty texts have no words, no labels and score 0; rows that repeat both id and text get equal results;
rows without an id are scanned too; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 3
#: Diagonals this near are one span; share of a template's windows that a span must have; longest span against its template.
SHIFT, COVERAGE, STRETCH = 3, 0.6, 1.5
#: Templates under this many words must be covered fully.
SHORT = 12
# fixed values: phrases and labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# fixed values: characteristic sentences of public licenses
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license as published by the free software foundation": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
}
_KEY = ("doc_id", "row")


def words_of(text: Column) -> Column:
    """Words of a text. The Kelvin sign is set aside, as it is the one other character whose lower case is an ASCII letter."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _grams(words: str) -> Column:
    """Hashes of all windows of K words."""
    at = ", ".join(f"element_at({words}, i + {j})" for j in range(K))
    return F.expr(f"if(size({words}) < {K}, array(), transform(sequence(1, size({words}) - {K - 1}), i -> xxhash64({at})))").cast("array<bigint>")


def _templates(spark) -> DataFrame:
    """(gram, template, base, label, at, size, said): every window of every template. A few hundred rows, fixed."""
    rows = [(k, base, label, text.split()) for k, (base, label, text) in
            enumerate([(True, lb, t) for t, lb in PHRASES.items()] + [(False, lb, t) for t, lb in TEMPLATES.items()])]
    df = spark.createDataFrame(rows, "template int, base boolean, label string, tw array<string>")
    return df.withColumn("g", _grams("tw")).select("template", "base", "label", F.size("g").alias("size"), "tw", F.posexplode("g").alias("at", "gram")) \
        .withColumn("said", F.slice("tw", F.col("at") + 1, K)).drop("tw")


def license_votes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, template, base, label, size, diagonal, votes, lo, hi): places of the votes of each diagonal."""
    # outer: else the optimizer would test the size of the exploded array in a filter, and build it there once more
    grams = docs.select("doc_id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("w")).withColumn("g", _grams("w")) \
        .select(*_KEY, "w", F.posexplode_outer("g").alias("place", "gram"))
    return grams.join(F.broadcast(_templates(docs.sparkSession)), "gram").filter(F.slice("w", F.col("place") + 1, K) == F.col("said")) \
        .select(*_KEY, "template", "base", "label", "size", (F.col("place") - F.col("at")).alias("diagonal"), "at") \
        .groupBy(*_KEY, "template", "base", "label", "size", "diagonal").agg(F.collect_set("at").alias("votes"))


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, label, first_word, n_words, coverage): accepted spans."""
    order = Window.partitionBy(*_KEY, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT), F.lit(True))
    merged = license_votes(docs).withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(order)) \
        .groupBy(*_KEY, "template", "base", "label", "size", "span").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("found"),
            F.min(F.col("diagonal") + F.array_min("votes")).alias("first_word"), F.max(F.col("diagonal") + F.array_max("votes") + K).alias("stop")) \
        .withColumn("coverage", F.col("found") / F.col("size")).withColumn("n_words", F.col("stop") - F.col("first_word"))
    least = F.when(F.col("base") | (F.col("size") + K - 1 < SHORT), 1.0).otherwise(COVERAGE)
    return merged.filter((F.col("coverage") >= least) & (F.col("n_words") <= STRETCH * (F.col("size") + K - 1))) \
        .select(*_KEY, "base", "label", "first_word", "n_words", "coverage")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``.

    ``first_word``, ``last_word`` are the smallest and largest start of phrases; ``score`` is the best coverage.
    """
    def listed(c: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    base = F.col("base")
    per = license_spans(docs).groupBy(*_KEY).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"), F.max("coverage").alias("score")) \
        .withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(per, rows["doc_id"].eqNullSafe(per["_id"]) & (rows["row"] == per["_row"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
