"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item leaks into a document when at least ``percent`` hundredths of its distinct five-word shingles occur there.

* Items are partitioned by their number of shingles. An item's sketch is its bottom-m MinHash: the m smallest shingle
  hashes, m being fixed for a partition so that even its largest item must share one with any document that contains it
  (m > (1 - threshold) * size). Long documents need no sketch of their own, so their size does not dilute the match.
* Documents are scanned once. Their shingles are looked up in a bitmap of fixed size that holds all item shingles; what is
  left joins the sketches for candidates, and the exact count of shared shingles decides.

Defined cases: null, empty and blank texts on either side leak nowhere. An item under five words is one shingle, its whole
sequence, which only a document of the same words has. Repeated items and documents are reported once per id, with the
largest containment. Rows without an id are left out; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .bitmap import bitmap, holds
from .shingles import WIDTH, shingles_of, windows_of

#: Size of the bitmap of item shingles.
FILTER_BITS = 1 << 24


def sketch_length(n: int, percent: int) -> int:
    """Bottom-m length of the size partition of ``n``: partitions end at powers of the square root of two."""
    top = int(np.ceil(2 ** (np.ceil(2 * np.log2(n)) / 2)))
    return min(n, (100 - percent) * max(n, top) // 100 + 1)


def benchmark_items(benchmark: DataFrame, percent: int, width: int) -> DataFrame:
    """(item_id, n_item, shingles, sketch)."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingles_of(batch["text"], width))
            keep = [k for k, s in enumerate(sets) if len(s)]
            rows = [(len(sets[k]), sets[k], sets[k][:sketch_length(len(sets[k]), percent)]) for k in keep]
            out = pd.DataFrame(rows, columns=["n_item", "shingles", "sketch"], dtype=object)
            out.insert(0, "item_id", batch["item_id"].to_numpy()[keep])
            yield out

    return benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text") \
        .mapInPandas(build, "item_id long, n_item long, shingles array<long>, sketch array<long>")


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all leaks."""
    items = stage(benchmark_items(benchmark, percent, width), "items")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(items.select(F.explode("shingles").alias("h")), F.col("h"), FILTER_BITS))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found = [], []
            for i, w in zip(batch["doc_id"], windows_of(batch["text"], width)):
                w = w.view(np.int64)
                hit = np.unique(w[holds(held.value, 1 + (w & (FILTER_BITS - 1)))])
                if len(hit):
                    ids.append(i)
                    found.append(hit)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "found": pd.Series(found, dtype=object)})

    found = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInPandas(scan, "doc_id long, found array<long>")
    sketches = items.select("item_id", F.explode("sketch").alias("h"))
    candidates = found.select("doc_id", "found", F.explode("found").alias("h")).join(sketches, "h").select("doc_id", "item_id", "found")
    shared = F.size(F.array_intersect("found", "shingles")).cast("long")
    return candidates.join(items.select("item_id", "n_item", "shingles"), "item_id") \
        .select("doc_id", "item_id", "n_item", shared.alias("n_shared")).filter(100 * F.col("n_shared") >= percent * F.col("n_item")) \
        .groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_item", "n_shared")).alias("best")) \
        .select("doc_id", "item_id", "best.n_item", "best.n_shared", F.col("best.c").alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    bad = stage(leaks(docs, benchmark, percent, width).select("doc_id").distinct(), "leaked")
    return docs.join(bad, docs["doc_id"].cast("long") == bad["doc_id"], "left_anti")
