"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever its low ``k`` bits are zero, so boundaries depend on nearby text only and
an edit changes the chunks it touches. A fingerprint ``k:signature:signature`` has one symbol per chunk at the smallest
``k`` with at most ``CHUNKS`` chunks, and at ``k + 1``. Two fingerprints are compared at block sizes that both have:
the likeness is one minus the edit distance of the signatures over the longer one's length, and 0 without a common block size.

Symbols are 2 ** 14 code points of the CJK block, so a chance match is rare and a signature stays one character a chunk.
Defined cases: null and empty texts have the fingerprint ``0::``, which is like itself (1) and unlike all others (0).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

WINDOW, CHUNKS = 7, 64
_FIRST, _SYMBOLS = 0x4E00, 1 << 14


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def rolling_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the (at most) seven bytes up to each byte."""
    b = raw.astype(np.uint32) + np.uint32(1)
    out = b.copy()
    with np.errstate(over="ignore"):
        factor = 1
        for j in range(1, min(WINDOW, len(b))):
            factor = factor * 0x01000193 & 0xFFFFFFFF
            out[j:] += b[:len(b) - j] * np.uint32(factor)
    return _scramble(out)


def signature(hashes: np.ndarray, k: int) -> str:
    """One symbol per chunk at block size ``2 ** k``."""
    ends = np.flatnonzero((hashes & np.uint32((1 << k) - 1)) == 0) + 1
    starts = np.concatenate([[0], ends[ends < len(hashes)]])
    # a chunk's hash sums its rolling hashes: each stands for seven bytes in order
    chunk = _scramble(np.add.reduceat(_scramble(hashes ^ np.uint32(0x9E3779B9)), starts, dtype=np.uint32))
    return (_FIRST + (chunk & np.uint32(_SYMBOLS - 1))).astype("<u4").tobytes().decode("utf-32-le")


def n_chunks(hashes: np.ndarray, k: int) -> int:
    ends = (hashes & np.uint32((1 << k) - 1)) == 0
    return int(np.count_nonzero(ends)) + (not ends[-1])


def fingerprint(text: str | None) -> str:
    """``k:signature at k:signature at k + 1``."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return "0::"
    hashes = rolling_hashes(raw)
    k = max(0, len(raw).bit_length() - 6)
    while k and n_chunks(hashes, k - 1) <= CHUNKS:
        k -= 1
    while n_chunks(hashes, k) > CHUNKS:
        k += 1
    return f"{k}:{signature(hashes, k)}:{signature(hashes, k + 1)}"


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two fingerprint columns, 0 to 1."""
    x, y = F.split(a, ":"), F.split(b, ":")
    gap = x[0].cast("int") - y[0].cast("int")

    def near(u: Column, v: Column) -> Column:
        return 1 - F.levenshtein(u, v) / F.greatest(F.length(u), F.length(v), F.lit(1))

    return F.when(a == b, F.lit(1.0)).when((F.length(x[1]) == 0) | (F.length(y[1]) == 0), F.lit(0.0)) \
        .when(gap == 0, F.greatest(near(x[1], y[1]), near(x[2], y[2]))).when(gap == 1, near(x[1], y[2])).when(gap == -1, near(x[2], y[1])).otherwise(F.lit(0.0))


def edited(text: str, following: str) -> str:
    """The last third replaced by as many code points of the beginning of another text, or all of it."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _described(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    new = edited(text, following)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, own if new == text else fingerprint(new), next_own


def neighbour_fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness to the edited and the next text.

    The next document is the one of the next smaller doc_id (ties by text; documents without an id come last); after
    the last comes the first. Texts are range-partitioned by id once and read in order. Only the first and last of
    each partition, whose neighbours are elsewhere, are set aside and matched in a second, small step.
    """
    spark = docs.sparkSession
    partitions = partitions or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .repartitionByRange(partitions, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        columns = [f.split()[0] for f in _FIELDS.split(", ")] + ["part", "edge", "text"]
        last = None
        for batch in batches:
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            rows = []
            for doc_id, text in zip(ids, batch["text"]):
                doc_id = None if doc_id is None else int(doc_id)
                own = fingerprint(text)
                if last is None:
                    rows.append((doc_id, len(text), None, own, None, None, part, "first", text))
                else:
                    rows.append((*_described(*last, text, own), part, None, None))
                last = (doc_id, text, own)
            yield pd.DataFrame(rows, columns=columns, dtype=object)
        if last is not None:
            yield pd.DataFrame([(last[0], len(last[1]), None, last[2], None, None, part, "last", last[1])], columns=columns, dtype=object)

    rows = stage(ordered.mapInPandas(walk, f"{_FIELDS}, part int, edge string, text string"), "fingerprints")
    # at most two rows per partition: the last of each meets the first of the next that has any
    order = Window.orderBy("part")
    last = rows.filter("edge = 'last'").withColumn("at", F.row_number().over(order))
    first = rows.filter("edge = 'first'").select((F.row_number().over(order) - 1).alias("place"), F.col("text").alias("following"), F.col("fingerprint").alias("next_own"))
    size = F.expr("count(*) OVER ()")
    met = last.withColumn("place", F.when(F.col("at") == size, F.lit(0)).otherwise(F.col("at"))).join(first, "place")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            out = [_described(None if i is None else int(i), t, own, f, nxt) for i, t, own, f, nxt in
                   zip(ids, batch["text"], batch["fingerprint"], batch["following"], batch["next_own"])]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _FIELDS.split(", ")], dtype=object)

    ends = met.select("doc_id", "text", "fingerprint", "following", "next_own").mapInPandas(close, _FIELDS)
    return rows.filter("edge IS NULL").drop("part", "edge", "text").union(ends) \
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
