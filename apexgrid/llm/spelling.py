"""Spelling variant grouping by dense prefix-suffix tiling.

Words are counted over all documents with Spark functions. Two words differ by one inserted, deleted or replaced code point
exactly when their common prefix and common suffix together reach the longer length minus one, so one of them covers half of the
longer word. Words therefore meet in groups of (side, longer length ``m``, first or last ``m // 2`` code points), every word as a longer and
as a shorter one. A group is cut into blocks by a hash of the word, and every pair of blocks is a tile: the words' code points
are padded matrices, one held against the other column by column from both ends. A tile returns one row per word (how many near words,
and the best of them), never the pairs. A pair that shares both halves is counted by its prefix only.

A word's form is its near word of largest count, if that has at least ``ratio`` times the word's count; forms are followed to the last by pointer
doubling, in about log2 of the longest chain rounds, each written to the shared folder.

Defined cases: null and empty texts have no words; a null id counts as an empty one; rows that repeat are counted as often as they
stand; equal counts are decided by the smaller word; very long texts and words are taken whole; an empty table has no words. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stage

# fixed values: what a word is, and which runs lose a code point
RUN, DAMAGED = "[A-Za-z\\u00C0-\\u00FF]+", 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Words of a block, and pairs compared at once in a tile.
BLOCK, SLAB = 4096, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences, after the damage."""
    # a run that is cut stays within a word's length, so shorter runs need not be exploded
    long_runs = RUN.removesuffix("+") + f"{{{min_length},}}"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(long_runs), 0)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")) \
        .filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def tiles(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(side, m, affix, x, y, own, word, n): every word in every tile of its groups; ``own`` is its block, x <= y the tile's."""
    def key(side: str, more: int):
        m = F.length("word") + more
        half = F.floor(m / 2).cast("int")
        affix = F.substring("word", F.lit(1), half) if side == "p" else F.expr(f"right(word, cast(floor((length(word) + {more}) / 2) as int))")
        return F.struct(F.lit(side).alias("side"), m.alias("m"), affix.alias("affix"))

    keyed = words.select("word", "n", F.explode(F.array(*[key(s, more) for s in "ps" for more in (0, 1)])).alias("k")) \
        .select("k.side", "k.m", "k.affix", "word", "n")
    longer = F.count(F.when(F.length("word") == F.col("m"), 1))
    sizes = keyed.groupBy("side", "m", "affix").agg(F.count("*").alias("size"), longer.alias("longer")) \
        .filter("longer >= 1 AND size >= 2").select("side", "m", "affix", F.ceil(F.col("size") / block).alias("blocks"))
    own = keyed.join(sizes, ["side", "m", "affix"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))) \
        .select("side", "m", "affix", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "word", "n")


def _codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded at the right, and at the left in reverse order for comparing ends; zero is no word's code point."""
    forward = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    backward = np.array([w[::-1] for w in words], dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    small = np.uint8 if forward.max(initial=0) < 256 else np.uint32
    return np.ascontiguousarray(forward.T.astype(small)), np.ascontiguousarray(backward.T.astype(small))


def _common(a: np.ndarray, b: np.ndarray, rows: slice) -> np.ndarray:
    """Length of the common start of every pair; both are matrices of one row per place."""
    alive = np.ones((rows.stop - rows.start, b.shape[1]), bool)
    out = np.zeros(alive.shape, np.uint8 if len(a) < 256 else np.uint32)
    for x, y in zip(a, b):
        alive &= x[rows, None] == y[None, :]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(side: str, m: int, words: list[str], own: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of a tile that differ by one code point, each once; ``i`` has the longer length ``m``."""
    lengths = np.array([len(w) for w in words])
    long = np.flatnonzero(lengths == m)
    forward, backward = _codes(words, m)
    step = max(1, SLAB // max(1, len(words)))
    left, right = [], []
    for lo in range(0, len(long), step):
        rows = slice(lo, min(lo + step, len(long)))
        i = long[rows]
        prefix = _common(forward[:, long], forward, rows)
        hit = prefix.astype(np.int64) + _common(backward[:, long], backward, rows) >= m - 1
        hit &= (lengths[None, :] < m) | (np.arange(len(words))[None, :] > i[:, None])  # pairs of one length once
        if x != y:
            hit &= own[i][:, None] != own[None, :]
        if side == "s":
            hit &= prefix < m // 2
        a, b = np.nonzero(hit)
        left.append(i[a])
        right.append(b)
    return np.concatenate([np.empty(0, int), *left]), np.concatenate([np.empty(0, int), *right])


def _compared(tile: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words of one tile that have near words in it."""
    side, m, x, y = (tile.column(c)[0].as_py() for c in ("side", "m", "x", "y"))
    words, n = tile.column("word").to_pylist(), tile.column("n").to_numpy()
    i, j = near_pairs(side, m, words, tile.column("own").to_numpy(), x, y)
    one, other = np.concatenate([i, j]), np.concatenate([j, i])
    place = np.empty(len(words), np.int64)  # in code-point order
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort([place[other], -n[other], one])
    one, other = one[order], other[order]
    first = np.flatnonzero(np.diff(one, prepend=-1))
    return pa.RecordBatch.from_arrays([
        pa.array([words[k] for k in one[first]], pa.string()), pa.array(np.diff(first, append=len(one)), pa.int64()),
        pa.array(n[other[first]], pa.int64()), pa.array([words[k] for k in other[first]], pa.string())], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best): near words of each word that has any, and the one of largest count."""
    key = ["side", "m", "affix", "x", "y"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # the rows of the tile that the batch before ended in
        for batch in batches:
            columns = [batch.column(c) for c in key]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                now = [c[lo].as_py() for c in columns]
                if held and now != last:
                    yield _compared(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = now
        if held:
            yield _compared(pa.Table.from_batches(held))

    # by count: tiles are small in bytes but not in work, so partitions must not be merged by their size
    count = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_tiles = tiles(words, block).repartition(count, *key).sortWithinPartitions(*key)
    per_tile = sorted_tiles.mapInArrow(compare, "word string, n_near long, best_n long, best string")
    return per_tile.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")) \
        .select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def followed(links: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of ``links(word, form)``. Counts grow along a chain, so it ends."""
    now = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def spelling_groups(docs: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs(doc_id, text)``."""
    words = stage(word_counts(docs), "words")
    near = stage(near_words(words, block).withColumnRenamed("word", "own"), "near")
    fits = F.col("best_n") >= ratio * F.col("n")
    formed = words.join(near, F.col("word") == F.col("own"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    formed = stage(formed, "forms")
    roots = followed(formed.filter("form IS NOT NULL")).withColumnRenamed("word", "own")
    return formed.join(roots, F.col("word") == F.col("own"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
