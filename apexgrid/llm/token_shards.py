"""Token-ID output in training order: fixed-stride binary shards.

Texts are tokenised, ended by ``end_id``, and cut per task into sequences of ``length`` ids; a task's last one is padded.
A keyed Feistel permutation of ``[0, N)`` (a power-of-four domain with cycle-walking) gives every sequence its global slot,
so the training order is a shuffle that anyone with the key can compute, invert and resume. Shard ``s`` holds the slots from
``s * per_shard`` on; within it, record ``r`` starts at byte ``r * stride``.

A shard is one row of a Parquet table that is range-partitioned and sorted by shard: sequential reads follow the files, a resumed
read skips what lies before its slot by the files' statistics.
Defined cases: a null or empty text is its end id; rows without an id and repeated rows are written like any other; an
empty table gives an empty set of shards. Other columns are ignored.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_folder
from .packing import tokenizer

ROUNDS = 6
#: Characters of texts that are tokenised together, bytes of words that a worker remembers, and bytes of sequences that a task joins to shards.
TOGETHER, REMEMBERED, TASK = 1 << 22, 150_000_000, 1 << 25


def _round(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (2 ** 64 - 1)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of indexes in ``[0, n)``, or indexes of slots."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():  # a value outside the range is permuted again; fewer than three quarters are, each time
        left, right = out[walk] >> half, out[walk] & mask
        for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_round(left, key, turn) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, turn) & mask)
        out[walk] = (left << half) | right
        walk[walk] = out[walk] >= np.uint64(n)
    return out.astype(np.int64)


def _sequences(docs: DataFrame, path: str, end_id: int, pad_id: int, length: int, dtype: str) -> DataFrame:
    """(part, local, n_tokens, docs, packed): sequences of each task in order; ``packed`` is compressed for the shuffle."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, local = TaskContext.get().partitionId(), 0
        held, ids, size = [], [], 0
        pack = zstandard.ZstdCompressor(level=3)

        def cut(last: bool) -> list[tuple]:
            nonlocal held, ids, size, local
            if not held:
                return []
            flat = np.concatenate(held)
            stop = len(flat) if last else len(flat) // length * length
            starts = np.cumsum([0] + [len(h) for h in held])
            rows = []
            for lo in range(0, stop, length):
                hi = min(stop, lo + length)
                body = np.full(length, pad_id, dtype)
                body[:hi - lo] = flat[lo:hi]
                a, b = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
                rows.append((part, local, hi - lo, ids[a:b], pack.compress(body.tobytes())))
                local += 1
            k = int(np.searchsorted(starts, stop, "right")) - 1
            rest, held, ids = flat[stop:], [], ids[k:] if stop < len(flat) else []
            if len(rest):
                ends = starts[k + 1:] - stop
                held = np.split(rest, ends[:-1])
            size = len(rest)
            return rows

        names = ["part", "local", "n_tokens", "docs", "packed"]
        for batch in batches:
            keys, texts = [None if pd.isna(i) else int(i) for i in batch["doc_id"]], [t or "" for t in batch["text"]]
            chars = np.cumsum([len(t) for t in texts])
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(chars // TOGETHER)) + 1):
                for k, body in zip(some, tokenizer(path, REMEMBERED).encode([texts[k] for k in some])):
                    own = np.append(np.frombuffer(body, "<u4"), end).astype(dtype)
                    held.append(own)
                    ids.append(keys[k])
                    size += len(own)
                if size >= 64 * length:
                    yield pd.DataFrame(cut(False), columns=names)
        rows = cut(True)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInPandas(run, "part int, local long, n_tokens int, docs array<long>, packed binary")


def write_shards(docs: DataFrame, path: str, end_id: int, key: int, folder: str | None = None, pad_id: int = 0, length: int = 2048,
                 per_shard: int = 256, dtype: str = "<u2") -> str:
    """Write the shards of a table and give their folder (in the shared folder, unless named).

    Rows are (shard, first_slot, stride, records, blob); ``records`` has n_tokens and doc ids of each record. ``dtype`` holds any id of the tokenizer.
    """
    spark = docs.sparkSession
    base = folder or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    _sequences(docs, path, end_id, pad_id, length, dtype).write.parquet(f"{base}/sequences")
    made = spark.read.parquet(f"{base}/sequences")
    # one row per task: the running sum of their counts places every sequence in [0, N)
    counts = made.groupBy("part").agg(F.max("local").alias("top"))
    before = counts.select("part", (F.sum(F.col("top") + 1).over(Window.orderBy("part")) - F.col("top") - 1).alias("before"))
    total = counts.agg(F.coalesce(F.sum(F.col("top") + 1), F.lit(0))).first()[0]
    stride = length * np.dtype(dtype).itemsize

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(np.int64), total, key))

    placed = made.join(F.broadcast(before), "part").withColumn("slot", slot_of(F.col("before") + F.col("local"))) \
        .withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))

    def join_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, unpack = None, zstandard.ZstdDecompressor()

        def frame() -> pd.DataFrame:
            shard, first, records, parts = open_
            return pd.DataFrame([(shard, first, stride, records, b"".join(parts))], columns=["shard", "first_slot", "stride", "records", "blob"])

        for batch in batches:
            for shard, slot, n, ids, packed in zip(batch["shard"], batch["slot"], batch["n_tokens"], batch["docs"], batch["packed"]):
                if open_ is None or open_[0] != shard:
                    if open_ is not None:
                        yield frame()
                    open_ = (shard, slot, [], [])
                open_[2].append({"n_tokens": n, "docs": [None if pd.isna(i) else int(i) for i in ids]})
                open_[3].append(unpack.decompress(packed))
        if open_ is not None:
            yield frame()

    # slots are dense, so equal ranges of shards need no sampling: as many as the session's partitions, more if they would be large
    shards = max(1, -(-int(total) // per_shard))
    parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) * stride // TASK)))
    placed.select("shard", "slot", "n_tokens", "docs", "packed").repartitionById(parts, F.expr(f"CAST(shard * {parts} DIV {shards} AS INT)")).sortWithinPartitions("slot") \
        .mapInPandas(join_records, "shard long, first_slot long, stride int, records array<struct<n_tokens:int,docs:array<long>>>, blob binary") \
        .write.option("compression", "zstd").parquet(f"{base}/shards")
    return f"{base}/shards"


def read_sequences(spark: SparkSession, folder: str, per_shard: int = 256, from_slot: int = 0) -> DataFrame:
    """(slot, shard, offset, n_tokens, docs, record) from a slot on. Shards before it are not read."""
    shards = spark.read.parquet(folder).filter(F.col("shard") >= from_slot // per_shard)
    rows = shards.select("shard", "first_slot", "stride", "blob", F.posexplode("records").alias("r", "x"))
    return rows.select((F.col("first_slot") + F.col("r")).alias("slot"), "shard", (F.col("r") * F.col("stride")).cast("long").alias("offset"), "x.n_tokens", "x.docs",
                       F.expr("substring(blob, r * stride + 1, stride)").alias("record")).filter(F.col("slot") >= from_slot)
