"""Personal data: patterns, and a bootstrapped contextual extraction of what they do not see.

Base patterns find addresses, IP numbers, cards and phone numbers; these are the seeds. Their two words before and their two words after are
lexical patterns. All other identifiers of a text (up to ``RUN_TOKENS`` neighbouring words with digits, ``MIN_DIGITS`` in all, or a word
around an ``@``) are candidates. Spark keeps the graph of patterns and instances, an instance being the identifier's letters and digits:

* a pattern is scored by ``known / (known + UNKNOWN * unknown + plain + 1)``: its distinct known and unknown instances, and how often plain words
  stand in its place, counted over all texts; it is trusted from ``MIN_KNOWN`` known instances and a score of ``TRUST`` on;
* an instance is scored by its trusted patterns, ``1 - product(1 - score)``, and is known from ``TRUST`` on;
* this goes on until nothing new becomes known, at most ``ROUNDS`` times. All occurrences of what became known are reported as ``context``.

Texts are read twice (identifiers; counts of the patterns that can reach ``MIN_KNOWN``, looked up in a bitmap sized by their number), the rounds
work on the graph alone. Equal instances count once per pattern, so copies of a document add no trust.

Spans are (kind, start, end) in code points, end exclusive, base spans leftmost and not overlapping within a kind.
Defined cases: null and empty texts have no spans; rows that repeat get equal spans, and rows without an id are scanned too; texts of any length are taken whole
in linear time; a score that ties with ``TRUST`` passes; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .bitmap import bitmap, holds
from .shingles import mix, windows, windows_of, word_hashes

KINDS = ("email", "ip", "card", "phone", "context")
# fixed values: the base patterns; runs that can not begin a match anew are taken whole, which keeps the search linear
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_ON, _EMAIL = re.compile(f"{_LOCAL}++@{_DOMAIN}"), re.compile(f"(?<!{_LOCAL}){_LOCAL}++@{_DOMAIN}")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

MIN_DIGITS, RUN_TOKENS = 5, 4
MIN_KNOWN, TRUST, UNKNOWN, ROUNDS = 3, 0.75, 0.25, 4
_WORD, _DIGIT = re.compile(r"[^\x20\x09-\x0D]+"), re.compile("[0-9]")
_SIGNS = re.compile(r"[\W_]+")
#: Bits of the pattern filter per pattern, and its least and largest size.
_BITS, _FILTER = 16, (1 << 20, 1 << 28)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out, at = [], 0
    while "@" in text:
        # what follows a match at once may begin inside a run
        m = at and _EMAIL_ON.match(text, at) or _EMAIL.search(text, at)
        if not m:
            break
        out.append((0, *m.span()))
        at = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(_DIGIT.findall(m.group())) <= PHONE_DIGITS[1]:
            out.append((3, *m.span()))
    return out


def instance(value: str) -> int:
    """Hash of an identifier's letters and digits."""
    return xxhash.xxh64_intdigest(_SIGNS.sub("", value).lower().encode("utf-8", "surrogatepass")) - (1 << 63)


def candidates(text: str, words: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places (first, last word) of identifiers that touch no base span."""
    taken = set()
    starts = [a for a, _ in words]
    for _, a, b in base:
        k = max(0, bisect_left(starts, a + 1) - 1)
        while k < len(words) and words[k][0] < b:
            taken.add(k)
            k += 1
    out, k = [], 0
    while k < len(words):
        if k in taken or not _DIGIT.search(text, *words[k]):
            if k not in taken and "@" in text[slice(*words[k])].strip("\"'()[]{}<>,;:.!?@"):
                out.append((k, k))
            k += 1
            continue
        last = k
        while last + 1 < len(words) and last + 1 not in taken and _DIGIT.search(text, *words[last + 1]):
            last += 1
        if last - k < RUN_TOKENS and len(_DIGIT.findall(text, words[k][0], words[last][1])) >= MIN_DIGITS:
            out.append((k, last))
        k = last + 1
    return out


def _sides(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of word pairs as what stands before and what stands after."""
    return mix(pairs ^ np.uint64(1)).view(np.int64), mix(pairs ^ np.uint64(2)).view(np.int64)


def identifiers(text: str) -> list[dict]:
    """Base spans and candidates (kind 4) with their instance and the keys of the words before and after."""
    if not re.search("[0-9@]", text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    base = base_spans(text)
    found = [(k, a, b, max(0, bisect_left(words, (a + 1,)) - 1), bisect_left(words, (b,)) - 1) for k, a, b in base]
    for first, last in candidates(text, words, base):
        a, b = words[first][0], words[last][1]
        while a < b and text[a] in "\"'([{<":
            a += 1
        while a < b and text[b - 1] in "\"')]}>,;:.!?":
            b -= 1
        found.append((4, a, b, first, last))
    if not found:
        return []
    before, after = _sides(windows(word_hashes(text), 2))
    n = len(words)
    return [{"kind": k, "start": a, "end": b, "instance": instance(text[a:b]), "before": int(before[i - 2]) if i >= 2 else None,
             "after": int(after[j + 1]) if j + 2 < n else None} for k, a, b, i, j in found]


_ITEMS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("before", pa.int64()), ("after", pa.int64())]))
_ITEMS_DDL = "array<struct<kind:int,start:int,end:int,instance:bigint,before:bigint,after:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row, items): identifiers of every text; ``row`` numbers the rows."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([identifiers(t) if t else [] for t in batch.column("text").to_pylist()], _ITEMS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), items], ["doc_id", "row", "items"])

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return numbered.mapInArrow(read, f"doc_id long, row long, items {_ITEMS_DDL}")


def pattern_totals(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, total): how often the patterns of ``wanted`` stand beside any word."""
    n = wanted.count()
    bits = max(_FILTER[0], min(_FILTER[1], 1 << (_BITS * max(n, 1) - 1).bit_length()))
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.col("pattern"), bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for w in windows_of(batch.column("text").to_pylist(), 2):
                before, after = _sides(w)
                for keys in (before[:-1], after[1:]):  # a pattern needs a word beside it
                    hits.append(keys[holds(held.value, 1 + (keys & (bits - 1)))])
            keys, total = np.unique(np.concatenate(hits), return_counts=True) if hits else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total.astype(np.int64))], ["pattern", "total"])

    return docs.select("text").mapInArrow(count, "pattern long, total long").join(wanted.select("pattern"), "pattern", "left_semi") \
        .groupBy("pattern").agg(F.sum("total").alias("total"))


def graph(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(pattern, instance, n, seed, plain): edges of all patterns with enough instances; ``plain`` counts plain words in the pattern's place."""
    sides = F.array(F.col("i.before"), F.col("i.after"))
    edges = scanned.select(F.explode("items").alias("i")).select(F.explode(sides).alias("pattern"), "i.instance", (F.col("i.kind") < 4).alias("seed")) \
        .filter("pattern IS NOT NULL").groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = stage(edges, "edges")
    wanted = stage(edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("taken")).filter(F.col("instances") >= MIN_KNOWN), "patterns")
    plain = wanted.join(pattern_totals(docs, wanted), "pattern", "left").select("pattern", (F.coalesce("total", F.lit(0)) - F.col("taken")).alias("plain"))
    return stage(edges.join(stage(plain, "plain"), "pattern"), "graph")


def scored_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, n_known, n_unknown, plain, score) against the ``known(instance)``; seeds are known."""
    hit = (F.col("seed") | F.col("k.instance").isNotNull()).cast("long")
    return edges.alias("e").join(known.alias("k"), F.col("e.instance") == F.col("k.instance"), "left").groupBy("pattern") \
        .agg(F.sum(hit).alias("n_known"), F.sum(1 - hit).alias("n_unknown"), F.max("plain").alias("plain")) \
        .withColumn("score", F.col("n_known") / (F.col("n_known") + UNKNOWN * F.col("n_unknown") + F.greatest("plain", F.lit(0)) + 1))


def discovered(edges: DataFrame) -> DataFrame:
    """(instance, confidence) of the identifiers that trusted patterns discover."""
    known = edges.sparkSession.createDataFrame([], "instance long, confidence double")
    size = 0
    for _ in range(ROUNDS):
        trusted = scored_patterns(edges, known).filter((F.col("n_known") >= MIN_KNOWN) & (F.col("score") >= TRUST)).select("pattern", "score")
        now = edges.filter("NOT seed").join(trusted, "pattern").groupBy("instance") \
            .agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("confidence")).filter(F.col("confidence") >= TRUST - 1e-12)
        now = stage(now, "known")
        grown = now.count()
        if not grown or grown == size:
            return now
        known, size = now, grown
    return known


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, spans): all spans of every row of ``docs(doc_id, text)``, as an array of (kind, start, end) by kind as listed, then start."""
    scanned = stage(scan(docs), "scanned")
    found = discovered(graph(docs, scanned)).select("instance")
    items = scanned.select("row", F.explode("items").alias("i")).filter("i.kind = 4").select("row", "i.instance", F.struct("i.kind", "i.start", "i.end").alias("s"))
    more = items.join(found, "instance", "left_semi").groupBy("row").agg(F.collect_list("s").alias("more"))
    base = F.transform(F.filter("items", lambda i: i["kind"] < 4), lambda i: F.struct(i["kind"].alias("kind"), i["start"].alias("start"), i["end"].alias("end")))
    named = F.transform(F.array_sort(F.concat(F.col("base"), F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>")))), lambda s: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.withColumn("base", base).join(more, "row", "left").select("doc_id", "row", named.alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context)."""
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(array) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select("doc_id", *[of(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of("context"))
