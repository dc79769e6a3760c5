"""N-gram Jaccard join: size-aware, heavy and light.

Documents are compared as sets of distinct five-word shingles. Two link when their Jaccard similarity is at least
``percent`` hundredths; a component is everything reachable by links. The result is exact (up to 64-bit shingle hashes).

* Documents of equal sets are one class, found by a 128-bit digest; only one representative goes on.
* Light sets (fewer than a boundary of shingles) list every subset of the size that a partner must share with them
  as one hashed key. Heavy sets list the rarest tokens of which partners must share two. The boundary is the one with the
  least estimated work: keys written, plus pairs that an inverted list of small sets would bring up.
* Inverted lists are scanned without forming their pairs: first every list tests its members against one pivot
  member, and what is linked becomes one component. Only lists that still hold several components are then
  compared across components: short lists by a join, long ones in blocks of bounded size whose tasks scan an
  inverted list of one block for each set of the other and return at most one link per set and component.
* Before sets are fetched, pairs must pass a parity sketch: the bits in which two sketches differ never exceed the
  symmetric difference of the sets, so the filter loses nothing. Blocks are scanned by sketch first: only members that
  some member of another component may link with have their sets fetched and scanned.

Defined cases: null, empty and blank texts have no set, link with nothing and are their own component. A text of under
five words has one shingle. Rows that repeat a doc_id are one document whose links are united. Rows without a doc_id
name no document and are left out. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import small_batches, stage, unstage
from .bitmap import bitmap, holds, slot
from .components import connected
from .shingles import WIDTH, mix, shingles_of, windows_of

#: Sets up to this size are considered for subset enumeration; the boundary is at most one more.
MAX_LIGHT = 12
#: The most frequent shingles that are moved to the end of the token order. Any order gives the same result.
FREQUENT = 1 << 17
#: Shingles of a counting chunk (64 MB), and the count from which a chunk reports one.
CHUNK, REPORT = 1 << 20, 2
#: Lists up to this length are paired by a join; blocks hold about this many shingles, or words of sketches.
SHORT_LIST, BLOCK = 32, 1 << 19
#: Words that a sketch counts for in a block at least, which bounds a block's members.
SKETCH_LEAST = 32
#: A sketch has at least this many bits, and at least twice as many as its set has shingles.
SKETCH_BITS = 256
#: Bits of the filter that names the documents whose sets are fetched: a bound on what is broadcast, not on documents.
FETCH_BITS = 1 << 25


def prefix_length(n: int, percent: int) -> int:
    """Tokens, the first in any common order, of which a partner of a set of two or more must share two."""
    return min(n, n + (-percent * n // 100) + 2)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Overlaps that possible partners of a set of ``n`` must reach."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({-(-percent * (n + m) // (100 + percent)) for m in partners if m} & set(range(1, n + 1)))


def subset_keys(tokens: np.ndarray, percent: int) -> list[int]:
    """Hashed keys of all subsets of the sizes that partners must share."""
    out = []
    for c in subset_sizes(len(tokens), percent):
        rows = np.array(list(combinations(tokens.tolist(), c)), np.int64).view(np.uint64)
        acc = np.full(len(rows), np.uint64(1000 + c))
        with np.errstate(over="ignore"):
            for k in range(c):
                acc = mix(acc * np.uint64(31) + rows[:, k])
        out += acc.view(np.int64).tolist()
    return out


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ranks of the most frequent shingles, at most ``FREQUENT``: they order tokens, nothing else.

    Every text is counted. Each task counts chunks of up to ``CHUNK`` shingles and reports those it met ``REPORT``
    times or more (lossy counting), so what is shuffled and what reaches the driver is small and bounded.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= REPORT
            return pd.DataFrame({"h": h[keep], "n": n[keep]})

        for batch in batches:
            for w in windows_of(batch["text"], width):
                w = w.view(np.int64)
                held.append(w)
                size += len(w)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    top = docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    top = top.assign(rank=np.arange(len(top), 0, -1)).sort_values("h")
    return top["h"].to_numpy(np.int64), top["rank"].to_numpy(np.int64)


def ordered_tokens(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the common order (frequent ones last, by rising frequency), and which are frequent."""
    if not len(frequent) or not len(tokens):
        return tokens, np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    common = frequent[at] == tokens
    if not common.any():
        return tokens, common
    order = np.lexsort((tokens, np.where(common, rank[at], 0)))
    return tokens[order], common[order]


def _parity(tokens: np.ndarray) -> np.ndarray:
    """One bit per residue: whether an odd number of tokens has it. The length is a power of two that grows with the set."""
    bits = max(SKETCH_BITS, 1 << int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount(tokens & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _token_rows(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, n, digest, sketch, prefix, common, small): tokens of each document's inverted lists.

    Of equal sets within a task only the first gets tokens; across tasks copies find each other in the lists.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))
    none = np.empty(0, np.int64)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, rank = shared.value
        seen = set()
        for batch in batches:
            rows = []
            for s in shingles_of(batch["text"], width):
                n, digest = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if n and digest not in seen:
                    seen.add(digest)
                    t, common = ordered_tokens(s, frequent, rank)
                    p = prefix_length(n, percent)
                    t, common = t[:p], common[:p]
                    rows.append((n, digest, _parity(s), t[~common], t[common], s if n <= MAX_LIGHT else None))
                else:
                    rows.append((n, digest, None, none, none, None))
            out = pd.DataFrame(rows, columns=["n", "digest", "sketch", "prefix", "common", "small"], dtype=object)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.filter("doc_id IS NOT NULL").mapInPandas(
        tokens, "doc_id long, n long, digest binary, sketch array<long>, prefix array<long>, common array<long>, small array<long>")


def _boundary(heads: DataFrame, percent: int) -> int:
    """Size from which sets use inverted lists of tokens, by estimated work. At most ``MAX_LIGHT`` rows reach the driver."""
    small = heads.filter(F.size("small") > 0).select("n", F.explode(F.concat("prefix", "common")).alias("h"))
    met = small.groupBy("h").agg(F.count("*").alias("met"))
    per = {r["n"]: r for r in small.join(met, "h").groupBy("n").agg(F.count("*").alias("rows"), F.sum(F.col("met") - 1).alias("pairs")).collect()}
    sets = {r["n"]: r["sets"] for r in heads.filter(F.size("small") > 0).groupBy("n").agg(F.count("*").alias("sets")).collect()}

    def work(b: int) -> float:
        keys = sum(sets.get(s, 0) * sum(comb(s, c) for c in subset_sizes(s, percent)) for s in range(1, b))
        scanned = sum(per[s]["rows"] + per[s]["pairs"] / 2 for s in per if 100 * s >= percent * b)
        return keys + scanned

    return min(range(1, MAX_LIGHT + 2), key=work)


def _lists(rows: DataFrame, percent: int) -> DataFrame:
    """(h, id, n, w, pivot, pn): inverted lists that more than one document stands in, each with its pivot.

    Lists of the same members, which near copies have by the hundred, are one list: ``w`` is the sum of their weights, 2
    for a subset key, which proves enough by itself, and 1 for a token, of which partners share two. Lists merged by
    a hash in common only bring up more pairs to verify. A set of one shingle has no partner but its copies.
    """
    bound = _boundary(rows, percent)
    keys = F.udf(lambda t: subset_keys(np.array(t, np.int64), percent), "array<long>")
    rows = rows.filter("n > 1")
    in_lists = rows.filter(F.col("n") * 100 >= percent * bound)

    def listed(df: DataFrame, tokens, w: int) -> DataFrame:
        return df.select(F.explode(tokens).alias("h"), F.col("doc_id").alias("id"), "n", F.lit(w).alias("w"))

    # rows are dealt before the hashes of their ids are added, which would more than double what is shuffled
    # what tells lists apart: ends, length, an order-free hash of the members; and the pivot
    told = {"lo": F.min("id"), "hi": F.max("id"), "len": F.count("*"), "all": F.bit_xor(F.xxhash64("id", "n")),
            "p": F.min(F.struct(F.xxhash64("id").alias("k"), "id", "n"))}
    by = Window.partitionBy("h")
    rare = listed(in_lists, "prefix", 1).union(listed(rows.filter((F.size("small") > 0) & (F.col("n") < bound)), keys("small"), 2)) \
        .repartition("h").withColumns({k: v.over(by) for k, v in told.items()})
    common = listed(in_lists, "common", 1)
    common = common.join(common.groupBy("h").agg(*[v.alias(k) for k, v in told.items()]), "h")
    met = rare.unionByName(common).filter("lo <> hi").select(F.xxhash64("lo", "hi", "len", "all").alias("h"), "id", "n", "w", F.col("p.id").alias("pivot"), F.col("p.n").alias("pn"))
    return stage(met.groupBy("h", "id", "n", "pivot", "pn").agg(F.sum("w").alias("w")), "lists")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, tokens) of at least the documents of ``ids(id)``.

    Their ids set bits of a bitmap of fixed size, which the scan of the texts looks up: no text is shuffled. A bit set by
    another id only adds a set that no join asks for.
    """
    value = F.xxhash64("id")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(ids, value, FETCH_BITS))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[holds(held.value, batch["p"].to_numpy())]
            sets = list(shingles_of(batch["text"], width))
            yield pd.DataFrame({"id": batch["id"].to_numpy(np.int64), "n": np.array([len(s) for s in sets], np.int64), "tokens": pd.Series(sets, dtype=object)})

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return stage(texts.select("id", "text", slot(value, FETCH_BITS).alias("p")).mapInPandas(build, "id long, n long, tokens array<long>"), "sets")


def _asked(sketches: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of at least the documents of ``ids(id)``, looked up like those of ``_sets``: no other sketch is shuffled."""
    value = F.xxhash64("id")
    held = sketches.sparkSession.sparkContext.broadcast(bitmap(ids, value, FETCH_BITS))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[holds(held.value, batch["p"].to_numpy())].drop(columns="p")

    return stage(sketches.select("id", "n", "sketch", slot(value, FETCH_BITS).alias("p")).mapInPandas(keep, sketches.schema), "asked")


def _promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)``, of fitting sizes, whose sketches do not rule out a link.

    Sketches of such a pair have the same length or one has twice that of the other, which is then folded.
    """
    def side(x: str) -> DataFrame:
        return sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def folded(x: str, y: str) -> str:
        half = f"CAST(size(sketch_{x}) / 2 AS INT)"
        return (f"CASE WHEN size(sketch_{x}) > size(sketch_{y}) THEN zip_with(slice(sketch_{x}, 1, {half}), slice(sketch_{x}, {half} + 1, {half}), (u, v) -> u ^ v)"
                f" ELSE sketch_{x} END")

    differ = F.expr(f"aggregate(zip_with({folded('a', 'b')}, {folded('b', 'a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return pairs.join(side("a"), "a").join(side("b"), "b") \
        .filter(differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link."""
    def side(x: str) -> DataFrame:
        return sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))

    inter = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b") \
        .filter(100 * inter >= percent * (F.col("n_a") + F.col("n_b") - inter)).select("a", "b").distinct()


def _sized(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    return lists.join(connected(links), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _enough(pairs: DataFrame) -> DataFrame:
    """Distinct ``pairs(x, y, w)`` that share two tokens or one subset key."""
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")).filter("w > 1").select("a", "b")


def _pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Members of lists against the list's pivot, which is mostly the same for lists that share members."""
    return _enough(lists.filter((F.col("id") != F.col("pivot")) & _sized("n", "pn", percent)).select(F.col("id").alias("x"), F.col("pivot").alias("y"), "w"))


def _dealt(members: DataFrame) -> DataFrame:
    """``members(g, comp, weight, ...)`` dealt to tasks ``(g, i, j)`` of bounded weight, with ``role`` 0 (base), 1 (probe) or 2 (both).

    A group's largest component is not compared with itself; all others are compared with the whole group. A group of
    one block is sent once, of more: every block of probes meets every block of bases.
    """
    main = members.groupBy("g", "comp").agg(F.sum("weight").alias("weight")).groupBy("g") \
        .agg(F.max(F.struct("weight", "comp")).alias("m"), F.sum("weight").alias("all")) \
        .select("g", F.col("m.comp").alias("main"), F.ceil(F.col("all") / BLOCK).alias("nd"), F.ceil((F.col("all") - F.col("m.weight")) / BLOCK).alias("no"))
    rows = members.join(main, "g").filter("no > 0").withColumn("other", F.col("comp") != F.col("main"))
    place, zero = F.xxhash64("id"), F.lit(0).cast("long")
    once = rows.filter("nd = 1").withColumns({"role": F.when(F.col("other"), 2).otherwise(0), "i": zero, "j": zero})
    many = rows.filter("nd > 1")
    base = many.withColumn("role", F.lit(0)).withColumn("i", F.explode(F.sequence(zero, F.col("no") - 1))).withColumn("j", F.pmod(place, F.col("nd")))
    probe = many.filter("other").withColumn("role", F.lit(1)).withColumn("i", F.pmod(place, F.col("no"))).withColumn("j", F.explode(F.sequence(zero, F.col("nd") - 1)))
    return once.union(base).union(probe).drop("main", "nd", "no", "other", "weight")


def _halved(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def near_rows(n: np.ndarray, comp: np.ndarray, sketch: list[np.ndarray], base: np.ndarray, probe: np.ndarray, percent: int) -> np.ndarray:
    """Which rows are one of a base and a probe of different components that size and sketch do not keep from linking."""
    near = np.zeros(len(n), bool)
    length = np.array([len(s) for s in sketch], np.int64)
    for words in np.unique(length):
        # bases by size, of this length: as they are, and halved for probes of half the length
        at = np.flatnonzero(base & (length == words))
        at = at[np.argsort(n[at], kind="stable")]
        size, of = n[at], comp[at]
        table = np.array([sketch[k] for k in at], np.int64).reshape(len(at), words).view(np.uint64)
        for other in (words // 2, words, 2 * words):
            asks = np.flatnonzero(probe & (length == other))
            if not len(at) or not len(asks):
                continue
            bases, probes = _halved(table) if other < words else table, np.array([sketch[k] for k in asks], np.int64).view(np.uint64)
            probes = _halved(probes) if other > words else probes
            los = np.searchsorted(size, -(-percent * n[asks] // 100), "left")
            his = np.searchsorted(size, 100 * n[asks] // percent, "right")
            for k, p, lo, hi in zip(asks, probes, los, his):
                differ = np.bitwise_count(bases[lo:hi] ^ p).sum(axis=1, dtype=np.int64)
                hit = (differ * (100 + percent) <= (size[lo:hi] + n[k]) * (100 - percent)) & (of[lo:hi] != comp[k])
                if hit.any():
                    near[k] = True
                    near[at[lo:hi][hit]] = True
    return near


def _near_members(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of ``members(id, g, comp, n)`` that may link across components of their group: a scan of sketches, which are a fraction of the sets."""
    # a sketch has at most one word for 16 shingles
    work = _dealt(members.withColumn("weight", F.greatest(F.ceil(F.col("n") / 16), F.lit(SKETCH_LEAST))).drop("n")).join(sketches, "id")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        near = near_rows(pdf["n"].to_numpy(), pdf["comp"].to_numpy(), pdf["sketch"].to_list(), (pdf["role"] != 1).to_numpy(), (pdf["role"] != 0).to_numpy(), percent)
        return pdf.loc[near, ["id", "g", "comp", "n"]]

    return work.groupBy("g", "i", "j").applyInPandas(scan, "id long, g long, comp long, n long").distinct()


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within groups of long lists: ``members(id, g, comp, n)``, in blocks of bounded size."""
    work = _dealt(members.withColumnRenamed("n", "weight")).join(sets.select("id", "n", "tokens"), "id")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        base, probe, out = pdf[pdf["role"] != 1], pdf[pdf["role"] != 0], []
        if len(base) and len(probe):
            size, ids, comps = base["n"].to_numpy(), base["id"].to_numpy(), base["comp"].to_numpy()
            token = np.concatenate(base["tokens"].to_list())
            owner = np.repeat(np.arange(len(base)), [len(t) for t in base["tokens"]])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            for x, cx, n, t in zip(probe["id"], probe["comp"], probe["n"], probe["tokens"]):
                lo, hi = np.searchsorted(token, t, "left"), np.searchsorted(token, t, "right")
                took = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
                inter = np.bincount(owner[took], minlength=len(base))
                hit = np.flatnonzero((100 * inter >= percent * (size + n - inter)) & (comps != cx))
                for k in hit[np.unique(comps[hit], return_index=True)[1]]:
                    out.append((min(x, ids[k]), max(x, ids[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work.groupBy("g", "i", "j").applyInPandas(scan, "a long, b long").distinct()


def _open_lists(rows: DataFrame) -> DataFrame:
    """Rows of lists that still hold several components, with the list's length."""
    many = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("len")).filter("lo <> hi").select("h", "len")
    return rows.join(many, "h")


def _short_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in short lists. A pair that shares a long list is left to the blocks."""
    short = rows.filter(F.col("len") <= SHORT_LIST)
    a = short.select("h", "w", F.col("id").alias("x"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    b = short.select("h", F.col("id").alias("y"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    return _enough(a.join(b, "h").filter((F.col("x") < F.col("y")) & (F.col("ca") != F.col("cb")) & _sized("na", "nb", percent)).select("x", "y", "w"))


def _long_members(rows: DataFrame) -> DataFrame:
    """(id, g, comp, n) of long lists. Lists of one pivot are one group: the many lists of near copies are scanned few times."""
    return rows.filter(F.col("len") > SHORT_LIST).select("id", F.col("pivot").alias("g"), "comp", "n").distinct()


def jaccard_components(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), one row per row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest doc_id reachable by links, ``class_id`` the smallest with an equal set.
    """
    # every pass over the texts is staged within, so the setting meets all of them
    with small_batches(docs.sparkSession):
        return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, width)


def _components(docs: DataFrame, percent: int, width: int) -> DataFrame:
    rows = stage(_token_rows(docs, percent, width), "tokens")
    full = rows.filter("n > 0")
    first = full.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.lit(False).alias("own"))
    every = stage(full.select("doc_id", "n", "digest", F.col("sketch").isNotNull().alias("own")).join(first, "digest").select("doc_id", "n", "class_id", "own").union(alone), "classes")
    placed = every.filter("n > 0")
    lists = _lists(rows, percent)
    sketches = full.filter("sketch IS NOT NULL").select(F.col("doc_id").alias("id"), "n", "sketch")

    # documents with tokens stand for their class; rows that repeat a doc_id tie their classes together
    same = placed.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).filter("a <> z").select("doc_id", "a")
    links = placed.join(same, "doc_id").select("a", F.col("class_id").alias("b")).filter("a <> b") \
        .union(placed.filter("own AND doc_id <> class_id").select("doc_id", "class_id")).distinct()
    pivots = stage(_pivot_pairs(lists, percent), "pivots")
    asked = _asked(sketches, _ends(pivots))
    tested = stage(_promising(pivots, asked, percent), "pairs")
    unstage(pivots, asked)
    sets = _sets(docs, _ends(tested), width)
    links = stage(links.union(_verified(tested, sets, percent)), "links")
    unstage(sets)

    open_ = stage(_open_lists(_labelled(lists.drop("pn"), links)), "open")
    unstage(lists)
    short, long = stage(_short_pairs(open_, percent), "short"), stage(_long_members(open_), "members")
    unstage(open_)
    asked, scanned = _asked(sketches, _ends(short)), _asked(sketches, long.select("id"))
    pairs = stage(_promising(short, asked, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    members = stage(_near_members(long, scanned, percent), "near")
    unstage(short, long, asked, scanned, rows)
    sets = _sets(docs, _ends(pairs).union(members.select("id")), width)
    links = links.union(_verified(pairs, sets, percent)).union(_block_links(members, sets, percent))

    comp = connected(links).select(F.col("id").alias("class_id"), "comp")
    unstage(sets)
    linked = placed.join(comp, "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "class_id").alias("component_id"), "class_id")
    return linked.union(every.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "class_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
