"""Line dedup by a deletion-neighbourhood join. DataFrame functions only.

Lines are compared as sequences of words. A line of at least ``min_words`` words goes when an earlier line (by doc_id, then place in the
text) is equal to it or within one word edit: a word replaced, inserted or deleted. The earliest of such lines stays.
Shorter lines, down to ``exact_words``, go when an earlier line is equal; without that value they always stay.

1. Equal lines are one class with its first place; this settles exact copies by one grouped minimum, whatever their number.
2. Lines within one edit share their first or their last half. Classes none of whose halves (for both lengths that a
   partner may have) occurs in another class have no partner and are set aside; the others' texts are fetched.
3. Those emit every variant with one word deleted as a hashed key (an XOR over neighbouring word pairs, so all variants of a
   line take linear time). Classes with the same key, length and deleted place differ in that word only: each is joined with the earliest of its group, never
   with all of it. A class whose full key is another's variant differs by an insertion.
4. Joined pairs are verified word by word, and the later one goes. Should a hash collision make a pair fail, its group is
   compared without the shortcut.

Defined cases: a null text stays null; blank lines and those under both lengths always stay; rows that repeat both id and text are treated alike;
rows without an id stay as they are and make no others go. All columns pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

MIN_WORDS = 5
_PLACE = ("doc_id", "row", "line_no")


def words_of(line: Column) -> Column:
    """Words between white space; a blank line has none."""
    for c in "\t\x0b\f\r":  # plain replacements scan faster than a pattern
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id"), F.xxhash64("text").alias("row"), "text")


def _least(min_words: int, exact_words: int | None) -> int:
    """Words of the shortest line that may go; a blank line never does."""
    return max(1, min_words if exact_words is None else min(exact_words, min_words))


def _classes(docs: DataFrame, min_words: int, least: int) -> DataFrame:
    """(h1, h2, place, halves): distinct lines with their first place and, from ``min_words`` on, the hashes of their halves."""
    lines = _keyed(docs).select("doc_id", "row", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")) \
        .withColumn("w", words_of("line")).withColumn("n", F.size("w")).filter(F.col("n") >= least)

    def halves(m: Column) -> list[Column]:
        p = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit(0), m, F.slice("w", F.lit(1), p)), F.xxhash64(F.lit(1), m, F.slice("w", F.col("n") - (m - p) + 1, m - p))]

    keys = F.when(F.col("n") >= min_words, F.array(*halves(F.col("n")), *halves(F.col("n") - 1)))
    return lines.select(F.xxhash64("w").alias("h1"), F.xxhash64("w", F.lit(7)).alias("h2"), F.struct(*_PLACE).alias("place"), keys.alias("halves")) \
        .groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("halves").alias("halves"))


def _candidates(classes: DataFrame) -> DataFrame:
    """Places of classes that share a half with another class."""
    w = Window.partitionBy("half")
    halves = classes.select(F.xxhash64("h1", "h2").alias("c"), F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.withColumns({"lo": F.min("c").over(w), "hi": F.max("c").over(w)}).filter("lo <> hi").select("c").distinct()
    return classes.select(F.xxhash64("h1", "h2").alias("c"), "place").join(shared, "c", "left_semi").select("place.*").distinct()


def _with_words(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(c, place, w, n): the candidates' words; ``c`` identifies a candidate by its place."""
    per = places.groupBy("doc_id", "row").agg(F.collect_list("line_no").alias("wanted"))
    got = _keyed(docs).join(per, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]) \
        .select("doc_id", "row", "wanted", F.split("text", "\n").alias("lines")) \
        .select("doc_id", "row", F.explode(F.transform("wanted", lambda i: F.struct(i.alias("line_no"), F.element_at("lines", i + 1).alias("line")))).alias("x"))
    return got.select(F.struct("doc_id", "row", "x.line_no").alias("place"), words_of(F.col("x.line")).alias("w")).withColumn("n", F.size("w"))


def _variants(lines: DataFrame) -> DataFrame:
    """(place, n, at, key): keys of the full line (``at`` 0) and of every variant with word ``at`` deleted."""
    padded = lines.withColumn("p", F.expr("concat(array(''), w, array(''))")) \
        .withColumn("g", F.expr("transform(sequence(1, n + 1), j -> xxhash64(element_at(p, j), element_at(p, j + 1)))")) \
        .withColumn("all", F.expr("aggregate(g, 0L, (s, x) -> s ^ x)"))
    # the pairs (at - 1, at) and (at, at + 1) give way to (at - 1, at + 1)
    keys = F.expr("concat(array(all), transform(sequence(1, n), i -> all ^ element_at(g, i) ^ element_at(g, i + 1)"
                  " ^ xxhash64(element_at(p, i), element_at(p, i + 2))))")
    # outer: else the optimizer would build the array once more, in a filter on its size
    return padded.select("place", "n", F.posexplode_outer(keys).alias("at", "key"))


def _one_edit(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(x, y, at, kind)`` with both lines' words and whether they are within the edit that the pair claims."""
    x = lines.select(F.col("place").alias("x"), F.col("w").alias("wx"))
    y = lines.select(F.col("place").alias("y"), F.col("w").alias("wy"))
    # kind 0: word ``at`` replaced; kind 1: y has word ``at`` that x lacks
    good = F.expr("""slice(wx, 1, at - 1) = slice(wy, 1, at - 1)
        AND slice(wx, at + if(kind = 0, 1, 0), size(wx)) = slice(wy, at + 1, size(wy))""")
    return pairs.join(x, "x").join(y, "y").select("x", "y", "at", "kind", "key", "n", good.alias("good"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """(doc_id, row, kept): for every keyed row the places of its lines that stay, of those that are long enough to go."""
    classes = stage(_classes(docs, min_words, _least(min_words, exact_words)), "line-classes")
    lines = stage(_with_words(docs, _candidates(classes)), "line-candidates")
    variants = stage(_variants(lines), "line-variants")

    group = ["key", "n", "at"]
    cut = variants.filter("at > 0")
    first = cut.groupBy(*group).agg(F.min("place").alias("y"), F.count("*").alias("size")).filter("size > 1").select(*group, "y")
    replaced = cut.join(first, group).filter("place <> y").select(F.col("place").alias("x"), "y", "at", F.lit(0).alias("kind"), "key", "n")
    full = variants.filter("at = 0").select(F.col("place").alias("x"), "key", F.col("n").alias("m"))
    inserted = cut.join(full, "key").filter("m = n - 1").select("x", F.col("place").alias("y"), "at", F.lit(1).alias("kind"), "key", "n")
    pairs = stage(_one_edit(lines, replaced.union(inserted)), "line-pairs")

    failed = pairs.filter("kind = 0 AND NOT good").select(*group).distinct()
    again = cut.join(failed, group)
    rest = again.select(*group, F.col("place").alias("x")).join(again.select(*group, F.col("place").alias("y")), group) \
        .filter("y < x").select("x", "y", "at", F.lit(0).alias("kind"), "key", "n")
    found = pairs.filter("good").select("x", "y").union(_one_edit(lines, rest).filter("good").select("x", "y"))
    gone = found.select(F.greatest("x", "y").alias("place")).distinct()
    return classes.select("place").join(gone, "place", "left_anti").select("place.*") \
        .groupBy("doc_id", "row").agg(F.collect_list("line_no").alias("kept"))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): which lines (from 0) of each row go. No text leaves its scan."""
    kept, least = repeated_lines(docs, min_words, exact_words), _least(min_words, exact_words)
    long_lines = F.filter(F.expr("sequence(0, size(lines) - 1)"), lambda i: F.size(words_of(F.element_at("lines", i + 1))) >= least)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n").alias("lines")) \
        .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("row"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), long_lines.alias("long"))
    stays = F.coalesce("kept", F.when(F.col("row").isNull(), F.col("long")), F.array().cast("array<int>"))
    removed = F.array_sort(F.array_except(F.coalesce("long", F.array().cast("array<int>")), stays))
    return rows.join(kept, ["doc_id", "row"], "left").select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), removed.alias("removed")) \
        .select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``. Rows keep their other columns, also when no line is left."""
    kept, least = repeated_lines(docs, min_words, exact_words), _least(min_words, exact_words)
    none = F.array().cast("array<int>")
    # the row travels as one value, so its column names meet no others
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("hash"))
    joined = rows.join(kept, (F.col("own") == F.col("doc_id")) & (F.col("hash") == F.col("row")), "left").withColumn("lines", F.split("whole.text", "\n"))
    stay = F.array_sort(F.array_union(F.coalesce("kept", none), F.filter(F.expr("sequence(0, size(lines) - 1)"),
                                                                          lambda i: F.size(words_of(F.element_at("lines", i + 1))) < least)))
    cleaned = F.when(F.col("whole.text").isNull() | F.col("own").isNull(), F.col("whole.text")) \
        .otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n"))
    return joined.select(*[cleaned.alias(c) if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns])
