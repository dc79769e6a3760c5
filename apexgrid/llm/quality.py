"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. A logistic model per target (``quality`` = 1 is good, ``toxic`` = 1 is bad) is fitted on at most ``TRAIN_ROWS`` labelled
   documents: shape features (how much of a text is symbols, capitals, table bars, repeated words) and the presence of
   words and word beginnings that a grouped count over the sample finds telling.
2. Every document gets both log-odds. Grouped aggregation over all documents sums the evidence per path (``host``,
   ``path`` columns) and per host. Hosts are shrunk toward the global rate with a strength estimated from the spread
   of the hosts' rates (method of moments), paths toward their host with one estimated from the paths' spread, so sparse sites
   stay near their parents.
3. The posterior log-odds of a document are its own plus the shift of its path's rate against the global rate. A document
   is rejected when its toxic posterior reaches ``TOXIC_CUT`` or its quality posterior is under ``QUALITY_CUT``.

Defined cases: null and empty texts carry no evidence, count for no site and are kept; null hosts and paths are values of their own;
a label that is null, or a document with contradicting labels, does not train; without labels of both kinds a target's
log-odds are 0 for all and nothing is rejected for it. Other columns pass through; the names
``p_quality``, ``p_toxic`` and ``keep`` of a former run are replaced.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import stage

#: Bound of the training sample, of the telling words, and of a site table that may be broadcast.
TRAIN_ROWS, TELLING, BROADCAST_SITES = 8192, 1024, 50_000
#: Posteriors that reject a document. A missed toxic document costs more than a lost clean one, hence the lower cut.
TOXIC_CUT, QUALITY_CUT = 0.3, 0.5
#: Shrinkage of the weights of telling forms; shapes have 1.
FORM_RIDGE = 0.1
#: Rows of the sample that are numbers at once while a model is fitted: some 2 MB, not the 35 MB of each matrix of all rows.
FIT_ROWS = 512
TARGETS = ("quality", "toxic")
BEGINNINGS = (4, 5, 6, 7, 8)
_EDGE = re.compile(r"^\W+|\W+$")
_SYMBOLS = "*&%$#|!?.,;:<>{}[]()=+/\\_-~^@\"'"
SHAPES = 12 + len(_SYMBOLS)
#: Words that a reader remembers, about 20 MB.
WORDS = 75_000
_PLAIN = (False, False, False, False, ())


def word_forms(raw: str) -> list[str]:
    """A word and its beginnings, in lower case without the punctuation around it; ``=`` marks the whole word."""
    w = _EDGE.sub("", raw).lower()
    return ["=" + w, *(w[:k] for k in BEGINNINGS if len(w) > k)] if w else []


def telling_forms(text: str) -> set[str]:
    """All forms of all words of a text."""
    return {f for raw in set(text.split()) for f in word_forms(raw)}


class Reader:
    """Shapes and known forms of texts. What a word contributes is remembered, up to ``WORDS`` words."""

    def __init__(self, forms: Iterable[str]):
        self.forms = frozenset(forms)
        self.facts: dict[str, tuple] = {}

    def _fact(self, w: str) -> tuple:
        marked = len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum()
        return (w == "|", marked, len(w) > 1 and w.isupper(), any(c.isdigit() for c in w), tuple(f for f in word_forms(w) if f in self.forms))

    def read(self, text: str) -> tuple[np.ndarray, set[str]]:
        words = text.split()
        n, m = max(1, len(text)), max(1, len(words))
        counts = Counter(words)
        top = max(counts.values(), default=0)
        doubled = sum(map(str.__eq__, words, words[1:]))
        lines = [x for x in text.split("\n") if x.strip()]
        bars = marked = capitals = digits = 0
        forms: set[str] = set()
        facts = self.facts
        for w, k in counts.items():
            fact = facts.get(w)
            if fact is None:
                fact = self._fact(w)
                if len(facts) >= WORDS:
                    facts.clear()
                facts[w] = fact
            if fact != _PLAIN:
                bars += k * fact[0]
                marked += k * fact[1]
                capitals += k * fact[2]
                digits += k * fact[3]
                forms.update(fact[4])
        out = [np.log1p(m) / 5, m < 5, len(counts) / m, min(1, 3 * top / m) if m > 20 else 0, doubled / m, bars / m, marked / m, capitals / m, digits / m,
               len(set(lines)) / max(1, len(lines)), min(3, n / m / 6), sum(map(len, counts)) / max(1, len(counts)) / 8]
        return np.array([*out, *(min(2.0, text.count(c) * 10 / n) for c in _SYMBOLS)], float), forms


@dataclass(frozen=True)
class Model:
    """Weights of one target: shapes and presence of telling forms; ``floor`` is the training base rate's log-odds."""
    bias: float
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    forms: dict[str, float]

    def score(self, shaped: np.ndarray, forms: set[str]) -> float:
        table = self.forms
        return float(self.bias + ((shaped - self.mean) / self.scale) @ self.shapes + sum(table[f] for f in forms if f in table))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1.0, rounds: int = 40, marks: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by Newton steps on the bounded sample; classes weigh as they occur.

    ``marks`` are further columns of truth values. The sums of a step are taken over blocks of rows, so the driver holds no matrix of all rows.
    """
    marks = np.zeros((len(x), 0), bool) if marks is None else marks
    w = np.zeros(1 + x.shape[1] + marks.shape[1])
    penalty = np.concatenate([[1e-6], np.broadcast_to(ridge, len(w) - 1)])
    for _ in range(rounds):
        grad, curve = penalty * w, np.diag(penalty)
        for lo in range(0, len(x), FIT_ROWS):
            at = slice(lo, lo + FIT_ROWS)
            z = np.hstack([np.ones((len(x[at]), 1)), x[at], marks[at]])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad += z.T @ (p - y[at])
            curve += (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
        step = np.linalg.solve(curve, grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return float(w[0]), w[1:]


def fit(sample: DataFrame) -> dict[str, Model | None]:
    """Models of both targets from ``sample(text, quality, toxic)``, which the caller has bounded."""
    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for text, q, t in zip(b["text"], b["quality"], b["toxic"]):
                for f in telling_forms(text or ""):
                    seen[f, int(q), int(t)] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["form", "quality", "toxic", "n"])

    counts = sample.mapInPandas(forms, "form string, quality int, toxic int, n long")
    total = {(r["quality"], r["toxic"]): r["n"] for r in sample.groupBy("quality", "toxic").agg(F.count("*").alias("n")).collect()}
    told: dict[str, list[str]] = {}
    for target in TARGETS:
        k = TARGETS.index(target)
        size = [sum(n for g, n in total.items() if g[k] == v) for v in (0, 1)]
        if min(size) == 0:
            told[target] = []
            continue
        per = counts.groupBy("form").agg(*[F.sum(F.when(F.col(target) == v, F.col("n")).otherwise(0)).alias(f"n{v}") for v in (0, 1)])
        rate = [(F.col(f"n{v}") + 0.5) / (size[v] + 1.0) for v in (0, 1)]
        spread = F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
        top = per.filter("n0 + n1 >= 8").select("form", (F.abs(F.log(rate[1]) - F.log(rate[0])) / spread).alias("z")).filter("z >= 4") \
            .orderBy(F.desc("z"), "form").limit(TELLING // 2)
        told[target] = [r["form"] for r in top.collect()]

    names = sorted({*told["quality"], *told["toxic"]})
    at = {f: i for i, f in enumerate(names)}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, reader = [], Reader(at)
            for text, q, t in zip(b["text"], b["quality"], b["toxic"]):
                shaped, held = reader.read(text or "")
                rows.append((int(q), int(t), shaped, np.array(sorted(at[f] for f in held), np.int32)))
            yield pd.DataFrame(rows, columns=["quality", "toxic", "shape", "forms"])

    got = sample.mapInPandas(features, "quality int, toxic int, shape array<double>, forms array<int>").toPandas()
    models: dict[str, Model | None] = {}
    if not len(got):
        return dict.fromkeys(TARGETS)
    shapes = np.vstack(got["shape"].to_list())
    mean, scale = shapes.mean(0), np.maximum(shapes.std(0), 0.05)
    held = np.zeros((len(got), len(names)), bool)
    for i, f in enumerate(got["forms"]):
        held[i, f] = True
    for target in TARGETS:
        y = got[target].to_numpy(float)
        if y.min() == y.max():
            models[target] = None
            continue
        own = [at[f] for f in told[target]]
        bias, w = fit_logistic((shapes - mean) / scale, y, np.repeat([1.0, FORM_RIDGE], [SHAPES, len(own)]), marks=held[:, own])
        models[target] = Model(bias, w[:SHAPES], mean, scale, dict(zip(told[target], w[SHAPES:].tolist())))
    return models


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, quality, toxic) of at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of their ids."""
    clear = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").groupBy("doc_id") \
        .agg(*[f(c).alias(f"{c}_{n}") for c in TARGETS for n, f in (("lo", F.min), ("hi", F.max))]) \
        .filter("quality_lo = quality_hi AND toxic_lo = toxic_hi") \
        .select("doc_id", F.col("quality_lo").cast("int").alias("quality"), F.col("toxic_lo").cast("int").alias("toxic"))
    chosen = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                 .groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text")).select("text", "quality", "toxic"), "sample")


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_shifts(sites: DataFrame) -> DataFrame:
    """(host, path, shift_quality, shift_toxic) from ``sites(host, path, n, quality, toxic)``, sums of evidence.

    The strengths of shrinkage are estimated from all sites; nine numbers reach the driver.
    """
    hosts = sites.groupBy("host").agg(*[F.sum(c).alias(f"{c}_host") for c in ("n", *TARGETS)])
    total = sites.agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    if not total["n"]:
        return sites.select("host", "path", *[F.lit(0.0).alias(f"shift_{t}") for t in TARGETS])
    both = sites.join(hosts, sites["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    rate = {t: min(max(total[t] / total["n"], 1e-6), 1 - 1e-6) for t in TARGETS}

    def strength(df: DataFrame, n: str, own, parent, t: str):
        spread = F.sum(F.col(n) * (own - parent) ** 2) / F.sum(n) - F.count("*") * rate[t] * (1 - rate[t]) / F.sum(n)
        return F.least(F.greatest(rate[t] * (1 - rate[t]) / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))

    k_host = hosts.agg(*[strength(hosts, "n_host", F.col(f"{t}_host") / F.col("n_host"), F.lit(rate[t]), t).alias(t) for t in TARGETS]).first()
    k_path = both.agg(*[strength(both, "n", F.col(t) / F.col("n"), F.col(f"{t}_host") / F.col("n_host"), t).alias(t) for t in TARGETS]).first()
    out = both
    for t in TARGETS:
        host = (k_host[t] * rate[t] + F.col(f"{t}_host")) / (k_host[t] + F.col("n_host"))
        path = (k_path[t] * host + F.col(t)) / (k_path[t] + F.col("n"))
        out = out.withColumn(f"shift_{t}", _logit(path) - _logit(F.lit(rate[t])))
    return out.select("host", "path", *[f"shift_{t}" for t in TARGETS])


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, text_hash, p_quality, p_toxic, keep), one row per row of ``docs``. Texts are read once and not shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(training_sample(docs, labels)))

    @F.pandas_udf("quality double, toxic double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = [shared.value[t] for t in TARGETS]
        reader = Reader(f for m in models if m for f in m.forms)  # of this task: freed at its end
        for texts in batches:
            rows = []
            for text in texts:
                if not text or not any(models):
                    rows.append((0.0, 0.0))
                    continue
                s, f = reader.read(text)
                rows.append(tuple(m.score(s, f) if m else 0.0 for m in models))
            yield pd.DataFrame(rows, columns=list(TARGETS))

    has = (F.length("text") > 0) & F.lit(any(shared.value.values()))
    scored = stage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"),
                               evidence("text").alias("e"), F.coalesce(has, F.lit(False)).alias("has")).select("*", "e.*").drop("e"), "evidence")
    sites = stage(scored.filter("has").groupBy("host", "path").agg(
        F.count("*").alias("n"), *[F.sum(1 / (1 + F.exp(-F.col(t)))).alias(t) for t in TARGETS]), "sites")
    shifts = stage(site_shifts(sites), "shifts").toDF("_host", "_path", *[f"_shift_{t}" for t in TARGETS])
    # sites are broadcast only up to a bound; larger tables are joined by shuffle
    small = shifts.count() <= BROADCAST_SITES
    joined = scored.join(F.broadcast(shifts) if small else shifts, scored["host"].eqNullSafe(shifts["_host"]) & scored["path"].eqNullSafe(shifts["_path"]), "left")
    p = {t: 1 / (1 + F.exp(-(F.col(t) + F.coalesce(F.col(f"_shift_{t}"), F.lit(0.0))))) for t in TARGETS}
    known = {t: F.lit(shared.value[t] is not None) & F.col("has") for t in TARGETS}
    keep = ~(known["toxic"] & (p["toxic"] >= TOXIC_CUT)) & ~(known["quality"] & (p["quality"] < QUALITY_CUT))
    return joined.select("doc_id", "text_hash", p["quality"].alias("p_quality"), p["toxic"].alias("p_toxic"), keep.alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` with ``p_quality``, ``p_toxic`` and ``keep``. Rows that repeat id and text get the strictest of their scores."""
    per = quality_scores(docs, labels, host, path).groupBy("doc_id", "text_hash").agg(
        F.min("p_quality").alias("p_quality"), F.max("p_toxic").alias("p_toxic"), F.min("keep").alias("keep"))
    # the row travels as one value, so its column names meet no others
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("hash"))
    joined = rows.join(per, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    return joined.select(*[F.col("whole")[c].alias(c) for c in docs.columns if c not in ("p_quality", "p_toxic", "keep")], "p_quality", "p_toxic", "keep")
