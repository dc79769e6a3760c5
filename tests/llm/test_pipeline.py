"""The corpus pipeline against brute-force versions of its stages, on a small corpus with planted cases."""
import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import WordTokenizer, WORD_BPE, brute_components, brute_lines, frame, near_copy, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "h", "id", "place"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [" ".join(f"i{k}x{j}" for j in range(n)) for k, n in enumerate((15, 30))]
    line = sentence(rng, 12)
    # words of their own keep unrelated texts apart
    texts = [None, "", "short one " + sentence(rng, 30)] + ["\n".join([line] * (k % 3 == 0) + [sentence(rng, 25), " ".join(f"o{k}w{j}" for j in range(20))]) for k in range(60)]
    base = " ".join(f"n{j}" for j in range(120))
    texts += [base, near_copy(rng, base, 2), near_copy(rng, base, 3), base]
    texts += [f"lead{k} in " + " ".join(f"q{k}z{j}" for j in range(30)) + " " + i for k, i in enumerate(items)]
    texts += ["scum " + sentence(rng, 25) + "\n" + " ".join(f"t{k}w{j}" for j in range(20)) for k in range(12)]
    out = tmp_path_factory.mktemp("corpus")
    frame(spark, texts).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    toxic = [k for k, t in enumerate(texts) if t and "scum" in t]
    labels = [(k, 1, 0) for k in range(2, len(texts)) if k not in toxic] + [(k, 1, 1) for k in toxic[:9]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), texts, items, toxic


def test_stages(spark, folder):
    path, texts, items, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    made = {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(apply(spark, docs, path), name)
        assert docs.columns == COLUMNS
        made[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert list(made) == [n for n, _ in corpus_pipeline.STAGES[:-1]]

    first = made["quality_classifier"]
    judged = corpus_pipeline.classify(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert set(first) == {r["doc_id"] for r in judged.filter("keep").collect()} and {0, 1} <= set(first)
    second = {d: t for d, _, _, _, t in brute_lines(sorted(first.items()))}
    assert made["line_dedup"] == second
    rows = sorted(second.items())
    comp = {d: c for d, _, c in brute_components([t for _, t in rows], [d for d, _ in rows])}
    third = {d: t for d, t in rows if comp[d] == d}
    assert made["ngram_jaccard_join"] == third

    def sets(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    fourth = {d: t for d, t in third.items() if all(100 * len(sets(i) & sets(t)) < 75 * len(sets(i)) for i in items)}
    assert made["benchmark_decontamination"] == fourth

    pieces = corpus_pipeline.run(spark, path).collect()
    mine = WordTokenizer(WORD_BPE)
    got = {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == {d: len(mine.encode([t or ""])[0]) // 4 + 1 for d, t in fourth.items()}


def test_empty_corpus(spark, folder, tmp_path):
    path = folder[0]
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_that_share_an_id_stay(spark, folder):
    rng = random.Random(3)
    a, b = sentence(rng, 40), " ".join(f"z{k}" for k in range(40))
    docs = frame(spark, [a, b, a, None, None], [5, 5, 5, 6, None])
    out = corpus_pipeline.ngram_jaccard_join(spark, docs, folder[0])
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == sorted([(5, a), (5, b), (6, ""), (-1, "")]) and out.columns == COLUMNS
