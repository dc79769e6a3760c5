"""The training-data operators against brute force, round trips and held-out labels, on small fixtures with odd rows."""
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from apexgrid.llm import fingerprints, jaccard_join, licenses, packing, quality, secrets, token_shards, url_filter
from apexgrid.llm.components import connected
from apexgrid.llm.decontaminate import decontaminated, leaks, sketch_length
from apexgrid.llm.line_dedup import line_report, without_repeated_lines
from apexgrid.llm.packing import WordTokenizer, pack
from apexgrid.llm.quality import classify, site_shifts
from apexgrid.llm.shingles import shingles, shingles_of, windows, word_hashes
from apexgrid.llm.token_shards import permuted, read_sequences, write_shards
from apexgrid.session import BATCH_ROWS

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, id long, place int"
WORD_BPE = P.path("word_bpe_49k.json")
VOCABULARY = ["the", "of", "Is", "thand", "ereon", "édon", "whst", "a,", "in.", "on", "ing", "lyea", "tion", "heor", "x9"]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None, k, k, k) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def near_copy(rng, text, edits=1):
    words = text.split(" ")
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[k:k + 1] = [rng.choice(VOCABULARY)] if kind == 0 else [] if kind == 1 and len(words) > 1 else [words[k], "new"]
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empty, blank, tiny and long texts, exact copies, a large group of near copies, chains of edits."""
    rng = random.Random(5)
    texts = [None, "", "  \n ", "one", "one two three four", "One  two\nthree four", "a b c d e", "a b c d e"]
    base = sentence(rng, 60)
    texts += [base] * 12 + [near_copy(rng, base, e) for e in (1, 1, 2, 2, 3, 3, 4, 5) for _ in range(5)]
    for n in (6, 8, 9, 11, 12, 15, 40):
        t = sentence(rng, n)
        texts += [t, near_copy(rng, t), near_copy(rng, t)]
    chain = sentence(rng, 80)
    for _ in range(8):
        chain = near_copy(rng, chain, 2)
        texts.append(chain)
    texts += [sentence(rng, rng.randrange(1, 50)) for _ in range(40)] + ["q " * 3000, " ".join(f"w{k}" for k in range(5000))]
    rng.shuffle(texts)
    return texts


def test_shingles(corpus):
    for t, own in zip(corpus, shingles_of(corpus)):
        assert (own == shingles(t)).all() and len(own) == len(shingles(t))
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        want = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        assert len(own) == len(want)
    assert (windows(word_hashes("A b\x0bC d e f")) == windows(word_hashes("a  b c\rD e\nf"))).all()
    assert len(word_hashes("a\x1fb\u00a0c")) == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["id"]: r["comp"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets))


@pytest.mark.parametrize("short_list,block", [(32, 1 << 19), (1, 300)])
def test_jaccard_components(spark, corpus, monkeypatch, short_list, block):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = jaccard_join.jaccard_components(frame(spark, corpus)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_components(corpus)


def test_jaccard_near_rows_lose_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 40, 60, 64, 66, 90, 130, 300):
        for _ in range(6):
            a = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, n))
            sets += [a, a[rng.random(len(a)) > 0.1], np.union1d(a, rng.integers(-2 ** 63, 2 ** 63 - 1, n // 4))]
    n, comp = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2
    probe = rng.random(len(sets)) < 0.7
    linked, fits = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    for a in range(len(sets)):
        for b in np.flatnonzero(probe & (comp != comp[a])):
            both = len(np.intersect1d(sets[a], sets[b]))
            linked[[a, b]] |= 100 * both >= 75 * (n[a] + n[b] - both)
            fits[[a, b]] |= both >= 0.6 * (n[a] + n[b] - both)
    near = jaccard_join.near_rows(n, comp, [jaccard_join._parity(s) for s in sets], np.ones(len(sets), bool), probe, 75)
    assert linked.any() and not (linked & ~near).any()
    assert not (near & ~fits & (n > 30)).any()


def test_jaccard_blocks_get_only_sets_that_may_link(spark, monkeypatch):
    rng = random.Random(12)
    common = " ".join(f"c{k}" for k in range(30))
    texts = [common + " " + " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(40)) for _ in range(60)]
    texts += [texts[3] + " end", texts[50] + " end"]
    sent = []
    block_links = jaccard_join._block_links

    def seen(members, sets, percent):
        sent.append({r["id"] for r in members.collect()})
        return block_links(members, sets, percent)
    monkeypatch.setattr(jaccard_join, "_block_links", seen)
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda docs, width: (np.empty(0, np.int64), np.empty(0, np.int64)))
    monkeypatch.setattr(jaccard_join, "_pivot_pairs", lambda lists, percent: spark.createDataFrame([], "a long, b long"))
    got = jaccard_join.jaccard_components(frame(spark, texts)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_components(texts)
    assert sent == [{3, 50, 60, 61}]


def test_jaccard_light_sets_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for n in range(5, 17):
        t = [f"u{rng.randrange(10 ** 6)}" for _ in range(n)]
        texts += [" ".join(t), " ".join(t + ["z"]), " ".join(t[1:]), " ".join(["y"] + t)]
    for bound in (1, 8, jaccard_join.MAX_LIGHT + 1):
        monkeypatch.setattr(jaccard_join, "_boundary", lambda rows, percent, b=bound: b)
        got = jaccard_join.jaccard_components(frame(spark, texts)).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_jaccard_texts_travel_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, met, written = spark.conf.get(key), [], jaccard_join.stage

    def seen(df, label):
        met.append(int(spark.conf.get(key)))
        return written(df, label)
    monkeypatch.setattr(jaccard_join, "stage", seen)
    docs = frame(spark, ["a b c d e f", "a b c d e f", "x y"])
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {0, 2}
    assert set(met) == {BATCH_ROWS} and spark.conf.get(key) == own
    met.clear()
    spark.conf.set(key, "7")
    try:
        jaccard_join.jaccard_components(docs)
    finally:
        spark.conf.set(key, own)
    assert set(met) == {7}


@pytest.mark.parametrize("counted", [False, True])
def test_jaccard_lists_of_the_same_members_are_one(spark, monkeypatch, counted):
    if not counted:
        monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda docs, width: (np.empty(0, np.int64), np.empty(0, np.int64)))
    monkeypatch.setattr(jaccard_join, "_boundary", lambda rows, percent: 9)
    rng = random.Random(21)
    texts = []
    for n in (8, 10, 12, 60, 200):
        t = " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(n))
        texts += [t, t + " end", "start " + t, near_copy(rng, t), t[:len(t) // 2] + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(n))]
    # 25 has two texts of the same length
    ids = [*range(len(texts)), 25, 25]
    texts += [texts[15] + " other", texts[15] + " another"]
    rows = jaccard_join.stage(jaccard_join._token_rows(frame(spark, texts, ids), 75, 5), "tokens")
    lists, want, got = defaultdict(list), Counter(), defaultdict(list)
    for r in rows.filter("n > 1").collect():
        tokens = r["prefix"] + r["common"] if 100 * r["n"] >= 75 * 9 else []
        for h in tokens:
            lists[h].append((r["doc_id"], r["n"], 1))
        for h in jaccard_join.subset_keys(np.array(r["small"], np.int64), 75) if r["small"] and r["n"] < 9 else []:
            lists[h].append((r["doc_id"], r["n"], 2))
    for members in lists.values():
        if len({m[0] for m in members}) > 1:
            for member in {m[:2] for m in members}:
                want[(frozenset(m[:2] for m in members), len(members), member)] += sum(m[2] for m in members if m[:2] == member)
    for r in jaccard_join._lists(rows, 75).collect():
        got[r["h"]].append(((r["id"], r["n"]), r["w"], (r["pivot"], r["pn"])))
    merged = [(frozenset(m for m, _, _ in members), m, w) for members in got.values() for m, w, _ in members]
    assert len({(k, m) for k, _, m in want}) < len(merged) + 1 < sum(want.values()) / 2
    assert sorted((sorted(k), m, w) for k, m, w in merged) == sorted((sorted(k), m, w) for (k, _, m), w in want.items())
    assert all(len({p for _, _, p in members}) == 1 and members[0][2] in {m for m, _, _ in members} for members in got.values())


def test_jaccard_sketches_that_no_pair_asks_for_are_not_shuffled(spark):
    sketches = spark.createDataFrame([(k, 3, [k, -k]) for k in range(2000)], "id long, n long, sketch array<long>")
    asked = spark.createDataFrame([(5,), (1999,), (5,), (-1,)], "id long")
    assert sorted(map(tuple, jaccard_join._asked(sketches, asked).collect())) == [(5, 3, [5, -5]), (1999, 3, [1999, -1999])]
    assert jaccard_join._asked(sketches, asked.filter("id = 0")).count() == 0


def test_jaccard_repeated_ids_and_empty_table(spark):
    a, b = sentence(random.Random(1), 30), " ".join(f"v{k}" for k in range(30))
    ids, texts = [7, 7, 3, 9, None, 5], [a, b, a, b + " end", a, None]
    got = jaccard_join.jaccard_components(frame(spark, texts, ids))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(3, 3), (5, 5), (7, 3), (7, 3), (9, 3)]
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    """(doc_id, n_lines, removed places, text left)."""
    seen, out = [], []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n") if text is not None else []
        gone = []
        for k, line in enumerate(lines):
            words = [w for w in re.split("[ \t\n\x0b\f\r]+", line) if w]
            if len(words) < 5:
                continue
            if any(abs(len(w) - len(words)) <= 1 and word_edits(w, words) <= 1 for w in seen):
                gone.append(k)
            seen.append(words)
        out.append((doc, len(lines), len(gone), ",".join(map(str, gone)), None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [sentence(rng, rng.randrange(1, 14)) for _ in range(25)]
    pool += ["page 1 of the long report", "page 2 of the long report", "page 3 of the long report", "a b a b a b", "a b a b a b a b", "b a b a b a"]
    pool += [near_copy(rng, p) for p in pool for _ in range(2)] + ["", "  ", "the common line that all have"]
    texts = [None, "", "\n\n"] + ["\n".join(["the common  line that all have"] + [rng.choice(pool) for _ in range(rng.randrange(1, 9))]) for _ in range(60)]
    texts += ["w " * 4000 + "\n" + "w " * 4001]
    want = brute_lines(list(enumerate(texts)))
    docs = frame(spark, texts).repartition(5)
    assert sorted(map(tuple, line_report(docs).collect())) == [w[:4] for w in want]
    cleaned = without_repeated_lines(docs)
    assert cleaned.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in cleaned.collect()) == [(w[0], w[4]) for w in want]


def test_line_dedup_settles_short_copies(spark):
    rng = random.Random(8)
    pool = ["six", "  six ", "All rights reserved.", "All rights  reserved.", "All rights kept.", "a b c d", "a b c d e", "a b c d f", "a b c", "", "  "] + [sentence(rng, n) for n in (1, 2, 3, 4, 5, 9)]
    rows = [(k, "\n".join(["page end"] + [rng.choice(pool) for _ in range(rng.randrange(1, 7))])) for k in range(40)]
    seen, want, cleaned = [], [], []
    for doc, text in rows:
        lines, gone = text.split("\n"), []
        for k, line in enumerate(lines):
            words = line.split()
            if words and any(w == words or min(len(w), len(words)) >= 5 and word_edits(w, words) <= 1 for w in seen):
                gone.append(k)
            seen.append(words)
        want.append((doc, len(lines), len(gone), ",".join(map(str, gone))))
        cleaned.append((doc, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    docs = frame(spark, [t for _, t in rows]).repartition(3)
    assert sorted(map(tuple, line_report(docs, exact_words=1).collect())) == want
    assert sorted((r["doc_id"], r["text"]) for r in without_repeated_lines(docs, exact_words=1).collect()) == cleaned
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()) == cleaned


def test_line_dedup_odd_rows(spark):
    t = "one two three four five\nsix"
    docs = frame(spark, [t, t, t, t], [None, 2, 2, 1])
    assert sorted((str(r["doc_id"]), r["text"]) for r in without_repeated_lines(docs).collect()) == [("1", t), ("2", "six"), ("2", "six"), ("None", t)]
    assert [r["n_removed"] for r in line_report(docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [0, 0, 1, 1]
    assert line_report(frame(spark, [])).count() == 0


def test_secrets(spark):
    rng = random.Random(4)
    b64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    sha, uuid = hashlib.sha1(b"x").hexdigest(), "123e4567-e89b-12d3-a456-426614174000"
    texts = [None, "", "plain words only", f"é key {b64} end", f"TOKEN = '{sha}'", f"token=secret:abcdefghij {uuid}", "AKIA" + "A1" * 8 + " AKIAshort AKIA123456789012",
             "0123456789abcdef" * 3, "password: short", "Apikey=abcdefgh pa\u017f\u017fword=abcdefgh api_key : \"abcdefgh+/=\"", "x" * 50000 + " " + b64 * 300, "2024-01-02T03:04:05 4644-3483-9801-0899",
             "some_long_identifier_name mail3.example.com/path/to/page7"]
    encoding = secrets._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    def brute(t):
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[1]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        return sorted(base)
    rows = {r["doc_id"]: r for r in secrets.digest_columns(secrets.scan_secrets(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).collect()}
    for k, t in enumerate(texts):
        base = brute(t)
        text = ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in base)
        assert rows[k]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert [rows[k][f"n_{n}"] for n in secrets.KINDS[:3]] == [sum(x[1] == i for x in base) for i in range(3)]
        assert set(text.split(",")) - {""} <= set(rows[k]["spans"].split(","))
    dense = {k for k in rows if rows[k]["n_dense"]}
    assert {3, 10} <= dense and not dense & {0, 1, 2, 4, 7, 11, 12}
    assert not secrets.is_known(b64) and secrets.is_known(uuid) and secrets.is_known(sha.upper())
    assert secrets.ratio(b64, encoding) < secrets.MAX_RATIO
    assert secrets.scan_secrets(frame(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def random_keys(rng, letters, digits=0, n=300, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"):
    return ["".join(rng.choice(alphabet) for _ in range(letters)) + "".join(rng.choice("0123456789") for _ in range(digits)) for _ in range(n)]


def test_secrets_in_irregular_case_but_no_words(spark):
    rng = random.Random(6)
    encoding = secrets._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    def dense(t):
        return [s for s in secrets.find_spans(t, encoding) if s[0] == "dense"]
    for letters, digits in ((20, 0), (32, 0), (20, 4)):
        keys = random_keys(rng, letters, digits)
        assert sum(dense(f"key {k} end") == [("dense", 4, 4 + len(k))] for k in keys) >= 0.98 * len(keys)
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL").select("text").collect() for w in re.findall("[A-Za-z]{16,}", r["text"])}
    assert len(words) > 50 and not [w for w in words if dense(w)]
    for t in ("thattionthhewherndtion", "SOME_LONG_CONSTANT_NAME", "Dieschaulichlich", "someLongIdentifierName12", "getUserName/SetOtherValue.toString", "/".join(["some/Long_path2"] * 3000)):
        assert not dense(t)


def test_secrets_inside_longer_runs(spark):
    rng = random.Random(7)
    encoding = secrets._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    def dense(t):
        return [s[1:] for s in secrets.find_spans(t, encoding) if s[0] == "dense"]
    for before, after in (("docs.example.com/downloads/documents/reports/session=", ""), ("downloads/documents/" * 2000, "/reports/summary/documents/index.html")):
        keys = random_keys(rng, 24, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")[:200]
        found = sum(dense(f"see {before}{k}{after} end") == [(4 + len(before), 28 + len(before))] for k in keys)
        assert found >= 0.98 * len(keys)
    # a key with separators of its own is one span, two keys are two
    before, k1, k2 = "docs.example.com/downloads/documents/reports/information/downloads/documents/session=", "q7Zk2LxV9tBw", "Xr4mPw8sUe3Jh6Gd"
    assert dense(before + k1 + "/" + k2) == [(len(before), len(before) + 29)]
    two = before + k2 + "/documents/reports/downloads/information/token=" + k2[::-1]
    assert dense(two) == [(len(before), len(before) + 16), (len(two) - 16, len(two))]
    sha, uuid = hashlib.sha1(b"x").hexdigest(), "123e4567-e89b-12d3-a456-426614174000"
    for t in (f"example.com/documents/commit/{sha}/reports", f"example.com/documents/item/{uuid}/reports", "example.com/documents/2024/01/02/page7/report-12.html",
              "example.com/documents/archive/20240102T030405Z/report.html", "documents/en-US/de-DE/v1.2.3/information/page2"):
        assert not dense(t), t


def test_fingerprints(spark, corpus):
    texts = corpus[:90] + [sentence(random.Random(8), 900), "a" * 40000, "ab" * 9000]
    order = sorted(range(len(texts)), reverse=True)
    want = {}
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        new = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        want[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(new))
    for parts in (1, 4, 23):
        rows = fingerprints.neighbour_fingerprints(frame(spark, texts), parts).collect()
        assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in rows} == want and len(rows) == len(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
        long_ = [r for r in rows if r["n_chars"] > 150 and len(set(texts[r["doc_id"]])) > 3]
        assert sum(r["near_edited"] for r in long_) / len(long_) > 0.55
    words = [sentence(random.Random(k), 300) for k in range(20)]
    rows = fingerprints.neighbour_fingerprints(frame(spark, words)).collect()
    assert max(r["near_next"] for r in rows) < 0.3 < 0.45 < min(r["near_edited"] for r in rows)
    same = fingerprints.neighbour_fingerprints(frame(spark, ["one and the same text"] * 4 + [None], [4, 4, 2, 1, None])).collect()
    assert sorted((str(r["doc_id"]), r["near_next"]) for r in same) == [("1", 0.0), ("2", 1.0), ("4", 1.0), ("4", 1.0), ("None", 0.0)]
    assert fingerprints.neighbour_fingerprints(frame(spark, [])).count() == 0
    one = fingerprints.neighbour_fingerprints(frame(spark, ["alone here"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_signature_is_local():
    rng = random.Random(6)
    a = sentence(rng, 500)
    b = a[:1200] + "#" + a[1200:]
    fa, fb = fingerprints.fingerprint(a).split(":"), fingerprints.fingerprint(b).split(":")
    assert fa[0] == fb[0] and len(fa[1]) <= fingerprints.CHUNKS
    assert sum(x != y for x, y in zip(fa[1], fb[1])) <= 3 or len(fa[1]) != len(fb[1])


def test_word_tokenizer():
    from tokenizers import Tokenizer
    rng = random.Random(7)
    alphabet = list("aAbé'st. ,\n\t  \u00a0\u2028\x1c\x1d\u0301\u1e9bİßΣς漢字😀0123|&*-") + ["'s", " ", "<|endoftext|>"]
    texts = ["", " ", "x" * 500] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    one = Tokenizer.from_file(WORD_BPE)
    want = [np.array(one.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    mine = WordTokenizer(WORD_BPE)
    assert mine.encode(texts) == want
    assert mine.encode(texts[::-1]) == want[::-1]


@pytest.mark.parametrize("tokens,segments,loss", [(64, 512, None), (64, 3, 50)])
def test_packing(spark, corpus, tokens, segments, loss):
    mine = WordTokenizer(WORD_BPE)
    docs = frame(spark, corpus, list(range(len(corpus) - 1)) + [None]).repartition(3)
    rows = pack(docs, WORD_BPE, 2, tokens, segments, loss).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert len(by_doc) == len(corpus)
    for k, t in enumerate(corpus):
        pieces = sorted(by_doc[k if k < len(corpus) - 1 else None], key=lambda r: r["start"])
        whole = mine.encode([t or ""])[0] + np.array([2], "<u4").tobytes()
        assert b"".join(bytes(p["ids"]) for p in pieces) == whole
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        assert {p["doc_tokens"] for p in pieces} == {len(whole) // 4} and all(p["length"] > 0 for p in pieces)
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        total = sum(p["length"] for p in pieces)
        assert total <= tokens and len(pieces) <= segments and total <= (loss or tokens)
        padding += 0 if total & (total - 1) == 0 else tokens - total
    assert padding == 0
    assert pack(frame(spark, []), WORD_BPE, 2).count() == 0


def test_packing_prompts(spark):
    rows = spark.createDataFrame([(k, "the of in " * 5, "of the tion " * 4) for k in range(40)], "conv long, prompt string, answer string")
    pieces = pack(rows, WORD_BPE, 2, 64, 8, 20, text="answer", prompt="prompt", key="conv").collect()
    prompt = {k: len(WordTokenizer(WORD_BPE).encode(["the of in " * 5])[0]) // 4 for k in range(40)}
    loss = Counter()
    for p in pieces:
        loss[p["sequence_id"]] += max(0, p["start"] + p["length"] - max(p["start"], prompt[p["conv"]]))
    assert max(loss.values()) <= 20 and sum(p["length"] for p in pieces) == sum({p["conv"]: p["doc_tokens"] for p in pieces}.values())


def test_token_shards(spark, corpus):
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 99):
            slots = permuted(np.arange(n), n, key)
            assert sorted(slots.tolist()) == list(range(n))
            assert (permuted(slots, n, key, inverse=True) == np.arange(n)).all()
    docs = frame(spark, corpus, list(range(len(corpus) - 1)) + [None]).repartition(4)
    folder = write_shards(docs, WORD_BPE, 2, key=5, length=64, per_shard=16)
    rows = sorted(read_sequences(spark, folder, 16).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all(r["shard"] == r["slot"] // 16 and r["offset"] == r["slot"] % 16 * 128 and len(r["record"]) == 128 for r in rows)
    tail = read_sequences(spark, folder, 16, from_slot=37).collect()
    assert sorted((r["slot"], bytes(r["record"])) for r in tail) == [(r["slot"], bytes(r["record"])) for r in rows[37:]]
    # back in written order, every task's stream is its documents' ids and ends
    index = permuted(np.arange(len(rows)), len(rows), 5)
    stream = np.concatenate([np.frombuffer(rows[s]["record"], "<u2")[:rows[s]["n_tokens"]] for s in index])
    mine = WordTokenizer(WORD_BPE)
    want = Counter(mine.encode([t or ""])[0] for t in corpus)
    ends = np.flatnonzero(stream == 2)
    got = Counter(stream[a:b].astype("<u4").tobytes() for a, b in zip(np.concatenate([[0], ends[:-1] + 1]), ends))
    assert got == want
    held = {d for r in rows for d in r["docs"]}
    assert held == {*range(len(corpus) - 1), None}
    empty = write_shards(frame(spark, []), WORD_BPE, 2, key=5)
    assert read_sequences(spark, empty).count() == 0


def test_token_shards_are_shuffled_once(spark, corpus, tmp_path, monkeypatch):
    docs, plans = frame(spark, corpus * 3).repartition(3), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(token_shards, "TASK", 1 << 12)
    writer = type(docs.write)
    parquet = writer.parquet

    def seen(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, path, *a, **k)
    monkeypatch.setattr(writer, "parquet", seen)
    try:
        folder = write_shards(docs, WORD_BPE, 2, 5, str(tmp_path / "s"), length=64, per_shard=4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans[-1] and "rangepartitioning(shard" not in plans[-1]
    rows = read_sequences(spark, folder, 4).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    # a file holds neighbouring shards, of a bounded number of bytes
    held = [{r["shard"] for r in spark.read.parquet(f).select("shard").collect()} for f in spark.read.parquet(folder).inputFiles()]
    assert all(len(h) == max(h) - min(h) + 1 <= (1 << 12) // (4 * 128) + 1 for h in held if h)
    assert sum(map(len, held)) == len(set().union(*held))


def test_words_met_often_stay_remembered():
    mine, learned = WordTokenizer(WORD_BPE), Counter()
    mine.remembered = 20_000
    learn = mine._learn

    def seen(words):
        learned.update(words)
        return learn(words)
    mine._learn = seen
    texts = [f"often q{k}a w{k}b e{k}c r{k}d " * 2 for k in range(400)]
    assert [mine.encode([t])[0] for t in texts] == WordTokenizer(WORD_BPE).encode(texts)
    assert learned["often"] == 1 and mine._held <= 20_000
    mine.forget()
    assert not mine._seen and not mine._past


def test_words_are_remembered_without_punctuation_at_their_end():
    mine, learned = WordTokenizer(WORD_BPE), Counter()
    learn = mine._learn

    def seen(words):
        learned.update(words)
        return learn(words)
    mine._learn = seen
    texts = ["édon x9, x9! a'b. ", "édon, lyea... (x9", "édon&&& lyea! édon,édon, a'b.", ".,; ! édon."]
    assert [mine.encode([t])[0] for t in texts] == [WordTokenizer(WORD_BPE).encode([t])[0] for t in texts] == WordTokenizer(WORD_BPE).encode(texts)
    assert learned["édon"] == learned["lyea"] == learned["x9,"] == 1 and not {"édon,", "lyea!", "lyea..."} & set(mine._seen)


def test_packing_encodes_texts_in_parts(spark, corpus, monkeypatch):
    """The pieces do not depend on how many texts are encoded together."""
    docs = frame(spark, corpus + [None, None]).coalesce(1)
    want = pack(docs, WORD_BPE, 2, 64).collect()
    monkeypatch.setattr(packing, "CHARS", 200)
    assert pack(docs, WORD_BPE, 2, 64).collect() == want and len(want) > len(corpus)
    nulls = pack(frame(spark, [None, None, ""]).coalesce(1), WORD_BPE, 2, 64).collect()
    assert [(r["doc_id"], r["doc_tokens"]) for r in sorted(nulls, key=lambda r: r["doc_id"])] == [(0, 1), (1, 1), (2, 1)]


def test_glob_automaton():
    rng = random.Random(11)
    globs = ["", "*", "**", "a", "ab*", "**ab", "a?b", "*.org/**", "a*b/**c", "**/ads/**", "x" * 70 + "*", "*" + "y" * 130, "?*?"]
    auto = url_filter.GlobAutomaton(globs)

    def regex(g):
        return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", g)), re.DOTALL)
    urls = ["", "a", "ab", "é", "a/b", "w.org/", "x" * 75, "y" * 130, "z" + "y" * 130] + ["".join(rng.choice("ab/.x?é") for _ in range(rng.randrange(0, 12))) for _ in range(500)]
    want = np.array([[bool(regex(g).fullmatch(u)) for g in globs] for u in urls])
    assert (auto.matches(urls) == want).all()
    assert auto.matches([]).shape == (0, len(globs))
    with pytest.raises(ValueError):
        url_filter.GlobAutomaton(["é"])


def test_url_filter(spark):
    from apexgrid.llm.queries import BLOCKED, RULES
    urls = [None, "", "no scheme.org/x", "http://A.Example.ORG/es/1?q#f", "http://example.org/en/12", "https://xexample.org/en/1", "http://org/", "http://org", "ftp://u@com:80/fr/",
            "http://a.com/fr/", "http://a.com/de/?x", "http://evil.net/x.org/", "http://evil.net/a://b.org/", "https://free-bets.example.net/en/1", "http://h.net#/x", "http://é.org/É"] + ["http://a.org/" + "p" * 20000]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")

    def brute(u):
        rest = re.split("[?#]", u.split("://", 1)[1])[0] if u and "://" in u else ""
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m.group().lower(), host), slash + path
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        bad = re.search("casino|adult-|free-bets|spam-farm|cheap-pills|ads-track", host) or "/ads/" in path or (host + path).endswith(".exe")
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "block" if bad else "allow")
    got = url_filter.judge_urls(pages, RULES, BLOCKED).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {k: brute(u) for k, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), RULES, BLOCKED).count() == 0


def test_decontamination(spark, corpus):
    rng = random.Random(12)
    items = [None, "", "one", "one two three four", "a b c d e"] + [" ".join(f"i{k}x{j}" for j in range(n)) for k, n in enumerate((5, 6, 9, 15, 40, 57))]
    texts = corpus + [sentence(rng, 300) + " " + i.upper() + " " + sentence(rng, 200) for i in items[5:]]
    texts += [sentence(rng, 20) + " " + " ".join(items[-1].split()[k:k + m]) for k, m in ((0, 40), (3, 46), (0, 43), (0, 44), (10, 47))]

    def sets(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    want = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            if sets(x) and 100 * len(sets(x) & sets(t)) >= 75 * len(sets(x)):
                want.add((d, i, len(sets(x)), len(sets(x) & sets(t))))
    bench = spark.createDataFrame([(i, x, 0) for i, x in enumerate(items)] + [(None, "a b c d e", 0), (4, "a b c d e", 1)], "item_id long, text string, found int")
    docs = frame(spark, texts)
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in leaks(docs, bench).collect()}
    assert got == want and leaks(docs, bench).count() == len(want)
    left = decontaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminated(docs, bench.limit(0)).count() == len(texts) and leaks(docs.limit(0), bench).count() == 0
    assert all(sketch_length(n, 75) >= min(n, n - -(-75 * n // 100) + 1) for n in range(1, 2000))


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = classify(docs, train).join(test, "doc_id").select("p_quality", "p_toxic", "keep", "quality", "toxic").toPandas()
    assert ((rows["p_quality"] >= 0.5) == (rows["quality"] == 1)).mean() > 0.98
    assert ((rows["p_toxic"] >= 0.3) == (rows["toxic"] == 1)).mean() > 0.97
    clean, toxic = rows[(rows["quality"] == 1) & (rows["toxic"] == 0)], rows[rows["toxic"] == 1]
    assert clean["keep"].mean() > 0.99 and toxic["keep"].mean() < 0.25


def test_logistic_fit_holds_no_matrix_of_all_rows():
    rng = np.random.default_rng(3)
    x, marks = rng.normal(size=(4100, 5)), rng.random((4100, 300)) < 0.1
    y = (x[:, 0] + marks[:, :9].sum(1) + rng.normal(size=len(x)) > 1).astype(float)
    ridge = np.repeat([1.0, 0.1], [5, 300])
    want = quality.fit_logistic(np.hstack([x, marks]), y, ridge)
    tracemalloc.start()
    got = quality.fit_logistic(x, y, ridge, marks=marks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(x) * 300 * 8  # bytes of one such matrix
    assert np.isclose(got[0], want[0]) and np.allclose(got[1], want[1])
    # a ridge fit is where the gradient vanishes
    p = 1 / (1 + np.exp(-(got[0] + np.hstack([x, marks]) @ got[1])))
    assert np.abs(np.hstack([x, marks]).T @ (p - y) + ridge * got[1]).max() < 1e-6


def test_quality_odd_rows(spark):
    rng = random.Random(13)
    texts = [None, ""] + [sentence(rng, 30) + (" scum" if k % 4 == 0 else "") for k in range(500)]
    docs = frame(spark, texts).withColumn("keep", F.lit("old"))
    labels = spark.createDataFrame([(k, 1, int(k >= 2 and (k - 2) % 4 == 0)) for k in range(400)] + [(3, 1, 1), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    assert len(got) == len(texts) and got[0]["keep"] and got[1]["keep"]
    assert [k for k in sorted(got) if k > 400 and not got[k]["keep"]] == [k for k in range(401, 502) if (k - 2) % 4 == 0]
    assert classify(docs, labels.limit(0)).filter("keep").count() == len(texts)
    assert classify(docs.limit(0), labels).count() == 0
    nulls = docs.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    assert classify(nulls, labels).filter("keep").count() == sum(r["keep"] for r in got.values())


def test_site_shifts_shrink_sparse_sites(spark):
    sites = [("big", "a", 10000, 9000.0, 100.0), ("big", "b", 1, 0.0, 1.0), ("bad", "a", 4000, 400.0, 2000.0), (None, None, 1, 0.0, 1.0)]
    got = {(r["host"], r["path"]): r for r in site_shifts(spark.createDataFrame(sites, "host string, path string, n long, quality double, toxic double")).collect()}
    assert got["bad", "a"]["shift_quality"] < -1 and got["bad", "a"]["shift_toxic"] > 1
    assert abs(got["big", "b"]["shift_quality"] - got["big", "a"]["shift_quality"]) < 1
    assert abs(got[None, None]["shift_toxic"]) < abs(got["bad", "a"]["shift_toxic"])


def test_licenses(spark):
    mit = next(t for t, lb in licenses.TEMPLATES.items() if lb == "mit")
    words = mit.split()
    gpl3 = "This work is licensed under the GNU General Public License, version 3."
    texts = [None, "", "a b", "Released under the MIT License.", "under the mit-license under THE mit LICENSE! cc by-nc cc by nc", "apache license, version 2.0 and Version 3", "under the \u212aMIT license",
             "é É9 under the mit\u0301 license", mit.upper(), " ".join(words[:8] + ["odd", "words"] + words[8:]), " ".join(words[:5]), gpl3, "x " * 5000 + "cc by nc", "under the mit license\n" * 40]

    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        at = [(k, lb) for p, lb in licenses.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        return (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({lb for _, lb in at})))
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert {k: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for k, r in rows.items()} == {k: brute(t) for k, t in enumerate(texts)}
    assert rows[8]["labels"] == rows[9]["labels"] == "mit" and rows[8]["score"] == 1.0 and 0.6 <= rows[9]["score"] < 1 and rows[10]["labels"] == ""
    assert rows[11]["labels"] == "gpl-3" and rows[0]["score"] == 0.0
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in rows.values())
    twice = licenses.scan_licenses(frame(spark, [texts[3]] * 3, [5, 5, None])).collect()
    assert [(r["n_base"], r["labels"]) for r in twice] == [(1, "mit")] * 3
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_crc_matches_zlib(spark):
    from apexgrid.llm.queries import packed
    rows = packed(frame(spark, ["the of in", None])).collect()
    mine = WordTokenizer(WORD_BPE)
    assert {r["doc_id"]: r["ids_crc32"] for r in rows if r["start"] == 0 and r["length"] == r["doc_tokens"]}.get(1) == zlib.crc32(np.array([2], "<u4").tobytes())
    assert sum(r["length"] for r in rows if r["doc_id"] == 0) == len(mine.encode(["the of in"])[0]) // 4 + 1
