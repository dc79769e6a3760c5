"""Operators 11 to 13 against brute force on small fixtures with odd rows."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from apexgrid.llm import personal, repair, spelling

# --- 11: spelling variants ---------------------------------------------------------------------------------------------
DOCS = "doc_id long, text string, word string, n long, side string, m int, affix string, x long, own string"


def doc_frame(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "w", k, "p", 1, "a", k, "o") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def brute_spelling(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    count = {w: n for w, n in count.items() if n >= 5 and len(w) >= 6}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    form, n_near = {}, {}
    for w in count:
        others = [o for o in count if near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-count[o], o), default=None)
        if best and count[best] >= 5 * count[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, n, n_near[w], form.get(w), count.get(form.get(w)), root(w)) for w, n in count.items())


@pytest.mark.parametrize("block", [4096, 7])
def test_spelling_groups(spark, block):
    rng = random.Random(4)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(25)] + ["racing", "aaaaaaa", "aaaaaa", "ÀÉîabcd", "÷×abcdef"]
    words = list(base)
    for w in base:
        for _ in range(6):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("abc") + w[k + 1:]]))
    texts = [None, "", " \n1 2", "a" * 5000 + " racing"]
    for w in words:
        texts += [f"{w}, {w.upper()} x-{w}9{w} short {w}"] * rng.choice([1, 1, 2, 5, 30])
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "racing " * 300), (None, "racinq " * 9)]
    got = spelling.spelling_groups(doc_frame(spark, [t for _, t in rows], [i for i, _ in rows]), block=block)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_spelling(rows)


def test_spelling_chain_and_empty(spark):
    counts = {"planeta": 5, "planets": 30, "planet": 160, "planed": 900}
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_groups(doc_frame(spark, [" ".join([w] * n) for w, n in counts.items()], [9001 + k for k in range(4)])).collect()}
    assert got["planets"][1] == got["planet"][1] == "planed" and got["planed"] == (None, "planed")
    assert spelling.spelling_groups(doc_frame(spark, [])).count() == 0


# --- 12: personal data -------------------------------------------------------------------------------------------------
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and (not 13 <= len(digits) <= 19 or sum(doubled) % 10) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


@pytest.mark.parametrize("letters", ["ab@.1_ ", "019. +-()", "0123456789 -", "@.a-1 \n", "+12 ()3.-x", "4 -2é　"])
def test_base_spans(letters):
    rng = random.Random(len(letters))
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
        assert personal.base_spans(t) == plain_spans(t), t


def test_long_texts_are_linear():
    for unit in ("a", "1", "1.", "+1", "1 ", "a@", "a@b.c_", "+1(" + "(" * 50):
        personal.identifiers(unit * 60_000)


def contexts(rows):
    """The bootstrapping in plain loops: accepted (row, start, end)."""
    before, after, plain, places = defaultdict(set), defaultdict(set), Counter(), []
    for row, (_, t) in enumerate(rows):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t[a:b]) for a, b in words]
        for k in range(len(low) - 2):
            plain["b", low[k], low[k + 1]] += 1
            plain["a", low[k + 1], low[k + 2]] += 1
        for i in personal.identifiers(t or ""):
            first = max(k for k, (a, _) in enumerate(words) if a <= i["start"])
            last = max(k for k, (a, _) in enumerate(words) if a < i["end"])
            keys = ([("b", low[first - 2], low[first - 1])] if first >= 2 else []) + ([("a", low[last + 1], low[last + 2])] if last + 2 < len(low) else [])
            value = re.sub(r"[\W_]+", "", t[i["start"]:i["end"]]).lower()
            places.append((row, i["kind"], i["start"], i["end"], value))
            for key in keys:
                before[key].add(value)
                plain[key] -= 1
                after[value].add(key)
    seeds = {v for _, k, _, _, v in places if k < 4}
    known = set()
    for _ in range(personal.ROUNDS):
        score = {}
        for key, values in before.items():
            good = len(values & (seeds | known))
            if len(values) >= personal.MIN_KNOWN and good >= personal.MIN_KNOWN:
                s = good / (good + personal.UNKNOWN * (len(values) - good) + max(0, plain[key]) + 1)
                if s >= personal.TRUST:
                    score[key] = s
        new = set()
        for v in after:
            miss = 1.0
            for key in after[v]:
                miss *= 1 - score.get(key, 0)
            if 1 - miss >= personal.TRUST - 1e-12 and v not in seeds:
                new.add(v)
        if new == known:
            break
        known = new
    return {(row, a, b) for row, k, a, b, v in places if k == 4 and v in known}


def test_personal_data(spark):
    rng = random.Random(8)
    word = lambda n: " ".join(rng.choice(["lorem", "Ipsum", "dolor", "sit", "é"]) for _ in range(n))
    texts = [None, "", " ", "99999", "x@localhost y@z"]
    texts += [f"{word(4)} my telephone number: +1 (555) 555-{1000 + k} thanks a lot {word(3)}" for k in range(30)]
    texts += [f"{word(4)} my telephone number: 030 12{k}34500 or so {word(3)}" for k in range(6)]  # discovered by what stands before
    texts += [f"{word(2)} badge B-77{k}12 or so {word(3)}" for k in range(4)]                      # discovered in the next round, by what stands after
    texts += [f"{word(2)} order number 4000{k}777 shipped today" for k in range(9)]              # never beside a seed
    texts += [f"see the card 4242 4242 4242 4242 {word(2)}", f"the card {word(5)}", f"{word(3)} 030 12334500 {word(2)} 1.2.3.4"]
    rows = list(enumerate(texts)) + [(3, texts[6]), (None, texts[7]), (None, None)]
    got = personal.personal_spans(doc_frame(spark, [t for _, t in rows], [i for i, _ in rows])).orderBy("row").collect()
    assert len(got) == len(rows)
    want = contexts(rows)
    assert len(want) >= 10
    for k, ((i, t), r) in enumerate(zip(rows, got)):
        assert r["doc_id"] == i
        base = [(personal.KINDS[s], a, b) for s, a, b in plain_spans(t or "")]
        more = sorted(("context", a, b) for row, a, b in want if row == k)
        assert [tuple(s) for s in r["spans"]] == base + more, t


def test_personal_digest_and_empty(spark):
    df = personal.digest_columns(personal.personal_spans(doc_frame(spark, ["mail a.b@c.de or 10.0.0.1", None])))
    a, b = df.orderBy("doc_id").collect()
    assert (a["n_email"], a["n_ip"], a["spans"]) == (1, 1, "email:5:13,ip:17:25")
    assert a["base_sha256"] == hashlib.sha256(a["spans"].encode()).hexdigest() and b["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert personal.personal_spans(doc_frame(spark, [])).count() == 0


# --- 13: conversation repair -------------------------------------------------------------------------------------------
def all_edits(rows):
    """Cheapest (cost, audit) by trying everything."""
    best = None
    options = [[("D", 2, "")] + ([] if f in ("blank", "duplicate") else [("K", 5 * (f == "truncated"), i), ("R", 1 + 5 * (f == "truncated"), "u"), ("R", 1 + 5 * (f == "truncated"), "a")]) for i, f in rows]
    for combo in itertools.product(*options):
        for put in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost = sum(e[1] for e in combo) + 5 * sum(map(len, put))
            if best is None or cost <= best[0]:
                roles, audit = put[0], "I" * len(put[0])
                for (e, _, r), p in zip(combo, put[1:]):
                    roles, audit = roles + r + p, audit + e + "I" * len(p)
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def cheapest(evaluator, symbols):
    m = evaluator.matrix(symbols)
    return min((m[0][j][0] + repair.closing(j)[0], str(m[0][j][1]) + repair.closing(j)[1]) for j in range(4) if m[0][j])


def test_edits_are_cheapest_and_rules_do_not_matter():
    rng = random.Random(3)
    grammars = [[], [[(1, 3), (5, 5)], [(repair.TERMINALS, 5)]], [[(5, 3), (0, 0)], [(repair.TERMINALS, 5)]]]
    evaluators = [repair.Evaluator(g) for g in grammars]
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice([None, None, "truncated", "blank"])) for _ in range(rng.randrange(4))]
        symbols = bytes(repair.symbol(i, f) for i, f in rows)
        assert {cheapest(e, symbols) for e in evaluators} == {all_edits(rows)}
    for _ in range(40):
        symbols = bytes(rng.randrange(repair.TERMINALS) for _ in range(rng.randrange(5, 80)))
        assert len({cheapest(e, symbols) for e in evaluators}) == 1


def test_ropes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("DIKR") for _ in range(rng.randrange(90))) for _ in range(60)]
    texts += [t + "K" for t in texts[:9]]
    ropes = []
    for t in texts:
        cuts = sorted(rng.randrange(len(t) + 1) for _ in range(5))
        r = repair.Rope()
        for a, b in zip([0, *cuts], [*cuts, len(t)]):
            r = r + repair.Rope(t[a:b])
        ropes.append(r)
    assert [str(r) for r in ropes] == texts
    for a, x in zip(texts, ropes):
        for b, y in zip(texts, ropes):
            assert (x < y) == (a < b)


def test_compressed_expands_back():
    import numpy as np
    rng = random.Random(2)
    rounds = [[(1, 2), (3, 3), (1, 4)], [(repair.TERMINALS, 4), (repair.TERMINALS + 1, repair.TERMINALS + 1)]]
    flat = [r for rules in rounds for r in rules]

    def grown(s):
        return [s] if s < repair.TERMINALS else grown(flat[s - repair.TERMINALS][0]) + grown(flat[s - repair.TERMINALS][1])
    for _ in range(50):
        seq = [rng.choice([1, 2, 3, 3, 4, -1]) for _ in range(rng.randrange(60))] + [-1]
        out, weight = repair.compressed(np.array(seq), rounds, np.arange(len(seq)))
        assert [x for s in out.tolist() for x in grown(s)] == seq and len(out) == len(weight)


CONV = "conv_id long, turn long, role string, text string, part long, seq long, c long, sig string, copies long, said boolean"


def conversations(rng, n):
    rows = [(900, None, "user", "Hi.", ), (900, None, "user", "Hi."), (900, 2, None, None), (None, 1, "user", "No id."), (None, 2, "assistant", "Yes."), (901, 1, "", "x."),
            (902, 5, "system", "S."), (902, 9, "user", "Cut of"), (902, 9, "user", "Cut of"), (903, 0, "user", " ")]
    for c in range(n):
        for t in range(rng.randrange(1, 9) if c % 9 else 60):
            rows.append((c, t if rng.random() < .9 else t + 3, rng.choice(["user", "assistant"] * 4 + ["system", "tool"]) if rng.random() < .4 else ["user", "assistant"][t % 2],
                         rng.choice(["Fine. ", "What?", "cut o", "Said again!", f"w{rng.randrange(99)}.", "", " \n", "é" * 30 + "."])))
    rng.shuffle(rows)
    return rows


def plain_repair(rows):
    """Results by conversation, with a plain dynamic programme over whole strings."""
    ids, kept = {r[0] for r in rows}, defaultdict(list)
    space = lambda v: " " if v is None else str(v)
    for c, t, role, text in rows:
        harm = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept[c] += [(t, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = {}
    for c in ids:
        own = sorted(kept[c], key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        roles = "".join(r[1][:1] or "-" for r in own)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        turns = [t for t, _, _ in own if t is not None]
        best = {"0": (0, "", ())}

        def insert(best):
            for _ in range(2):
                for s, (cost, audit, lines) in list(best.items()):
                    to, line = ("a", "assistant:") if s == "u" else ("u", "user:")
                    best[to] = min(best.get(to, (1 << 40, "", ())), (cost + 5, audit + "I", lines + (line,)))
            return best
        for (_, role, text), fault in zip(own, faults):
            new = {}
            for s, (cost, audit, lines) in insert(best).items():
                ways = [(s, 2, "D", ())]
                if fault not in ("blank", "duplicate"):
                    extra, to = 5 * (fault == "truncated"), "a" if s == "u" else "u"
                    ways.append((to, 1 + extra, "R", ({"u": "user", "a": "assistant"}[to] + ":" + text,)))
                    if role[:1] == to or role[:1] == "s" and s == "0":
                        ways.append((role[0], extra, "K", (f"{role}:{text}",)))
                for to, more, e, line in ways:
                    new[to] = min(new.get(to, (1 << 40, "", ())), (cost + more, audit + e, lines + line))
            best = new
        cost, audit, lines = min(v for s, v in insert(best).items() if s in "0a")
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows,chars", [(4096, 1 << 20), (3, 1 << 20), (4096, 20)])
def test_conversation_repair(spark, monkeypatch, rows, chars):
    monkeypatch.setattr(repair, "CHUNK_ROWS", rows)
    monkeypatch.setattr(repair, "CHUNK_CHARS", chars)
    data = conversations(random.Random(6), 60)
    df = spark.createDataFrame([r + (1, 1, 1, "s", 7, True) for r in data], CONV)
    got = repair.repair_conversations(repair.damaged(df))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plain_repair(data)
    assert got.count() == len({r[0] for r in data})


def test_conversation_without_rows(spark):
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(repair.damaged(df)).collect() == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_conversations(repair.damaged(df.filter("conv_id < 0"))).count() == 0


# --- names of further columns ------------------------------------------------------------------------------------------
def test_further_columns_may_have_any_name(spark):
    from apexgrid.llm import line_dedup, quality, url_filter
    names = ["whole", "own", "hash", "lines", "kept", "row", "_id", "_row", "_kept", "_lines", "_hash", "judged", "_judged", "rest"]
    extra = ", ".join(f"`{c}` string" for c in names)
    texts = ["one two three four five\nalpha beta", "one two three four five\nrest stays here", None]
    docs = spark.createDataFrame([(k, t, "s", "en", *names) for k, t in enumerate(texts)], f"doc_id long, text string, source string, lang string, {extra}")
    out = line_dedup.without_repeated_lines(docs).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [texts[0], "rest stays here", None] and all([r[c] for c in names] == names for r in out)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 3 and all(r["keep"] and [r[c] for c in names] == names for r in out)
    pages = spark.createDataFrame([(1, "http://a.org/x", *names), (2, None, *names)], f"page_id long, url string, {extra}")
    out = url_filter.judge_urls(pages, [("allow", "org", "/")], []).orderBy("page_id").collect()
    assert [(r["host"], r["rule"]) for r in out] == [("a.org", "org/"), ("", None)] and all([r[c] for c in names] == names for r in out)
