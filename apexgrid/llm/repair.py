"""Conversation structure repair: a grammar-compressed dynamic programme.

Every row of a conversation becomes a symbol: the class of its role and its first fault. The cheapest edits that give a conversation the
roles ``(s?(ua)+)?`` follow from a product of min-plus transfer matrices, one per symbol, over the four states of that language
(start, after system, after user, after assistant). An entry holds a cost and the audit, the string of edit initials.

* Rows are range-partitioned by (conversation, turn), so a conversation of any size is spread, and cut into chunks of bounded rows and text.
* The chunks' symbol sequences are compressed by Re-Pair rules: in each round the most frequent adjacent pairs whose symbols do not clash
  become rules. A rule is two integers; the number of rules is bounded, and bounds the sharing only, as what is left is multiplied symbol by symbol.
* Each rule that a task needs gets one matrix, evaluated bottom-up and shared by all conversations of the task. Audits are ropes: a
  concatenation keeps its parts and a polynomial hash, so two audits are compared without writing them out. Of equal costs the smaller audit wins; audits of
  one entry end in a row's edit, so none is the start of another.
* A conversation that lies in one chunk is finished there. For one of several chunks only costs and ranks (32 numbers a chunk) meet, which fixes the states
  at the chunk ends; the chunks then write their parts, and these are joined in order. The hash of the repaired text is a chain by its definition: it is fed
  part by part in order, without holding the text.

Edits: K keep 0, R other role 1, D delete 2 (must for blank and duplicate rows), I insert 5; a truncated row that stays adds 5.
Defined cases: null role and text are one space; a null conversation id is a conversation of its own; rows go by turn, nulls first, rows of one turn by
their hash (equal rows are adjacent); a conversation without rows has zeros, an empty audit and the hash of the empty text; empty tables give no rows; other
columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

#: Most rows and characters of a chunk; Re-Pair rounds, rules of a round, least count of a pair; sequences that a task remembers.
CHUNK_ROWS, CHUNK_CHARS = 4096, 1 << 20
ROUNDS, ROUND_RULES, LEAST = 16, 256, 2
MEMORY = 20_000
# fixed values: costs of the edits
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_BLANKS = " \t\n\x0b\f\r"
#: Symbols: 0 must go, then by class of the role (s, u, a, other) without and with truncation.
TERMINALS = 9
_STATES, _ACCEPT = range(4), (0, 3)
_USER_FROM, _ASSISTANT_FROM = (0, 1, 3), (2,)
_MOD, _BASE = (1 << 61) - 1, 911_382_323


# --- audits ------------------------------------------------------------------------------------------------------------

class Rope:
    """A string as a tree of parts, with its length and hash."""

    __slots__ = ("left", "right", "text", "size", "hash")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.size, self.hash = len(text), 0
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _MOD
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(_BASE, right.size, _MOD) + right.hash) % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        if not self.size:
            return other
        if self.left is None and other.left is None and self.size + other.size <= 32:
            return Rope(self.text + other.text)
        return Rope("", self, other)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.size == y.size and x.hash == y.hash:
                continue
            if x.left is not None and (x.size >= y.size or y.left is None):
                a += [x.right, x.left]
                b.append(y)
            elif y.left is not None:
                a.append(x)
                b += [y.right, y.left]
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                a += [Rope(x.text[n:])] if x.size > n else []
                b += [Rope(y.text[n:])] if y.size > n else []
        return bool(b)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                out.append(x.text)
            else:
                todo += [x.right, x.left]
        return "".join(out)


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def _best(a: Entry | None, b: Entry) -> Entry:
    return b if a is None or b[0] < a[0] or b[0] == a[0] and b[1] < a[1] else a


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: first ``a``'s rows, then ``b``'s."""
    out: Matrix = [[None] * 4 for _ in _STATES]
    for i in _STATES:
        for k in _STATES:
            if a[i][k] is not None:
                for j in _STATES:
                    if b[k][j] is not None:
                        out[i][j] = _best(out[i][j], (a[i][k][0] + b[k][j][0], a[i][k][1] + b[k][j][1]))
    return out


def symbol(role: str, fault: str | None) -> int:
    """The terminal of a row."""
    return 0 if fault in ("blank", "duplicate") else 1 + 2 * ("sua".find(role[0]) % 4 if role else 3) + (fault == "truncated")


def _after(state: int, initial: str) -> int | None:
    if initial == "s":
        return 1 if state == 0 else None
    return 2 if initial == "u" and state in _USER_FROM else 3 if initial == "a" and state in _ASSISTANT_FROM else None


@cache
def insertions(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) that insertions alone lead to. Going round costs more, so each state is reached once."""
    out = [(state, 0, "")]
    while True:
        at, cost, audit = out[-1]
        to = 3 if at in _ASSISTANT_FROM else 2
        if to in [s for s, _, _ in out]:
            return out
        out.append((to, cost + INSERT, audit + "I"))


@cache
def terminal(sym: int) -> Matrix:
    """Insertions, then one edit of a row of this symbol."""
    out: Matrix = [[None] * 4 for _ in _STATES]
    initial, extra = ("suax"[(sym - 1) // 2], TRUNCATED * ((sym - 1) % 2)) if sym else ("", 0)
    for i in _STATES:
        for at, cost, audit in insertions(i):
            edits = [(at, DELETE, "D")]
            if sym:
                edits.append((3 if at in _ASSISTANT_FROM else 2, REROLE + extra, "R"))
                if (kept := _after(at, initial)) is not None:
                    edits.append((kept, KEEP + extra, "K"))
            for j, more, e in edits:
                out[i][j] = _best(out[i][j], (cost + more, Rope(audit + e)))
    return out


def closing(state: int) -> tuple[int, str]:
    """Cheapest insertions that end a conversation in this state."""
    return min((cost, audit) for at, cost, audit in insertions(state) if at in _ACCEPT)


IDENTITY: Matrix = [[(0, Rope()) if i == j else None for j in _STATES] for i in _STATES]


# --- grammar -----------------------------------------------------------------------------------------------------------

Rounds = list[list[tuple[int, int]]]


def compressed(seq: np.ndarray, rounds: Rounds, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """A sequence (parts end in -1) with the pairs of each round replaced. The symbols of a round's rules do not clash, so all
    replacements of a round are independent; in runs of one symbol every second place counts."""
    first = TERMINALS
    for rules in rounds:
        pairs = np.array(rules, np.int64)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        now = np.where((seq[:-1] >= 0) & (seq[1:] >= 0), seq[:-1] << 32 | seq[1:], -1)
        at = np.minimum(np.searchsorted(keys[order], now), len(keys) - 1)
        hit = keys[order][at] == now
        run = np.flatnonzero(hit & (seq[:-1] == seq[1:]))
        if len(run):
            starts = np.flatnonzero(np.diff(run, prepend=-2) > 1)
            hit[run[(np.arange(len(run)) - np.repeat(starts, np.diff(starts, append=len(run)))) % 2 == 1]] = False
        places = np.flatnonzero(hit)
        seq = seq.copy()
        seq[places] = first + order[at[places]]
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq = seq[keep]
        weight = None if weight is None else weight[keep]
        first += len(rules)
    return seq, weight


def without_clash(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs, most frequent first, such that no symbol is the left of one and the right of another."""
    left, right, twice, out = set(), set(), set(), []
    for a, b in pairs:
        if a == b and a not in left | right or a != b and a not in right | twice and b not in left | twice:
            if a == b:
                twice.add(a)
            else:
                left.add(a)
                right.add(b)
            out.append((a, b))
    return out


def grammar(sequences: DataFrame, rounds: int = ROUNDS, round_rules: int = ROUND_RULES, least: int = LEAST) -> Rounds:
    """Re-Pair rules of ``sequences(symbols)``. At most ``rounds * round_rules`` pairs of integers reach the driver."""
    out: Rounds = []
    for _ in range(rounds):
        done = list(out)

        def count(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen = Counter(batch.column("symbols").to_pylist())
                parts = [np.append(np.frombuffer(s, np.uint8).astype(np.int64), -1) for s in seen]
                if not parts:
                    continue
                weight = np.repeat(np.fromiter(seen.values(), np.int64), [len(p) for p in parts])
                seq, weight = compressed(np.concatenate(parts), done, weight)
                fit = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
                keys, at = np.unique(seq[fit] << 32 | seq[fit + 1], return_inverse=True)
                n = np.bincount(at, weight[fit], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["a", "b", "n"])

        top = sequences.select("symbols").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")) \
            .filter(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(round_rules).collect()
        if not top:
            break
        out.append(without_clash([(r["a"], r["b"]) for r in top]))
    return out


class Evaluator:
    """Transfer matrices of rules and sequences, each computed once by its owner."""

    def __init__(self, rounds: Rounds):
        self.rounds = rounds
        self.rules = [r for rules in rounds for r in rules]
        self.matrices: dict[int, Matrix] = {s: terminal(s) for s in range(TERMINALS)}
        self.done: dict[bytes, Matrix] = {}

    def _rule(self, top: int) -> Matrix:
        todo = [top]
        while todo:
            s = todo[-1]
            missing = [] if s in self.matrices else [p for p in self.rules[s - TERMINALS] if p not in self.matrices]
            if missing:
                todo += missing
                continue
            todo.pop()
            if s not in self.matrices:
                a, b = self.rules[s - TERMINALS]
                self.matrices[s] = times(self.matrices[a], self.matrices[b])
        return self.matrices[top]

    def matrix(self, symbols: bytes) -> Matrix:
        if symbols not in self.done:
            if len(self.done) >= MEMORY:
                self.done.clear()
            seq, _ = compressed(np.frombuffer(symbols, np.uint8).astype(np.int64), self.rounds)
            out = IDENTITY
            for s in seq.tolist():
                out = times(out, self._rule(s))
            self.done[symbols] = out
        return self.done[symbols]


# --- conversations -----------------------------------------------------------------------------------------------------

def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the damage; a dropped row has 0 copies, a repeated one 2."""
    harm = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    return conversations.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), harm.alias("harm")).select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with ``sig`` of role and text, and whether the same stands in an earlier turn of the conversation."""
    rows = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), "copies") \
        .withColumn("sig", F.md5(F.concat_ws("\0", "role", "text")))
    # only what is said in several turns is joined back, so mostly a small side
    turns = rows.filter("copies > 0").groupBy("conv_id", "sig").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")) \
        .filter("NOT first <=> last").select(F.col("conv_id").alias("c"), F.col("sig").alias("s"), "first")
    return rows.join(turns, rows["conv_id"].eqNullSafe(turns["c"]) & (rows["sig"] == turns["s"]), "left") \
        .select("conv_id", "turn", "role", "text", "copies", "sig", F.expr("first IS NOT NULL AND NOT turn <=> first.turn").alias("said"))


_CHUNK = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("symbols", pa.binary()),
                    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("lo", pa.int64()), ("hi", pa.int64()), ("turns", pa.int64()),
                    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("ends", pa.list_(pa.string()))])
_CHUNK_DDL = "conv_id long, part long, seq long, whole boolean, symbols binary, roles array<string>, texts array<string>, lo long, hi long, turns long, " \
    "blank long, duplicate long, truncated long, illegal long, ends array<string>"
_LEGAL = {"su", "ua", "au"}


def fault_of(text: str, said: bool) -> str | None:
    body = text.rstrip(_BLANKS)
    return "blank" if not body else "duplicate" if said else "truncated" if body[-1] not in ".!?" else None


def _new_chunk(conv_id) -> dict:
    return {"conv_id": conv_id, "symbols": bytearray(), "roles": [], "texts": [], "lo": None, "hi": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0,
            "illegal": 0, "ends": [], "chars": 0}


def _add(chunk: dict, turn, role: str, text: str, said: bool) -> None:
    fault = fault_of(text, said)
    if fault:
        chunk[fault] += 1
    if turn is not None:
        chunk["turns"] += turn != chunk["hi"]
        chunk["lo"] = turn if chunk["lo"] is None else chunk["lo"]
        chunk["hi"] = turn
    initial = role[:1]
    chunk["illegal"] += bool(chunk["ends"]) and chunk["ends"][-1] + initial not in _LEGAL
    chunk["ends"] = [chunk["ends"][0] if chunk["ends"] else initial, initial]
    stays = fault not in ("blank", "duplicate")
    chunk["symbols"].append(symbol(role, fault))
    chunk["roles"].append(role if stays else None)
    chunk["texts"].append(text if stays else None)
    chunk["chars"] += len(text) if stays else 0


def chunks(rows: DataFrame) -> DataFrame:
    """Chunks of conversations in order (part, seq). ``whole`` chunks hold all of a conversation for sure."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, before, out, size, start = TaskContext.get().partitionId(), 0, None, None, [], 0, True

        def close(last: bool, inner: bool):
            nonlocal seq, size
            size += now.pop("chars")
            out.append(now | {"symbols": bytes(now["symbols"]), "part": part, "seq": seq, "whole": last and inner})
            seq += 1

        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and r["conv_id"] != now["conv_id"]:
                    close(True, not start)
                    now, start, before = None, False, None
                elif now is not None and (len(now["symbols"]) >= CHUNK_ROWS or now["chars"] >= CHUNK_CHARS):
                    close(False, False)
                    now, start = None, True
                if now is None:
                    now = _new_chunk(r["conv_id"])
                key = (r["turn"], r["sig"])
                for k in range(r["copies"]):
                    _add(now, r["turn"], r["role"], r["text"], r["said"] or k > 0 or key == before)
                    before = key
            if len(out) >= 256 or size >= CHUNK_CHARS:
                yield pa.RecordBatch.from_pylist(out, _CHUNK)
                out, size = [], 0
        if now is not None:
            close(True, False)
        yield pa.RecordBatch.from_pylist(out, _CHUNK)

    order = ["conv_id", "turn", "sig"]
    return _marked(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _CHUNK_DDL)


def _written(audit: str, state: int, roles: list, texts: list) -> Iterator[str]:
    """The repaired lines of a chunk that starts in ``state``."""
    k = 0
    for e in audit:
        new = "assistant" if state in _ASSISTANT_FROM else "user"
        if e == "I":
            yield f"{new}:"
        elif e != "D":
            new = roles[k] if e == "K" else new
            yield f"{new}:{texts[k]}"
        k += e != "I"
        state = state if e == "D" else _after(state, new[0])


_RESULT = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                    + [("audit", pa.string()), ("repaired_sha256", pa.string())])
_RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(lo: int | None, hi: int | None, turns: int) -> int:
    return 0 if lo is None else hi - lo + 1 - turns


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    ``rows(conv_id, turn, role, text, copies)``."""
    parts = stage(chunks(rows), "chunks")
    rounds = grammar(parts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluator = Evaluator(rounds)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m = evaluator.matrix(r["symbols"])
                cost, audit = min((m[0][j][0] + closing(j)[0], str(m[0][j][1]) + closing(j)[1]) for j in _STATES if m[0][j] is not None)
                text = "\n".join(_written(audit, 0, r["roles"], r["texts"]))
                out.append(r | {"gaps": _gaps(r["lo"], r["hi"], r["turns"]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, _RESULT)

    return parts.filter("whole").mapInArrow(finish, _RESULT_DDL).union(_joined(parts.filter("NOT whole"), rounds))


_COSTED_DDL = "conv_id long, part long, seq long, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, ends array<string>, " \
    "costs array<long>, ranks array<int>"
_COSTED = pa.schema([_CHUNK.field(c) for c in ("conv_id", "part", "seq", "lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal", "ends")]
                    + [("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])
_CHOSEN = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())]
                    + [f for f in _RESULT if f.name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
_PIECE = pa.schema([_CHUNK.field(c) for c in ("conv_id", "part", "seq")] + [("piece", pa.string()), ("lines", pa.list_(pa.string()))]
                   + [f for f in _RESULT if f.name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict | None]]:
    """Rows in order, and (key, None) after the last row of each key."""
    now, any_row = None, False
    for batch in batches:
        for r in batch.to_pylist():
            if any_row and r[key] != now:
                yield now, None
            now, any_row = r[key], True
            yield now, r
    if any_row:
        yield now, None


def _chosen(held: list[dict]) -> Iterator[dict]:
    """States at the chunk ends of one conversation, and its sums."""
    togo = [closing(s)[0] for s in _STATES]
    after = [togo]
    for r in reversed(held[1:]):
        togo = [min((r["costs"][4 * i + j] + togo[j] for j in _STATES if r["costs"][4 * i + j] is not None), default=1 << 60) for i in _STATES]
        after.append(togo)
    after.reverse()
    state, cost, illegal, gone, last, ends = 0, 0, 0, 0, None, None
    spots = []
    for r, left in zip(held, after):
        ways = [(r["costs"][4 * state + j] + left[j], r["ranks"][4 * state + j], j) for j in _STATES if r["costs"][4 * state + j] is not None]
        end = min(ways)[2]
        cost += r["costs"][4 * state + end]
        spots.append((state, end))
        state = end
        illegal += r["illegal"] + bool(ends and r["ends"] and ends + r["ends"][0] not in _LEGAL)
        ends = r["ends"][1] if r["ends"] else ends
        gone += r["turns"] - (last is not None and r["lo"] == last)
        last = last if r["hi"] is None else r["hi"]
    low = next((r["lo"] for r in held if r["lo"] is not None), None)
    sums = {c: sum(r[c] for r in held) for c in ("blank", "duplicate", "truncated")} \
        | {"illegal": illegal, "gaps": _gaps(low, last, gone), "cost": cost + closing(state)[0]}
    for k, (r, (begin, end)) in enumerate(zip(held, spots)):
        yield {"part": r["part"], "seq": r["seq"], "begin": begin, "end": end, "last": k == len(held) - 1} | sums


def _joined(parts: DataFrame, rounds: Rounds) -> DataFrame:
    """Results of conversations whose chunks may lie in several partitions."""
    def costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluator = Evaluator(rounds)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m = evaluator.matrix(r["symbols"])
                ranks = []
                for row in m:
                    known = sorted((j for j in _STATES if row[j] is not None), key=lambda j: str(row[j][1]))
                    ranks += [known.index(j) if j in known else None for j in _STATES]
                out.append(r | {"costs": [None if e is None else e[0] for row in m for e in row], "ranks": ranks})
            yield pa.RecordBatch.from_pylist(out, _COSTED)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # 32 numbers a chunk
        for _, r in _grouped(batches, "conv_id"):
            if r is None:
                yield pa.RecordBatch.from_pylist(list(_chosen(held)), _CHOSEN)
                held = []
            else:
                held.append(r)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluator = Evaluator(rounds)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                piece = str(evaluator.matrix(r["symbols"])[r["begin"]][r["end"]][1]) + (closing(r["end"])[1] if r["last"] else "")
                out.append(r | {"piece": piece, "lines": list(_written(piece, r["begin"], r["roles"], r["texts"]))})
            yield pa.RecordBatch.from_pylist(out, _PIECE)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, some, row = [], hashlib.sha256(), False, None
        for _, r in _grouped(batches, "conv_id"):
            if r is None:
                yield pa.RecordBatch.from_pylist([row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], _RESULT)
                audit, digest, some, row = [], hashlib.sha256(), False, None
                continue
            audit.append(r["piece"])
            for line in r.pop("lines"):
                digest.update((("\n" if some else "") + line).encode())
                some = True
            row = r

    order = ["conv_id", "part", "seq"]
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    chosen = parts.drop("roles", "texts").mapInArrow(costed, _COSTED_DDL).repartition("conv_id").sortWithinPartitions(*order) \
        .mapInArrow(choose, "part long, seq long, begin int, end int, last boolean, " + ", ".join(f"{c} long" for c in sums))
    return parts.select(*order, "symbols", "roles", "texts").join(chosen, ["part", "seq"]) \
        .mapInArrow(write, "conv_id long, part long, seq long, piece string, lines array<string>, " + ", ".join(f"{c} long" for c in sums)) \
        .repartition("conv_id").sortWithinPartitions(*order).mapInArrow(chain, _RESULT_DDL)
