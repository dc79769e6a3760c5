"""Packing: vector bin packing of examples into training sequences.

A sequence has three limits: tokens, segments and loss-bearing tokens. Each task packs the examples it reads as they come,
from a pool of bounded size, so nothing is shuffled and memory does not grow with the input. A sequence starts with the
longest-waiting example; then the dot-product heuristic adds, of the pool's examples that fit, the one whose demand points most
into the room that is left. When nothing fits, an example is cut to fill the rest; a task's last sequence is split into
sequences of power-of-two lengths, which need no padding. Only sequences that ran out of segments or loss stay short, and
are split likewise.

Defined cases: a null or empty text has the end token only; a null prompt is empty; rows without an id, repeated rows and
repeated ids are packed like any other; an empty table gives no pieces. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Examples that wait in a task's pool; bytes of words that a worker remembers, of them beside each word, and the longest such word; new words encoded together;
#: characters of the texts that are encoded together, or one text.
POOL, REMEMBERED, ENTRY, WORD, TOGETHER, CHARS = 2048, 100_000_000, 160, 48, 256, 1 << 21
#: Punctuation that is taken off the end of a word of letters.
_TAIL = ".,;:!?*&%$#|()[]{}<>+=/-_\"~^"


def _lowered(text: str) -> str:
    """Lower case where that is the tokenizer's own, character by character: in Latin-1. Else the text as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers, for a lower-casing tokenizer that joins neither
    words nor letters with punctuation and marks the end of a word in its vocabulary.

    A batch of texts is a column of words: it is dictionary-encoded, so each distinct word is looked up once a batch and the ids are gathered by
    array operations. What is looked up and remembered are words of letters apart from the punctuation at their end, which many words share.
    Those not seen before are encoded, words of letters many at a time and parted again at the word ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._one = Tokenizer.from_file(path)
        vocabulary = self._one.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._seen: dict[str, bytes] = {}
        self._past: dict[str, bytes] = {}
        self.remembered = REMEMBERED
        self._held = 0

    def _each(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, self._one.encode_batch_fast(words, add_special_tokens=False))}

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        letters = [w for w in words if w.isalpha()]
        out = self._each([w for w in words if not w.isalpha()])
        groups = [letters[k:k + TOGETHER] for k in range(0, len(letters), TOGETHER)]
        for group, e in zip(groups, self._one.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = 4 * (np.flatnonzero(self._ends[ids]) + 1)
            if len(ends) != len(group) or 4 * len(ids) != ends[-1]:
                out.update(self._each(group))
                continue
            raw, stops = ids.tobytes(), ends.tolist()
            out.update((w, raw[i:j]) for w, i, j in zip(group, [0, *stops], stops))
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words not seen before."""
        return self._encoded(words)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        column = pc.ascii_split_whitespace(pa.array(map(_lowered, texts), pa.large_string()))
        words = column.flatten().dictionary_encode()
        parts, heads, tails = {"": 0}, [], []
        for w in words.dictionary.to_numpy(zero_copy_only=False).tolist():
            stem = w.rstrip(_TAIL)
            if len(stem) == len(w) or not stem.lower().isalpha():
                heads.append(parts.setdefault(w, len(parts)))
                tails.append(0)
            else:
                heads.append(parts.setdefault(stem, len(parts)))
                tails.append(parts.setdefault(w[len(stem):], len(parts)))
        distinct = list(parts)[1:]
        if self._held > self.remembered // 2:  # two halves: words met since the last turn stay, others go with the next
            self._past, self._seen, self._held = self._seen, {}, 0
        own, past = {}, self._past
        for w in [w for w in distinct if w not in self._seen]:
            own[w] = past.get(w)
        own.update(self._learn([w for w, ids in own.items() if ids is None]))
        for w, ids in own.items():
            if len(w) <= WORD:
                self._seen[w] = ids
                self._held += ENTRY + len(w) + len(ids)
        ids = [b"", *(own[w] if w in own else self._seen[w] for w in distinct)]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        size = size[heads] + size[tails] if heads else size[:0]
        table, first = np.frombuffer(b"".join([ids[k] for pair in zip(heads, tails) for k in pair]), "<u4"), np.cumsum(size) - size
        at = words.indices.to_numpy(zero_copy_only=False)
        lengths = size[at] if len(at) else size[:0]
        ends = np.cumsum(lengths)
        flat = table[np.repeat(first[at] - (ends - lengths), lengths) + np.arange(ends[-1])] if len(at) else table
        stops = np.concatenate([[0], ends])[column.offsets.to_numpy() - column.offsets[0].as_py()].tolist()
        return [flat[i:j].tobytes() for i, j in zip(stops, stops[1:])]

    def forget(self) -> None:
        """Free the memory of words, at the end of a task: the worker goes on to other work."""
        self._seen, self._past, self._held = {}, {}, 0


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str, remembered: int = REMEMBERED) -> WordTokenizer:
    """One per worker and file, which remembers words of so many bytes."""
    if path not in _TOKENIZERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = WordTokenizer(path)
    _TOKENIZERS[path].remembered = remembered
    return _TOKENIZERS[path]


class Packer:
    """Packs a stream of examples ``(key, ids, prompt)``; the first ``prompt`` tokens of an example bear no loss."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.limits = np.array([tokens, segments, loss], float)
        self.size = np.zeros(POOL + 1)
        self.loss = np.zeros(POOL + 1)
        self.age = np.full(POOL + 1, np.inf)
        self.held: list = [None] * (POOL + 1)
        self.free = list(range(POOL + 1))
        self.came = 0
        self.sequence = 0

    def add(self, key, ids: np.ndarray, prompt: int) -> Iterator[tuple]:
        """Take an example; gives the pieces of sequences that this completes."""
        slot = self.free.pop()
        self.held[slot] = [key, ids, 0, prompt]
        self.age[slot] = self.came
        self.came += 1
        self._measure(slot)
        while not self.free:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while len(self.free) <= POOL:
            yield from self._fill()

    def _measure(self, slot: int) -> None:
        _, ids, start, prompt = self.held[slot]
        self.size[slot] = len(ids) - start
        self.loss[slot] = len(ids) - max(start, min(prompt, len(ids)))

    def _take(self, slot: int, room: np.ndarray, out: list) -> None:
        """Move an example, or what fits of it, into the sequence."""
        key, ids, start, prompt = self.held[slot]
        stop = int(min(len(ids), start + room[0], max(start, prompt) + room[2]))
        out.append((key, ids, start, stop))
        room -= (stop - start, 1, stop - max(start, min(prompt, stop)))
        if stop == len(ids):
            self.held[slot] = None
            self.size[slot] = self.loss[slot] = 0
            self.age[slot] = np.inf
            self.free.append(slot)
        else:
            self.held[slot][2] = stop
            self._measure(slot)

    def _fill(self) -> Iterator[tuple]:
        room, out = self.limits.copy(), []
        self._take(int(np.argmin(self.age)), room, out)
        while room.min() > 0 and len(self.free) <= POOL:
            weight = room / self.limits ** 2
            score = np.where((self.size <= room[0]) & (self.loss <= room[2]) & (self.size > 0), self.size * weight[0] + weight[1] + self.loss * weight[2], 0)
            best = int(np.argmax(score))
            self._take(best if score[best] > 0 else int(np.argmax(self.size)), room, out)
        length = int(sum(stop - start for _, _, start, stop in out))
        if length == self.limits[0]:
            yield from self._close(out)
            return
        for bit in range(length.bit_length() - 1, -1, -1):
            need, part = length & (1 << bit), []
            while need:
                key, ids, start, stop = out.pop(0)
                cut = min(stop, start + need)
                part.append((key, ids, start, cut))
                need -= cut - start
                if cut < stop:
                    out.insert(0, (key, ids, cut, stop))
            if part:
                yield from self._close(part)

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for key, ids, start, stop in pieces:
            yield key, start, stop - start, ids[start:stop].tobytes(), len(ids), self.sequence, offset
            offset += stop - start
        self.sequence += 1


def pack(docs: DataFrame, path: str, end_id: int, tokens: int = 4096, segments: int = 512, loss: int | None = None,
         text: str = "text", prompt: str | None = None, key: str = "doc_id") -> DataFrame:
    """Pieces ``(key, start, length, ids, doc_tokens, sequence_id, offset)`` of all examples.

    An example is the tokens of its prompt (if a prompt column is named), of its text, and ``end_id``; only the text and
    the end bear loss. ``ids`` are little-endian unsigned 32-bit numbers. ``sequence_id`` numbers a task's sequences.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base = Packer(tokens, segments, loss or tokens), TaskContext.get().partitionId() << 32
        rows: list = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["sequence_id"] += base
            rows.clear()
            return out

        encoder = tokenizer(path)
        try:
            for batch in batches:
                chars = np.cumsum([sum(len(t or "") for t in texts) for texts in zip(*[batch[c] for c in batch.columns[1:]])])
                for _, part in batch.groupby(chars // CHARS, sort=False):
                    bodies = encoder.encode([t or "" for t in part["_text"]])
                    heads = encoder.encode([t or "" for t in part["_prompt"]]) if prompt else [b""] * len(part)
                    for k, head, body in zip(part["_key"], heads, bodies):
                        rows.extend(packer.add(k, np.frombuffer(head + body + end, "<u4"), len(head) // 4))
                    if rows:
                        yield frame()
            rows.extend(packer.finish())
            if rows:
                yield frame()
        finally:
            encoder.forget()

    picked = [F.col(key).alias("_key"), F.col(text).alias("_text"), *([F.col(prompt).alias("_prompt")] if prompt else [])]
    return docs.select(*picked).mapInPandas(run, schema)
