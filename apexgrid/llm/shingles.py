"""Words, word hashes and five-word shingles of whole texts, in numpy.

A text is lower-cased in A-Z only and cut into words ``[^\\x20\\x09-\\x0D]+`` of its UTF-8 bytes. A word's hash is a
polynomial over its bytes, so one pass of array operations hashes all words of a text whatever its length.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([1], np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of the base up to the longest word seen by this worker."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(_POWERS)), _BASE)]), dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and word hashes of a byte buffer."""
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    if not len(edges):
        return edges, np.empty(0, np.uint64)
    lens = edges[1::2] - edges[::2]
    first = np.cumsum(lens) - lens
    letters = _LOWER[raw[inside]].astype(np.uint64) + np.uint64(1)
    at = np.arange(len(letters)) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        return edges[::2], mix(np.add.reduceat(letters * _powers(int(lens.max()))[at], first) + lens.astype(np.uint64) * _BASE)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, in order; empty for null, empty and blank texts."""
    return _hashed(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))[1]


def windows(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all windows of ``width`` words in order; with fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width))
    with np.errstate(over="ignore"):
        for j in range(width):
            out = mix(out * _BASE + words[j:n - width + 1 + j])
    return out


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, as signed 64-bit values."""
    return np.unique(windows(word_hashes(text), width).view(np.int64))


#: Bytes hashed at once; a longer text is hashed alone.
_BUFFER = 1 << 18


def windows_of(texts: Iterable[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """``windows(word_hashes(text))`` of each text, with short texts hashed together."""
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if size + len(raw) > _BUFFER and held:
            yield from _together(held, width)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    yield from _together(held, width)


def _together(held: list[bytes], width: int) -> Iterator[np.ndarray]:
    if len(held) <= 1:
        for raw in held:
            yield windows(_hashed(np.frombuffer(raw, np.uint8))[1], width)
        return
    start, word = _hashed(np.frombuffer(b" ".join(held), np.uint8))
    ends = np.cumsum([len(raw) + 1 for raw in held])
    cut = np.searchsorted(start, ends).tolist()
    full = windows(word, width) if len(word) >= width else word[:0]
    lo = 0
    for hi in cut:
        yield full[lo:hi - width + 1] if hi - lo >= width else windows(word[lo:hi], width)
        lo = hi


def shingles_of(texts: Iterable[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """``shingles(text)`` of each text."""
    for w in windows_of(texts, width):
        yield np.unique(w.view(np.int64))
