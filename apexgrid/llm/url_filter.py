"""URL filters: a bit-parallel wildcard automaton (Shift-And over many words).

All glob rules are packed into one bit vector, one bit per pattern element. A batch of canonical URLs is read side by side:
for every character one shift, one table lookup and a few word operations advance all rules on all URLs. In a glob, ``*`` is any
run without ``/``, ``**`` any run, ``?`` one character; other characters stand for themselves. Literals are ASCII; any
other character of a URL matches wildcards only.

A canonical URL is the lower-cased host followed by the path, without scheme, query and fragment.
Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule fits; such a page is allowed unless a
glob matches the empty string. All columns pass through, the named result columns are replaced.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

OTHER = 128
#: Characters (times bit-vector words) of URLs that are read side by side.
CELLS = 1 << 21
_ONE = np.uint64(1)


class GlobAutomaton:
    """All patterns at once; ``matches`` gives a boolean per URL and pattern."""

    def __init__(self, globs: Sequence[str]):
        elements = [self._parse(g) for g in globs]
        # a pattern with m single elements has m + 1 states; a star is a loop on the state it stands at
        bits = sum(len(single) + 1 for single, _ in elements)
        self.words = max(1, -(-bits // 64))
        step = np.zeros((OTHER + 1, self.words * 64), bool)
        stay = np.zeros((OTHER + 1, self.words * 64), bool)
        start = np.zeros(self.words * 64, bool)
        self.final, at = [], 0
        for single, loops in elements:
            start[at] = True
            for k, c in enumerate(single):
                if c is None:
                    step[:, at + k + 1] = True
                else:
                    step[ord(c), at + k + 1] = True
            for k, wide in loops.items():
                stay[:, at + k] = True
                if not wide:
                    stay[ord("/"), at + k] = False
            at += len(single) + 1
            self.final.append(at - 1)
        self.start, self.step, self.stay = self._pack(start[None])[0], self._pack(step), self._pack(stay)

    @staticmethod
    def _parse(glob: str) -> tuple[list[str | None], dict[int, bool]]:
        single: list[str | None] = []
        loops: dict[int, bool] = {}
        k = 0
        while k < len(glob):
            if glob[k] == "*":
                wide = glob[k:k + 2] == "**"
                loops[len(single)] = loops.get(len(single), False) or wide
                k += 2 if wide else 1
                continue
            if not glob[k].isascii():
                raise ValueError(f"literals must be ASCII: {glob}")
            single.append(None if glob[k] == "?" else glob[k])
            k += 1
        return single, loops

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)

    def matches(self, urls: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(urls), len(self.final)), bool)
        sizes = np.array([len(u) for u in urls])
        order = np.argsort(-sizes, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + max(1, CELLS // (max(1, sizes[order[lo]]) * self.words))
            own = order[lo:hi]
            out[own] = self._run([urls[i] for i in own], sizes[own])
            lo = hi
        return out

    def _run(self, urls: list[str], sizes: np.ndarray) -> np.ndarray:
        """URLs from long to short; at each character only those that reach it are advanced."""
        code = np.full((len(urls), max(1, int(sizes[0]))), OTHER, np.uint8)
        for row, u in zip(code, urls):
            c = np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32)
            row[:len(c)] = np.minimum(c, OTHER)
        state = np.broadcast_to(self.start, (len(urls), self.words)).copy()
        reach = len(urls) - np.searchsorted(sizes[::-1], np.arange(code.shape[1]), side="right")
        for t in range(int(sizes[0])):
            live = state[:reach[t]]
            c = code[:reach[t], t]
            moved = live << _ONE
            moved[:, 1:] |= live[:, :-1] >> np.uint64(63)  # the bit that leaves a word enters the next
            state[:reach[t]] = (moved & self.step[c]) | (live & self.stay[c])
        final = np.array(self.final)
        return (state[:, final // 64] >> (final % 64).astype(np.uint64)) & _ONE == 1


def canonical_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.split(F.substr(url, at + 3), "[?#]", 2)[0]).otherwise(F.lit(""))
    cut = F.instr(rest, "/")
    host = F.when(cut > 0, F.substr(rest, F.lit(1), cut - 1)).otherwise(rest)
    path = F.when(cut > 0, F.substr(rest, cut)).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], blocked: Sequence[str], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict.

    ``rules`` are (verdict, host, path): a rule fits its host and all subdomains when the path starts with the rule's, and the
    longest rule wins. Where none fits, a page is blocked when its canonical URL matches one of the globs ``blocked``. Rules and
    globs run in one automaton.
    """
    rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    globs = [g for _, h, p in rules for g in (f"{h}{p}**", f"*.{h}{p}**")] + list(blocked)
    automaton = GlobAutomaton(globs)
    names = [h + p for _, h, p in rules]
    verdicts = [v for v, _, _ in rules]

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judge(canonical: pd.Series) -> pd.DataFrame:
        hit = automaton.matches(canonical.tolist())
        n = len(names)
        fits = hit[:, :2 * n].reshape(len(hit), n, 2).any(2)
        bad = hit[:, 2 * n:].any(1)
        first = np.where(fits.any(1), fits.argmax(1), -1) if n else np.full(len(hit), -1)
        return pd.DataFrame({"rule": [names[k] if k >= 0 else None for k in first],
                             "verdict": [verdicts[k] if k >= 0 else "block" if b else "allow" for k, b in zip(first, bad)]}, dtype=object)

    host, path = canonical_parts(F.col(url))
    own = ("host", "path", "rule", "verdict")
    # the row travels as one value, so its column names meet no others
    judged = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("whole"), host.alias("host"), path.alias("path")) \
        .withColumn("judged", judge(F.concat("host", "path")))
    return judged.select(*[F.col("whole")[c].alias(c) for c in pages.columns if c not in own], "host", "path", "judged.rule", "judged.verdict")
