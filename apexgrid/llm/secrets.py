"""Secret scan: patterns, and a token-efficiency test.

Natural words need few tokens of a byte-pair vocabulary, random strings need many. A run of key characters that has fewer
than ``MAX_RATIO`` characters per token is reported as ``dense``, unless it is a known digest or identifier. In a run that is not,
as a path, URL or assignment, the parts between separators are tested, so that words do not dilute a key; neighbouring
parts of random characters count as one, since a key may itself hold separators. The patterns' spans are reported besides,
whatever the test says.

Spans are (kind, start, end) in code points, end exclusive, leftmost and not overlapping within a kind.
Defined cases: null and empty texts have none; equal rows get equal spans; all columns pass through, and the result replaces
a column of its name.
"""
from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "dense")
# fixed values: the base patterns and the lengths that they need
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE = 8
#: Runs that are tested, characters per token under which one is dense, and characters encoded at once.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
MIN_RUN, MAX_RATIO, SLICE = 16, 2.0, 256
# known digests (MD5, SHA-1, SHA-2 in hexadecimal) and identifiers (UUIDs, numbers, dates, versions, dotted and slashed names)
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
_KNOWN = re.compile(r"""[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}   # UUID
    | [0-9][0-9.,/+_=-]*                                                     # number, date, version
    | [0-9]{8}T[0-9]{4,6}Z?                                                  # time
    """, re.VERBOSE)
# words in lower, upper, capitalised or camel case with a short number; letters in irregular case are left to the ratio
_WORD = re.compile(r"([a-z]+|[A-Z]+|[A-Z][a-z]+|[A-Za-z][a-z]{2,}([A-Z][a-z]{2,})+)[0-9]{0,4}")
_BETWEEN = re.compile(r"[-_./=+]+")
# a UUID is one part; a word or number of under so many characters says nothing
_PART = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])|[A-Za-z0-9]+")
SHORT_PART = 4


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A run without the punctuation at its ends."""
    while start < end and text[start] in "+/_=.-":
        start += 1
    while start < end and text[end - 1] in "/_.-":
        end -= 1
    return start, end


def is_known(run: str) -> bool:
    """Digests and identifiers."""
    return bool(_KNOWN.fullmatch(run)) or all(_WORD.fullmatch(p) for p in _BETWEEN.split(run) if p) or len(run.rstrip("=")) in DIGEST_LENGTHS and bool(_HEX_RUN.fullmatch(run))


def ratio(run: str, encoding) -> float:
    """Characters per token; long runs are encoded in slices, so the work is linear."""
    return len(run) / sum(len(encoding.encode_ordinary(run[i:i + SLICE])) for i in range(0, len(run), SLICE))


def is_dense(run: str, encoding) -> bool:
    return len(run) >= MIN_RUN and not is_known(run) and ratio(run, encoding) < MAX_RATIO


def dense_parts(run: str, encoding) -> list[tuple[int, int]]:
    """Where a run is dense: all of it, or stretches of parts that are each random characters."""
    if len(run) < MIN_RUN or is_known(run):
        return []
    if ratio(run, encoding) < MAX_RATIO:
        return [(0, len(run))]
    stretches, now, end = [], [], 0
    for m in _PART.finditer(run):
        part = m.group()
        if not is_known(part) and ratio(part, encoding) < MAX_RATIO:
            now.append(m.span())
            end = len(now)
        elif now and len(part) < SHORT_PART:
            now.append(m.span())
        elif now:
            stretches.append(now[:end])
            now, end = [], 0
    if now:
        stretches.append(now[:end])
    out = []
    for parts in stretches:
        a, b = parts[0][0], parts[-1][1]
        out += [(a, b)] if is_dense(run[a:b], encoding) else [(x, y) for x, y in parts if is_dense(run[x:y], encoding)]
    return out


def find_spans(text: str | None, encoding) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in RUN.finditer(text):
        start, end = trimmed(text, *m.span())
        out += [(start + a, 3, start + b) for a, b in dense_parts(text[start:end], encoding)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def scan_secrets(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end). ``vocabulary`` is a file of tiktoken ranks, ``pattern`` its splitter."""
    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        encoding = _encoding(vocabulary, pattern)
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, encoding)] for t in texts], dtype=object)

    return docs.withColumn(out, spans(text))


def digest_columns(scanned: DataFrame, spans: str = "spans") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_dense) of a scanned table."""
    def of(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    def joined(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter(spans, lambda s: s["kind"] != "dense")
    return scanned.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
                          joined(F.col(spans)).alias("spans"), of("dense").alias("n_dense"))
