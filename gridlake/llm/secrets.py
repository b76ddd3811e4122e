"""Secret scans: fixed patterns, and a token-efficiency test that exposes random strings.

A vocabulary learned from language covers words and names with few tokens. A long run of letters and
digits that takes many tokens for its length is random: a key. Digests and identifiers look alike to
that test and are taken out before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import bounded_batches, table

# The base patterns, their least lengths, and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS = 6, 20

# Runs the token test looks at.
LEAST_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(r"[/_=+-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})[/_=+-]+)*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})[0-9]{0,4}[/_=+-]*")
LETTERS = re.compile(r"[A-Za-z]+")
NUMBERS = re.compile(r"[0-9/_=+-]+")
LONG_NUMBER = re.compile(r"[0-9]{5,}")
PART = re.compile(r"[A-Za-z0-9]+")
WORDY = re.compile(r"[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4}")

#: Characters per token below which a run counts as random. Words reach 3 to 5, random text about 1.5.
MAX_RATIO = 2.2
REDACTED = "[SECRET]"
#: Characters encoded at once; the encoder's time may grow faster than the length of a word.
PIECE = 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """A digest of a usual length, a UUID, or an identifier made of words and short numbers.

    Letters as long as a run are no word of an identifier by their shape alone; their ratio tells.
    """
    if len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run):
        return True
    if UUID.fullmatch(run) or (NUMBERS.fullmatch(run) and not LONG_NUMBER.search(run)):
        return True
    return bool(IDENTIFIER.fullmatch(run)) and all(len(w) < LEAST_RUN for w in LETTERS.findall(run))


def ratio(run: str, path: str) -> float:
    """Characters per token."""
    return len(run) / sum(len(encoding(path).encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_parts(run: str, path: str, max_ratio: float) -> list[tuple[int, int]]:
    """The run if its ratio is low; else what is left of it without readable words at its ends, or parts between delimiters."""

    def is_random(a: int, b: int) -> bool:
        return b - a >= LEAST_RUN and not is_known(run[a:b]) and ratio(run[a:b], path) < max_ratio

    if is_known(run):
        return []
    if is_random(0, len(run)):
        return [(0, len(run))]
    parts = [m.span() for m in PART.finditer(run)]
    readable = [b - a < LEAST_RUN and bool(WORDY.fullmatch(run, a, b)) and ratio(run[a:b], path) >= max_ratio for a, b in parts]
    kept = [p for p, r in zip(parts, readable) if not r]
    if not kept:
        return []
    a, b = kept[0][0], kept[-1][1]
    while b < len(run) and run[b] == "=":
        b += 1
    return [(a, b)] if is_random(a, b) else [p for p in parts if is_random(*p)]


def outside(start: int, end: int, covers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a run that no cover touches; ``covers`` is sorted by start."""
    for a, b in covers:
        if a > start:
            yield start, min(a, end)
        start = max(start, b)
    if start < end:
        yield start, end


def random_spans(text: str, base: list[tuple[int, int, int]], path: str, max_ratio: float) -> list[tuple[int, int, int]]:
    """Parts of a low characters-per-token ratio of runs, outside base spans; ``base`` is sorted by start."""
    found, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        # What begins before the run counts by how far it reaches.
        covers = []
        while k < len(base) and base[k][0] < m.end():
            if base[k][0] > m.start():
                covers.append((base[k][0], base[k][2]))
            else:
                reach = max(reach, base[k][2])
            k += 1
        for a, b in outside(max(m.start(), min(reach, m.end())), m.end(), covers):
            if b - a >= LEAST_RUN:
                found += [(a + x, 3, a + y) for x, y in random_parts(text[a:b], path, max_ratio)]
        reach = max([reach, *[b for _, b in covers]])
    return found


def find_spans(text: str | None, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + random_spans(text, base, path, max_ratio))


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text, path: str | None = None, max_ratio: float = MAX_RATIO):
    """Column: array of (kind, start, end) in code points, end exclusive, by start and then kind.

    A null or empty text has no spans. Every occurrence counts, repeated ones too.
    """
    path = path or default_path()

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t, path, max_ratio)] for t in texts], dtype=object)

    return spans(text)


def redact(text, path: str | None = None, max_ratio: float = MAX_RATIO, mark: str = REDACTED):
    """Column: the text with each stretch of overlapping spans replaced by the mark; null stays null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, find_spans(t, path, max_ratio), mark) for t in texts], dtype=object)

    return clean(text)


def redacted(text: str | None, spans, mark: str) -> str | None:
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, _, end = spans[i]
        while i < len(spans) and spans[i][0] < max(end, start + 1):
            end = max(end, spans[i][2])
            i += 1
        parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def digest(text, path: str | None = None, max_ratio: float = MAX_RATIO):
    """Column: counts of the base kinds, digest of the base spans, all spans as one string."""
    path = path or default_path()

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
    def columns(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                spans = find_spans(t, path, max_ratio)
                kinds = [k for _, k, _ in spans]
                base = joined(s for s in spans if s[1] < 3)
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), joined(spans), kinds.count(3)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return columns(text)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; one row per input row, null texts as empty ones.

    Rows with a null or repeated doc_id stay as they are; an empty table gives no rows.
    """
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest(docs.text).alias("__found")).select("doc_id", "__found.*")
