"""Secrets in text: fixed patterns, and guess cost of values that stand in a credential context.

The guess cost of a value is the cheapest way to spell it as dictionary words, dates, repeats,
keyboard walks and brute-force characters, in bits (log2 of the guesses), found by dynamic
programming over its positions.  A value after a word like `pwd` or `auth` is reported when that
cost is high: `pwd: letmein1999` is not a secret, `pwd: v9#Lq!x72Tz` is.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache
from typing import NamedTuple

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.llm.common import map_batches, text_of

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 32 or more is the whole run, so the shorter ones need not be matched and dropped.
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

# The words that announce a credential, and what may stand as its value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|auth|credentials?|bearer|pin)"""
    r"""["']?\x20*[:=]\x20*(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|([^\s"']{6,}))""",
    re.IGNORECASE | re.ASCII,
)
GUESS_BITS = math.log2(1e10)  # as hard as ten thousand million guesses
SEGMENT_BITS = 1.0  # for choosing the kind of a segment
LONGEST_WORD = 24

# Keyboard rows and runs that people walk along.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DATE = re.compile(r"(?:\d{4}([-/._]?)\d{1,2}\1\d{1,2}|\d{1,2}([-/._]?)\d{1,2}\2\d{4}|(?:19|20)\d{2})", re.ASCII)
DATE_BITS = {True: math.log2(365 * 100), False: math.log2(100)}  # day and year; year alone


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    bits: float


@lru_cache(maxsize=2)
def dictionary(path: str) -> dict[str, int]:
    """Word ranks: the whole words of a public vocabulary file, in the order of their ids."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    words = sorted((i, t[:-4]) for t, i in vocabulary.items() if t.endswith("</w>"))
    return {w: rank for rank, (_, w) in enumerate((x for x in words if len(x[1]) > 2 and x[1].isalpha()), 1)}


@lru_cache(maxsize=1)
def _neighbours() -> frozenset[str]:
    return frozenset(a + b for row in WALKS for line in (row, row[::-1]) for a, b in zip(line, line[1:]))


def _alphabet_bits(value: str) -> float:
    sizes = (
        (10, any("0" <= c <= "9" for c in value)),
        (26, any("a" <= c <= "z" for c in value)),
        (26, any("A" <= c <= "Z" for c in value)),
        (33, any(c.isascii() and not c.isalnum() for c in value)),
        (100, any(not c.isascii() for c in value)),
    )
    return math.log2(sum(n for n, used in sizes if used))


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """log2 of the guesses for `value`, by its cheapest segmentation; linear in its length."""
    n = len(value)
    if not n:
        return 0.0
    brute = _alphabet_bits(value)
    low = value.lower()
    if len(low) != n:  # a letter whose lower form is longer: keep the positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j])
            extra = 0.0
            if rank is None and (rank := ranks.get(plain[i:j])) is not None:
                extra = 1.0
            if rank is not None:
                extra += 1.0 if value[i:j] != low[i:j] else 0.0
                ends[j].append((i, math.log2(rank + 1) + extra))
    for m in DATE.finditer(value):
        ends[m.end()].append((m.start(), DATE_BITS[m.end() - m.start() > 4]))
    start = 0
    for i in range(1, n + 1):  # repeats of one character
        if i == n or low[i] != low[start]:
            if i - start >= 3:
                ends[i].append((start, brute + math.log2(i - start)))
            start = i
    near, start = _neighbours(), 0
    for i in range(1, n + 1):  # walks: the first key, then whether to go on
        if i == n or low[i - 1 : i + 1] not in near:
            if i - start >= 3:
                ends[i].append((start, math.log2(47) + math.log2(i - start) + 1.0))
            start = i
    for unit in range(2, 9):  # repeats of a short unit: its own cost, and the count
        start = 0
        for i in range(unit, n + 1):
            if i == n or low[i] != low[i - unit]:
                if i - start >= 2 * unit:
                    ends[i].append((start, unit * brute + math.log2((i - start) / unit)))
                start = i - unit + 1
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1] + brute
        for i, bits in ends[j]:
            best[j] = min(best[j], best[i] + bits + SEGMENT_BITS)
    return best[n]


def find(text: str, ranks: dict[str, int]) -> list[Span]:
    """All spans of a text (code points, end exclusive), by start and then by kind as listed."""
    spans: list[Span] = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                spans.append(Span("assign", *m.span(), guess_bits(m[2], ranks)))
        base, at = len(spans), 0
        for m in CONTEXT.finditer(text):
            start, end = next(m.span(g) for g in (1, 2, 3) if m[g] is not None)
            while at < base and spans[at].end <= start:
                at += 1
            if at < base and spans[at].start <= start and end <= spans[at].end:
                continue
            bits = guess_bits(text[start:end], ranks)
            if bits >= GUESS_BITS:
                spans.append(Span("guess", start, end, bits))
    for kind, pattern, least in (("access", ACCESS, ACCESS_LEAST), ("hex", HEX, HEX_LEAST)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                spans.append(Span(kind, *m.span(), guess_bits(m[0], ranks)))
    spans.sort(key=lambda s: (s.start, KINDS.index(s.kind), s.end))
    return spans


SPANS = "array<struct<kind:string,start:long,end:long,bits:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, spans) for every row of `docs`, whole texts; a null or empty text has no spans.

    Rows that repeat a doc_id, or have none, each get a row; other columns are not read; an empty
    table gives an empty result.  `vocabulary` is a public tokenizer's file, known to all
    executors by that path, whose words are the dictionary of the guess cost.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = dictionary(path)
        found = [[s._asdict() for s in find(t, ranks)] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _ARROW)], ["doc_id", "spans"])

    return map_batches(docs.select("doc_id", text_of()), rows, f"doc_id long, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of `scan`: the columns of the registered query."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s.kind != "guess")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("guess").alias("n_guess"),
        F.round(F.array_max(F.transform("spans", lambda s: s.bits)), 3).alias("most_bits"),
    )
