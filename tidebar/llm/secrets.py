"""Secret scans: fixed patterns, and credential-context values that are costly to guess.

The guess cost of a value is the least over its segmentations into words, dates, repeats, keyboard walks and brute-force spans of
the product of the parts' guesses, found by dynamic programming over its characters (in log10). Words are ranked: those that guessers
try early, then the DICTIONARY commonest of the documents themselves.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches

KINDS = ("assign", "access", "hex", "guess")
#: A context value with at least this log10 of guesses is a secret.
COSTLY = 10.0

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

#: Words before a value that make it a credential: more than the base patterns know.
CONTEXT = re.compile(r"""(?<![a-z0-9])(?:password|passwd|passphrase|pwd|pass|secret|credentials?|access_?key|secret_?key|api[_-]?key|auth(?:orization)?|bearer|token|login)["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?(?:bearer\x20+)?([!-~]{8,})""", re.A | re.I)
HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "login")

# Words that guessers try early, most frequent first, and keyboard rows.
COMMON = (
    "password 123456 qwerty admin welcome login master hello dragon monkey letmein football iloveyou sunshine princess shadow secret summer winter spring autumn "
    "access account april august baby batman blue changeme charlie chicken company computer cookie daniel december default demo diamond dog example family "
    "february flower freedom friday game ginger google guest hunter internet january jordan july june killer london love manager march matrix michael monday "
    "money mother mustang network nothing november october office orange people pepper phoenix please pokemon purple robert root rocket samsung saturday "
    "september server service silver soccer star starwars sunday super superman system taylor temp test thomas thursday tiger token tuesday user wednesday "
    "whatever william wizard world yellow zxcvbn the and for you are with this that from have not"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
#: Words of the documents that are ranked, and the lengths that words have.
DICTIONARY, SHORTEST, LONGEST = 20_000, 3, 16
LEET = str.maketrans("@4310$57!", "aaeiossti")
#: The direction of a step from one key to a neighbouring one.
STEP = {(a, b): "right" for row in ROWS for a, b in zip(row, row[1:])} | {(b, a): "left" for row in ROWS for a, b in zip(row, row[1:])}
for _up, _down in zip(ROWS, ROWS[1:]):
    for _i, _a in enumerate(_up):
        for _b in _down[max(0, _i - 1) : _i + 1]:
            STEP |= {(_a, _b): "down", (_b, _a): "up"}
DATES = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))|(?:(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d)|(?:19|20)\d\d")


def _classes(text: str) -> int:
    return 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text) + 10 * any(c.isdigit() for c in text) + 33 * any(not c.isalnum() for c in text)


def ranked_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> dict[str, int]:
    """Ranks of words: COMMON's, then those of the `most` commonest words (of a-z, A-Z lower-cased) of all texts, ties in order of the words."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("word")).where(F.length("word").between(SHORTEST, LONGEST))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect()
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *(r["word"] for r in top)]))}


def parts(value: str, rank: dict[str, int] = RANK) -> Iterator[tuple[int, int, str, float]]:
    """Spans (start, end, kind, log10 guesses) of the cheaper ways to make a piece of value."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            if place := rank.get(low[i:j]) or rank.get(plain[i:j]):
                own = value[i:j]
                yield i, j, "word", log10(place) + (0 if own.islower() else 0.4 if own.istitle() else 1) + (0 if low[i:j] in rank else 0.6)
        if found := DATES.match(low, i):
            yield i, found.end(), "date", log10(365 * 60) if found.end() - i > 4 else log10(120)
    for i in range(n - 2):
        if i and low[i - 1] == low[i]:
            continue
        j = i + 1
        while j < n and low[j] == low[i]:
            j += 1
        for k in range(i + 3, j + 1):
            yield i, k, "repeat", log10(40 * (k - i))
    for size in range(2, 9):
        i = 0
        while i + 2 * size <= n:
            if low[i : i + size] == low[i + size : i + 2 * size]:
                j = i + 2 * size
                while low[j : j + size] == low[i : i + size] and j + size <= n:
                    j += size
                yield i, j, "repeat", size * log10(36) + log10((j - i) / size)
                i = j - size + 1
            else:
                i += 1
    steps = [STEP.get((a, b)) or ("next" if ord(b) - ord(a) == 1 and b.isalnum() else "before" if ord(a) - ord(b) == 1 and a.isalnum() else None) for a, b in zip(low, low[1:])]
    i = 0
    while i < n - 2:
        j, turns = i, 0
        while j < n - 1 and steps[j]:
            turns += j > i and steps[j] != steps[j - 1]
            j += 1
            if j - i >= 2:
                yield i, j + 1, "walk", log10(47 * (j + 1 - i)) + 0.4 * turns
        i = max(j, i + 1)


def guess_cost(value: str, rank: dict[str, int] = RANK) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses that the cheapest segmentation of value takes, and that segmentation. Empty: 0."""
    by_end: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, cost in parts(value, rank):
        by_end.setdefault(j, []).append((i, kind, cost))
    single = log10(max(10, _classes(value)))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    for j in range(1, len(value) + 1):
        # A brute-force span grows by one character; a new part costs a little, as its place has to be guessed too.
        ways = [(best[j - 1][0] + single, j - 1, "brute")]
        ways += [(best[i][0] + cost + 0.3, i, kind) for i, kind, cost in by_end.get(j, ())]
        best.append(min(ways))
    found, j = [], len(value)
    while j:
        _, i, kind = best[j]
        if found and found[-1][2] == kind == "brute":
            found[-1] = (i, found[-1][1], kind)
        else:
            found.append((i, j, kind))
        j = i
    return best[-1][0], found[::-1]


def find_secrets(text: str, costly: float = COSTLY, rank: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as in KINDS. guess spans are those that no base span covers."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if any(x in low for x in HINTS):
        base = sorted(out)
        ends = list(accumulate((e for _, e, _ in base), max))
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip("\"'`,;.)]}>")
            start = m.start(1)
            end = start + len(value)
            # The furthest end of the base spans that start no later: what reaches beyond the value covers it.
            at = bisect_left(base, (start + 1,))
            if at and ends[at - 1] >= end:
                continue
            if len(value) >= 8 and guess_cost(value, rank)[0] >= costly:
                out.append((start, end, 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", costly: float = COSTLY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, n_guess, spans), a row for each row of docs.

    Whole texts are searched; null and empty ones hold nothing (the digest is that of the empty string). Positions count code points, the
    end is exclusive. Texts of any length take one pass, after one over all texts that ranks their words; repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    rank = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = [find_secrets(x.decode(), costly, rank.value) for x in texts]
            many = [pa.array([sum(y[2] == k for y in x) for x in found], pa.int64()) for k in KINDS]
            base = [sha256(_digest([y for y in x if y[2] != "guess"]).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *many[:3], pa.array(base, pa.string()), many[3], pa.array([_digest(x) for x in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_guess", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, n_guess long, spans string")


def redact(text: str, costly: float = COSTLY, rank: dict[str, int] = RANK, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, end, _ in find_secrets(text, costly, rank):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def without_secrets(docs: DataFrame, text_col: str = "text", costly: float = COSTLY) -> DataFrame:
    """docs with each run of overlapping secrets replaced by [SECRET]; every row and column stays, null texts too."""
    small_batches(docs.sparkSession)
    rank = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([None if x is None else redact(x, costly, rank.value) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
