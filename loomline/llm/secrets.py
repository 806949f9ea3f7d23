"""Secret scan: fixed patterns, and password guess costs for values in credential context.

Every value that follows a credential word and ``:`` or ``=`` is cut into segments by
dynamic programming. A segment is a known word, a date, a repeat of a character or a block, a
keyboard walk, a run of letters that reads like a word, or brute force, each with a guess count; the cheapest segmentation is what a good guesser
would need. Values that cost at least ``min_log10`` guesses become spans of kind
``guess``. Values cheaper than that (``changeme``, ``qwerty123``) are placeholders, not secrets.

The cost found is the least over all segmentations; a repeated block and a run of letters count as they are
longest, words and characters in any part. Words and dates end within fixed lengths
of their start, and runs keep the starts that can still win, so the work grows with the value's
length. Positions are code points, ends exclusive.

Defined cases: a null text counts as empty; an empty text has no spans and the digest
of the empty string; ids may be null or repeat, each row is judged alone; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from string import ascii_lowercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, record_batch
from .tokens import TOKENIZER_PATH, load_vocabulary

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "guess")

#: Runs shorter than the least are not worth a match object; longer ones match as HEX does.
_HEX_LONG = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
CONTEXT = re.compile(
    r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"
    r"[\"']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*[\"'`]?([^\s\"'`<>,;(){}]{6,})",
    re.ASCII,
)

# Our own short list of common passwords and placeholders, commonest first; a vocabulary adds the words of a language.
WORDS = (
    "password", "secret", "admin", "qwerty", "welcome", "letmein", "monkey", "dragon", "master", "login",
    "princess", "sunshine", "football", "baseball", "shadow", "superman", "batman", "trustno", "iloveyou", "hello",
    "freedom", "whatever", "michael", "jordan", "hunter", "summer", "winter", "spring", "autumn", "flower",
    "changeme", "change", "example", "sample", "default", "test", "testing", "demo", "dummy", "placeholder",
    "your", "here", "token", "api", "key", "user", "username", "root", "guest", "pass",
    "none", "null", "true", "false", "undefined", "string", "value", "enter", "insert", "replace",
    "abc", "foo", "bar", "baz", "temp", "backup", "server", "database", "access", "private",
    "public", "client", "auth", "bearer", "basic", "config", "local", "dev", "prod", "stage",
)
# The rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
# Look-alike digits and signs.
LOOKALIKES = str.maketrans("0134578@$!", "oleastbasi")

RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
#: Longer words are no segments of their own; brute force and shorter words cover them.
LONGEST_WORD = 20
DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"),
)
LETTERS = re.compile(r"[a-z]+")
YEAR = re.compile(r"(?:19|20)\d\d")
PROSE = re.compile(r"(?<![a-z])[a-z]{4,20}(?![a-z])")
PLACES = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
#: A whole lower-case run that could be a word of some language, but is in no list.
UNLISTED_WORD, SEGMENT, WALK_STEP = 5.0, math.log10(2), 0.35
#: It could be one whose letters, each given the one before as in the listed words, cost this on the average.
#: Of random runs, 0.5 % of 12 letters and 1.5 % of 8 cost less (4000 each); letters that all are as likely cost 1.41.
WORDLIKE, UNSEEN = 1.55, 0.5
#: The longest block whose repeats are one segment.
LONGEST_BLOCK = 16


def _adjacent(a: str, b: str) -> bool:
    p, q = PLACES.get(a.lower()), PLACES.get(b.lower())
    return p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


def _word_cost(part: str, ranks: dict[str, int]) -> float | None:
    low = part.lower()
    rank, extra = ranks.get(low), 0.0
    if rank is None:
        rank, extra = ranks.get(low.translate(LOOKALIKES)), math.log10(4)
        if rank is None:
            return None
    if part != low:
        extra += math.log10(2) if part[0].isupper() and part[1:] == low[1:] or part.isupper() else math.log10(len(part)) + 1
    return math.log10(rank + 1) + extra


class Ranks(dict):
    """Words with their ranks, and what the step from one letter to the next costs in them."""

    def __init__(self, words: dict[str, int]):
        super().__init__(words)
        steps = Counter(pair for w in words if LETTERS.fullmatch(w) for pair in pairwise(f"^{w}$"))
        begun = Counter()
        for (a, _), n in steps.items():
            begun[a] += n
        # 26 letters or the end may follow; a step not seen counts UNSEEN times.
        self.steps = {(a, b): -math.log10((steps[a, b] + UNSEEN) / (begun[a] + 27 * UNSEEN)) for a in "^" + ascii_lowercase for b in ascii_lowercase + "$"}

    def wordlike(self, run: str) -> bool:
        return sum(self.steps[pair] for pair in pairwise(f"^{run}$")) <= WORDLIKE * len(run)

    def __reduce__(self):
        return Ranks, (dict(self),)


def word_ranks(vocabulary: bytes) -> Ranks:
    """Words to guess by, with their ranks: our list, then the vocabulary's whole words in its order.

    A vocabulary of byte pairs lists frequent words first; those that start with a space are words.
    """
    ranks = dict(RANKS)
    for line in vocabulary.splitlines():
        raw = base64.b64decode(line.split()[0]) if line else b""
        word = raw[1:].decode(errors="replace").lower()
        if raw[:1] == b" " and 3 <= len(word) <= LONGEST_WORD and word.isalpha() and word not in ranks:
            ranks[word] = len(ranks) + 1
    return Ranks(ranks)


def guess_log10(value: str, ranks: dict[str, int] = RANKS) -> float:
    """log10 of the guesses that the cheapest segmentation of the value needs."""
    return segmented(value, ranks)[0]


def walk_cost(length: int) -> float:
    return math.log10(47) + WALK_STEP * (length - 1)


def fixed_segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, cost) of every word, date and repeated block in the value.

    Runs of letters are judged whole, and only by ranks that know steps between letters (``Ranks``).
    """
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            if (cost := _word_cost(value[i:j], ranks)) is not None:
                yield i, j, "word", cost
        for date in DATES:
            if m := date.match(value, i):
                yield i, m.end(), "date", math.log10(365 * 150) + (math.log10(4) if m.end() - i > 8 else 0)
        if m := YEAR.match(value, i):
            yield i, m.end(), "date", math.log10(150)
    if isinstance(ranks, Ranks):
        for m in PROSE.finditer(value):
            if ranks.wordlike(m.group()):
                yield m.start(), m.end(), "word", UNLISTED_WORD
    yield from repeated_blocks(value)


def repeated_blocks(value: str) -> Iterator[tuple[int, int, str, float]]:
    """Each longest part that is a block of 2 to LONGEST_BLOCK characters twice or more, the last perhaps in part."""
    n = len(value)
    for size in range(2, min(LONGEST_BLOCK, n // 2) + 1):
        start = 0
        for i in range(n - size + 1):
            if i < n - size and value[i] == value[i + size]:
                continue
            if i - start >= size:
                end = i + size
                yield start, end, "repeat", sum(map(_char_cost, value[start : start + size])) + math.log10(math.ceil((end - start) / size))
            start = i + 1


def segmented(value: str, ranks: dict[str, int] = RANKS) -> tuple[float, list[tuple[str, str]]]:
    """The least cost of all segmentations, and one of its segmentations as (kind, text).

    Each segment costs its guesses and SEGMENT; neighbouring brute-force characters are one
    segment. So a position has two least costs: with brute force going on, and with a segment
    just ended. Repeats and walks may be any part, of three characters or more, of a run:
    * a walk's cost is linear in its length, so the best start of a run is kept as one number;
    * a repeat's grows with the logarithm, so a later start that is not better at its
      first end never is; only starts that are stay in the list.
    """
    n = len(value)
    ends: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, cost in fixed_segments(value, ranks):
        ends.setdefault(j, []).append((i, kind, cost))
    # Per position: (least cost, start of the last segment, its kind) with brute force last, and with another kind.
    brute: list[tuple[float, int]] = [(math.inf, 0)] * (n + 1)
    other: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    best = [0.0] + [math.inf] * n
    same = walk = 0  # where the runs began
    repeats: list[int] = []
    walk_start = None
    for j in range(1, n + 1):
        c = value[j - 1]
        if j > 1 and c != value[j - 2]:
            same, repeats = j - 1, []
        if j > 1 and (c == value[j - 2] or not _adjacent(c, value[j - 2])):
            walk, walk_start = j - 1, None
        found = other[j]
        for start, kind, cost in ends.pop(j, ()):
            found = min(found, (best[start] + cost + SEGMENT, start, kind))
        if (i := j - 3) >= same:
            at = lambda start, j=j, one=_char_cost(c): best[start] + one + math.log10(j - start) + SEGMENT
            if not repeats or at(i) < min(map(at, repeats)):
                repeats.append(i)
            found = min([found, *((at(start), start, "repeat") for start in repeats)])
        if i >= walk:
            if walk_start is None or best[i] - WALK_STEP * i < best[walk_start] - WALK_STEP * walk_start:
                walk_start = i
            found = min(found, (best[walk_start] + walk_cost(j - walk_start) + SEGMENT, walk_start, "walk"))
        other[j] = found
        one = _char_cost(c)
        on, new = brute[j - 1][0] + one, other[j - 1][0] + one + SEGMENT
        brute[j] = (on, brute[j - 1][1]) if on <= new else (new, j - 1)
        best[j] = min(brute[j][0], other[j][0])
    parts: list[tuple[str, str]] = []
    j = n
    while j:
        start, kind = (brute[j][1], "brute") if brute[j][0] < other[j][0] else other[j][1:]
        parts.append((kind, value[start:j]))
        j = start
    return best[n], parts[::-1]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three fixed patterns, matches that fail their length dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), "hex", m.end()) for m in _HEX_LONG.finditer(text)]
    return found


def guess_spans(text: str, min_log10: float, ranks: dict[str, int] = RANKS) -> list[tuple[int, str, int]]:
    if ":" not in text and "=" not in text:
        return []
    return [(m.start(1), "guess", m.end(1)) for m in CONTEXT.finditer(text) if guess_log10(m.group(1), ranks) >= min_log10]


def joined(spans: list[tuple[int, str, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in order)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 8.0, vocabulary_path: str | None = TOKENIZER_PATH
) -> DataFrame:
    """One row per input row: counts by kind, the base digest, and all spans as kind:start:end.

    vocabulary_path: a tokenizer's file whose words are guessed besides our list; its size is checked.
    """
    words = word_ranks(load_vocabulary(vocabulary_path)) if vocabulary_path else RANKS
    shared = df.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SCHEMA)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                more = guess_spans(text, min_log10, shared.value)
                counts = [sum(s[1] == k for s in base) for k in KINDS[:3]]
                rows.append((doc_id, *counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            yield record_batch(rows, schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
