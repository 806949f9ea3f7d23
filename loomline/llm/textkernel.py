"""Words and shingles of many texts at once, in numpy over the raw UTF-8.

Words are runs of bytes that are none of the ASCII white space 0x20, 0x09-0x0D, with
A-Z lowered; each gets a 64-bit polynomial hash of its bytes, mixed. A shingle's hash
combines its words' hashes in order. Two different words or shingles share a hash with
a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 256), _BASE, np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_groups(column: pa.Array, most_bytes: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows of about most_bytes: the rows, their bytes end to end, and n+1 offsets. Nulls are empty."""
    column = column.cast(pa.binary()) if not pa.types.is_large_binary(column.type) else column
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64) if offsets is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(at, at[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield slice(start, stop), raw[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: each word's hash, its text's number, and the byte it starts at."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), none, none
    inside = ~SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    starts[firsts] = inside[firsts]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), none, none
    spans = np.diff(np.append(at, len(raw)))
    place = np.arange(at[0], len(raw)) - np.repeat(at, spans)
    values = (LOWER[raw[at[0] :]].astype(np.uint64) + np.uint64(1)) * inside[at[0] :]
    values *= _power_table(int(spans.max()) + 1)[place]
    hashes = mixed(np.add.reduceat(values, at - at[0]))
    doc = np.searchsorted(offsets, at, side="right") - 1
    return hashes, doc, at


def shingles_of(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of k words, sorted; a shorter text is one shingle, an empty one none."""
    counts = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    ends = np.cumsum(counts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * _STEP + hashes[j : n - k + 1 + j] if n >= k else rolled
    rolled = mixed(rolled)
    out = []
    for i in range(n_docs):
        a, b = int(ends[i] - counts[i]), int(ends[i])
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for v in hashes[a:b]:
                h = h * _STEP + v
            out.append(mixed(h + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column: pa.Array, k: int, most_bytes: int = 1 << 18) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Row runs of a text column with their distinct shingle hashes."""
    for rows, raw, offsets in text_groups(column, most_bytes):
        hashes, doc, _ = words_of(raw, offsets)
        yield rows, shingles_of(hashes, doc, len(offsets) - 1, k)
