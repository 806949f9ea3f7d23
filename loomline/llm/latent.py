"""Benchmark decontamination by latent semantic retrieval.

* *Terms* are words hashed into 2^14 columns; their inverse frequencies count every word
  of every document.
* *Basis.* A randomised SVD of TF-IDF passages gives ``rank`` directions. Every passage of every
  document and of the benchmark is added, with a random sign, to one of ``ROWS`` random rows: a
  sketch whose expected Gram matrix is that of all passages, of fixed size, and whose leading right
  singular vectors are the basis. Each task sums its share; shares are summed by key, a slice of
  terms each, and stay in a table: the driver gets their Gram matrix alone, sends back its eigenvectors
  and gets the basis. The benchmark's sketch weighs as much as the documents', however many these are.
* *Candidates.* Each document is cut into windows of 48 words, one every 24, so that any
  24 words in a row lie within one. Windows and benchmark passages meet by cosine in the
  basis, block by block as matrix products. Besides, every run of ``RUN`` words that a
  text shares with an item makes a candidate, whatever the cosine, so that no copy is
  missed that keeps such a run.
* *Bound.* A candidate goes on unless too few of the item's words occur in its text at
  all to reach the limits below; this drops none that could be confirmed.
* *Checks.* A candidate is confirmed by the longest common subsequence of words between
  the whole item and the text around the window: ``lcs_ratio`` of the item's words in
  order, and of its last sentence (its answer). A paraphrase must keep both; a near
  copy needs only the first, at a higher ratio.

Everything per document happens in one map: no shuffle, no limit on candidates. Items go to
executors in blocks of ``ITEM_BLOCK``; with more than one, each block's result is written
before the next one is sent, so that one block at a time is held.

Defined cases: null or empty texts match nothing; items that are null or have no words are
not searched for; items of fewer than ``LEAST_WORDS`` words are found as exact runs of words alone
(their ratios are 1); equal items each report; ids may be null or repeat; empty tables give an empty result; other columns are not read (``decontaminate``
passes them through untouched).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, let_go, record_batch
from .textkernel import mixed, text_groups, words_of

TERM_BITS, HALF = 14, 24
DIMS = 1 << TERM_BITS
RANK, SEED = 224, 7
#: Rows of the sketch of all passages.
ROWS = 512
MIN_COSINE = 0.3
#: (lcs_ratio, answer_ratio) that confirm an item: a near copy, or a paraphrase.
NEAR_COPY, PARAPHRASE = (0.75, 0.0), (0.55, 0.5)
LEAST_WORDS, MARGIN = 5, 8
#: Words in a row that are looked up exactly; LEAST_WORDS at most.
RUN = 3
#: Bits of a run's hash in the table that is tried first.
RUN_BITS = 20
#: Buckets of words in an item's table of positions; those of longer items than MOST_BITS words are not bounded.
BUCKET_BITS, MOST_BITS = 10, 64
#: 64-bit words of the coarser table that is tried first.
MARKS = 8
#: Items per search; a larger benchmark is searched in blocks of this many.
ITEM_BLOCK = 4096
#: Bytes of text, and rows of a matrix product, that are worked on at once.
GROUP_BYTES = 1 << 18

HITS = "doc_id long, item_id long, cosine double, lcs long, item_words long, lcs_ratio double, answer_ratio double, word_start long"


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _summed(parts: DataFrame, shape: tuple[int, int], kind) -> np.ndarray:
    """Blocks of a matrix of fixed size, added by key, as one matrix."""

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [_total(pdf["data"], kind).tobytes()]})

    return _gathered(parts.groupBy("block").applyInPandas(add_up, BLOCKS), shape, kind)


def _total(data: pd.Series, kind) -> np.ndarray:
    return sum(np.frombuffer(b, kind) for b in data)


def _gathered(blocks: DataFrame, shape: tuple[int, int], kind) -> np.ndarray:
    """Blocks as the rows of one matrix on the driver."""
    out, rows = np.zeros(shape, kind), blocks.collect()
    while rows:  # each goes as it is copied
        row = rows.pop()
        out[row["block"]] = np.frombuffer(row["data"], kind)
    let_go(blocks.sparkSession)
    return out


BLOCKS = "block long, data binary"
#: Slices of the sketch's columns; each is a block of ROWS x (DIMS / SLICES).
SLICES = 64
SKETCH = "source long, block long, data binary, square double"


def term_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each hashed term over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS, np.int64)
        for batch in batches:
            for _, raw, offsets in text_groups(batch.column(0), GROUP_BYTES):
                total += np.bincount(_terms(words_of(raw, offsets)[0]), minlength=DIMS)
        rows = total.reshape(8, -1)
        yield record_batch([(i, r.tobytes()) for i, r in enumerate(rows) if r.any()], arrow_schema(BLOCKS))

    return _summed(docs.select("text").mapInArrow(count, BLOCKS), (8, DIMS // 8), np.int64).reshape(-1)


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    """Squared: with plain ones, the words that every text has outweigh the telling ones."""
    return (np.log1p(counts.sum() / (counts + 1.0)) ** 2).astype(np.float32)


def sketched(texts: DataFrame, idf: np.ndarray, width: int) -> DataFrame:
    """(block, data): the signed sums of all texts' passages of ``width`` words, as TF-IDF rows of unit length,
    a task's share of ROWS x DIMS in slices of columns.

    texts: doc_id and text. Row and sign depend on a passage's text, its place and its text's id, so that
    neither order nor partitions matter and copies do not all get one sign.
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIMS), np.float32)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for rows, raw, offsets in text_groups(batch.column(1), GROUP_BYTES):
                hashes, doc, _ = words_of(raw, offsets)
                if len(hashes):
                    _add_passages(total, hashes, doc, ids[rows], shared.value, width)
        slices = np.split(total, SLICES, axis=1)
        yield record_batch([(i, x.tobytes()) for i, x in enumerate(slices) if x.any()], arrow_schema(BLOCKS))

    # A task's share is as large as the whole sketch, so there is one a core, whatever the input's partitions.
    few = texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(share, BLOCKS)


def sketch(texts: DataFrame, idf: np.ndarray, width: int) -> np.ndarray:
    """The whole of sketched, ROWS x DIMS, on the driver."""
    rows = _summed(sketched(texts, idf, width), (SLICES, ROWS * DIMS // SLICES), np.float32)
    return np.hstack(list(rows.reshape(SLICES, ROWS, -1)))


def _summed_sketches(parts: DataFrame) -> DataFrame:
    """SKETCH of parts with a source: their shares added, and the sum of squares of each slice."""

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _total(pdf["data"], np.float32)
        square = float(np.square(total, dtype=np.float64).sum())
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "block": [pdf["block"].iloc[0]], "data": [total.tobytes()], "square": [square]})

    return parts.groupBy("source", "block").applyInPandas(add_up, SKETCH)


def _add_passages(total: np.ndarray, hashes: np.ndarray, doc: np.ndarray, ids: np.ndarray, idf: np.ndarray, width: int) -> None:
    """Adds each text's runs of ``width`` words to their rows of total, one unit row with a sign each."""
    counts = np.bincount(doc, minlength=len(ids))
    per = -(-counts // width)
    place = np.arange(len(hashes)) - (np.cumsum(counts) - counts)[doc]
    passage = (np.cumsum(per) - per)[doc] + place // width
    heads = np.flatnonzero(place % width == 0)
    content = np.add.reduceat(mixed(hashes + (place % width).astype(np.uint64)), heads)
    luck = mixed(mixed(ids[doc[heads]] + np.uint64(SEED)) + mixed(content) + (place[heads] // width).astype(np.uint64))
    keys, tf = np.unique(passage << TERM_BITS | _terms(hashes), return_counts=True)
    passage, term = keys >> TERM_BITS, keys & (DIMS - 1)
    value = idf[term] * tf
    norm = np.sqrt(np.bincount(passage, value * value, minlength=len(heads)))
    sign = np.where(luck >> np.uint64(63), -1.0, 1.0) / np.maximum(norm, 1e-12)
    at = (luck % np.uint64(ROWS)).astype(np.int64)[passage] * DIMS + term
    np.add.at(total.reshape(-1), at, (value * sign[passage]).astype(np.float32))


def randomised_svd(sketches: DataFrame, rank: int = RANK) -> np.ndarray:
    """DIMS x rank: the leading right singular vectors of the sum of SKETCH's sources, each of norm one; zeros beyond its own rank."""
    norms = {r["source"]: r["norm"] for r in sketches.groupBy("source").agg(F.sqrt(F.sum("square")).alias("norm")).collect()}
    tall = 8

    def slice_of(pdf: pd.DataFrame) -> np.ndarray:
        each = (np.frombuffer(b, np.float32) / np.float32(norms[s] or 1.0) for s, b in zip(pdf["source"], pdf["data"], strict=True))
        return sum(each).reshape(ROWS, -1)

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        x = slice_of(pdf).astype(np.float64)
        return pd.DataFrame({"block": range(tall), "data": [g.tobytes() for g in np.split(x @ x.T, tall)]})

    grams = sketches.groupBy("block").applyInPandas(gram, BLOCKS)
    values, vectors = np.linalg.eigh(_summed(grams, (tall, ROWS * ROWS // tall), np.float64).reshape(ROWS, ROWS))
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    turn = vectors * np.where(values > max(values[0] * 1e-10, 1e-30), 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0)

    def turned(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [(slice_of(pdf).T @ turn).astype(np.float32).tobytes()]})

    basis = sketches.groupBy("block").applyInPandas(turned, BLOCKS)
    return _gathered(basis, (SLICES, DIMS * rank // SLICES), np.float32).reshape(DIMS, rank)


class Item:
    """One benchmark item: its words, its answer's, and what a subsequence check needs of them."""

    def __init__(self, item_id: int | None, text: str):
        self.item_id = item_id
        self.words = _hash_list(text)
        sentences = [s for s in text.replace("?", ".").replace("!", ".").replace("\n", " ").split(".") if s.strip()]
        answer = _hash_list(sentences[-1]) if sentences else []
        # A last sentence of a word or two says little; then the last quarter stands for it.
        n = len(answer) if 3 <= len(answer) < len(self.words) else max(1, len(self.words) // 4)
        self.masks = _masks(self.words)
        self.answer = _masks(self.words[-n:])
        self.answer_words = n

    def pieces(self) -> list[tuple[int, int]]:
        """Runs of at most HALF words that cover the item: what windows are compared with."""
        n = len(self.words)
        parts = -(-n // HALF)
        cuts = [round(i * n / parts) for i in range(parts + 1)]
        return list(zip(cuts[:-1], cuts[1:], strict=True))


def _hash_list(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]))[0].tolist()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs_length(masks: dict[int, int], n: int, words) -> int:
    """Longest common subsequence with the n words behind the masks, a word of bits at a time."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def confirmed(lcs_ratio: float, answer_ratio: float) -> bool:
    return any(lcs_ratio >= a and answer_ratio >= b for a, b in (NEAR_COPY, PARAPHRASE))


class Index:
    """What executors need to search: the weighted basis and the items, all of bounded size."""

    def __init__(self, basis: np.ndarray, idf: np.ndarray, items: list[Item]):
        # The last row stands for no word.
        self.weighted = np.concatenate([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)])
        self.items = items
        self.short = _short_items(items)
        self.pieces = [(i, a, b) for i, item in enumerate(items) if len(item.words) >= LEAST_WORDS for a, b in item.pieces()]
        rows = [self.weighted[_terms(np.array(items[i].words[a:b], np.uint64))].sum(0) for i, a, b in self.pieces]
        self.queries = _unit(np.array(rows, np.float32).reshape(-1, basis.shape[1]))
        # Every run of every item, by its hash: the item and where in it.
        runs = [_runs(np.array(item.words if len(item.words) >= LEAST_WORDS else [], np.uint64)) for item in items]
        sizes = [len(r) for r in runs]
        keys = np.concatenate([np.zeros(0, np.uint64), *runs])
        order = np.argsort(keys, kind="stable")
        # Each distinct run once, with where its places begin and how many they are.
        self.run_keys, self.run_first, self.run_count = np.unique(keys[order], return_index=True, return_counts=True)
        self.run_marks = np.zeros(1 << RUN_BITS, bool)
        self.run_marks[(self.run_keys & np.uint64((1 << RUN_BITS) - 1)).astype(np.int64)] = True
        self.run_item = np.repeat(np.arange(len(items)), sizes)[order]
        self.run_at = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in sizes]])[order]
        self.piece_item, self.piece_start, self.piece_end = np.array(self.pieces, np.int64).reshape(-1, 3).T
        # Pieces stand in the order of their items, so (item, start) finds the piece of a run.
        stride = 1 + max([len(item.words) for item in items], default=0)
        self.run_piece = np.searchsorted(self.piece_item * stride + self.piece_start, self.run_item * stride + self.run_at, side="right") - 1
        self.lengths = np.array([len(item.words) for item in items], np.int64)
        # Of each item and bucket of words: the positions where the item has such a word, as bits.
        self.positions = np.zeros((len(items), 1 << BUCKET_BITS), np.uint64)
        for i, item in enumerate(items):
            if len(item.words) <= MOST_BITS:
                np.bitwise_or.at(self.positions[i], _buckets(np.array(item.words, np.uint64)), np.uint64(1) << np.arange(len(item.words), dtype=np.uint64))

        # Distinct buckets of each item's words as bits, and how many words share one with another.
        self.marks = np.zeros((len(items), MARKS), np.uint64)
        for i, item in enumerate(items):
            self.marks[i] = np.bitwise_or.reduce(_marks(np.array(item.words, np.uint64)), axis=0)
        self.spare = self.lengths - np.bitwise_count(self.marks).sum(1)
        # Halves before and after a window's own that the text laid against any bounded item can reach.
        bounded = self.lengths[self.piece_item] <= MOST_BITS if len(self.pieces) else np.zeros(0, bool)
        after = (self.lengths[self.piece_item] - self.piece_end)[bounded] if len(self.pieces) else np.zeros(0, np.int64)
        self.reach = -(-(int(max(self.piece_start[bounded], default=0)) + MARGIN) // HALF), -(-(2 * HALF + int(max(after, default=0)) + MARGIN) // HALF)

    def search(self, column: pa.Array, min_cosine: float) -> Iterator[tuple]:
        """(row, item, cosine, lcs, lcs_ratio, answer_ratio, first word) of each confirmed pair, the best window's."""
        for rows, raw, offsets in text_groups(column, GROUP_BYTES):
            hashes, doc, _ = words_of(raw, offsets)
            if len(hashes) and self.pieces:
                yield from self._search_group(rows.start, hashes, doc, len(offsets) - 1, min_cosine)
            if len(hashes) and self.short:
                yield from self._search_short(rows.start, hashes, doc)

    def _search_short(self, base: int, hashes: np.ndarray, doc: np.ndarray):
        """The first place in each text of each short item's very words."""
        begins = np.searchsorted(doc, doc)
        found: dict[tuple[int, int], int] = {}
        for n, (keys, which) in self.short.items():
            got = _runs(hashes, n)
            low, high = np.searchsorted(keys, got), np.searchsorted(keys, got, side="right")
            for at in np.flatnonzero((high > low) & (doc[: len(got)] == doc[n - 1 :])).tolist():
                for i in which[low[at] : high[at]].tolist():
                    found.setdefault((int(doc[at]), i), at - int(begins[at]))
        for (d, i), at in found.items():
            yield base + d, i, 1.0, len(self.items[i].words), 1.0, 1.0, at

    def _search_group(self, base: int, hashes: np.ndarray, doc: np.ndarray, n_docs: int, min_cosine: float):
        counts = np.bincount(doc, minlength=n_docs)
        ends = np.cumsum(counts)
        begins = ends - counts
        halves = -(-counts // HALF)
        half_doc = np.repeat(np.arange(n_docs), halves)
        nth = np.arange(len(half_doc)) - np.repeat(np.cumsum(halves) - halves, halves)
        starts = begins[half_doc] + nth * HALF
        sums = self._sums(_terms(hashes), np.repeat(starts, HALF).reshape(-1, HALF) + np.arange(HALF), ends[half_doc])
        paired = sums.copy()
        joined = np.flatnonzero(half_doc[1:] == half_doc[:-1])
        paired[joined] += sums[joined + 1]
        # The last half of a text of several is in the window before it already.
        lone = (nth == halves[half_doc] - 1) & (nth > 0)
        windows = np.flatnonzero(~lone)
        scores = _unit(paired[windows]) @ self.queries.T
        w, p = np.nonzero(scores >= min_cosine)
        likely = self._likely(hashes, starts, half_doc, windows[w], self.piece_item[p])
        w, p = w[likely], p[likely]
        at = starts[windows[w]]
        lo, hi = at - self.piece_start[p] - MARGIN, at + 2 * HALF + self.lengths[self.piece_item[p]] - self.piece_end[p] + MARGIN
        # Shared runs: the text around is laid by the run's place in the item.
        begin, run = self._shared_runs(hashes, doc)
        first = begin - self.run_at[run]
        window = np.cumsum(~lone)[np.searchsorted(starts, begin, side="right") - 1] - 1
        near = np.stack([window, self.run_piece[run], first - HALF, first + self.lengths[self.run_item[run]] + HALF])
        if near.size:
            # One candidate per text, item and place, however many runs tell of it.
            _, once = np.unique(np.stack([doc[begin], self.run_item[run], first]), axis=1, return_index=True)
            near = near[:, once]
        w, p, lo, hi = (np.concatenate(pair) for pair in zip((w, p, lo, hi), near, strict=True))
        at, d = starts[windows[w]], half_doc[windows[w]]
        i, lo, hi = self.piece_item[p], np.maximum(begins[d], lo), np.minimum(ends[d], hi)
        able = self._able(_buckets(hashes), i, lo, hi)
        found: dict[tuple[int, int], tuple] = {}
        picked = [x[able].tolist() for x in (d, i, lo, hi, at - begins[d])]
        for d, i, lo, hi, at, cosine in zip(*picked, scores[w[able], p[able]].tolist(), strict=True):
            item, n = self.items[i], len(self.items[i].words)
            words = hashes[lo:hi].tolist()
            lcs = lcs_length(item.masks, n, words)
            best = found.get((d, i))
            if best and best[1] >= lcs or lcs < min(NEAR_COPY[0], PARAPHRASE[0]) * n:
                continue
            answer = lcs_length(item.answer, item.answer_words, words) / item.answer_words
            if confirmed(lcs / n, answer):
                found[d, i] = (cosine, lcs, lcs / n, answer, at)
        for (d, i), (cosine, lcs, ratio, answer, at) in found.items():
            yield base + d, i, cosine, lcs, ratio, answer, at

    def _sums(self, terms: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The weighted rows of each half window's words, summed word by word over slices that stay in a core's cache."""
        words = np.where(places < ends[:, None], terms[np.minimum(places, len(terms) - 1)], DIMS)
        sums = np.zeros((len(words), self.weighted.shape[1]), np.float32)
        row = np.empty((256, sums.shape[1]), np.float32)
        for a in range(0, len(words), 256):
            for at in words[a : a + 256].T.copy():
                sums[a : a + 256] += self.weighted.take(at, 0, row[: len(at)], "clip")
        return sums

    def _shared_runs(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, run): each place where a text has a run of an item, once per such run."""
        keys = _runs(hashes)
        if not len(keys) or not len(self.run_keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Most runs are no item's, as their last bits show.
        at = np.flatnonzero(self.run_marks[(keys & np.uint64(len(self.run_marks) - 1)).astype(np.int64)] & (doc[: len(keys)] == doc[len(hashes) - len(keys) :]))
        place = np.minimum(np.searchsorted(self.run_keys, keys[at]), len(self.run_keys) - 1)
        same = self.run_keys[place] == keys[at]
        at, place = at[same], place[same]
        counts = self.run_count[place]
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(at, counts), np.repeat(self.run_first[place], counts) + nth

    def _likely(self, hashes: np.ndarray, starts: np.ndarray, half_doc: np.ndarray, half: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Of windows that begin at these halves, and items: those not ruled out by buckets of words, cheaply, before _able looks closer.

        The halves that a window's text can reach hold every word of it. An item's words in it are
        no more than the buckets that both have, and the words that share a bucket.
        """
        own = np.bitwise_or.reduceat(_marks(hashes), starts, axis=0)
        cover = own.copy()
        for k in range(-self.reach[0], self.reach[1] + 1):
            a, b = max(0, -k), len(own) - max(0, k)
            if k and b > a:
                same = (half_doc[a:b] == half_doc[a + k : b + k])[:, None]
                cover[a:b] |= np.where(same, own[a + k : b + k], np.uint64(0))
        out, least = [], min(NEAR_COPY[0], PARAPHRASE[0])
        for a in range(0, len(half), 1 << 16):
            i = item[a : a + (1 << 16)]
            both = np.bitwise_count(cover[half[a : a + (1 << 16)]] & self.marks[i]).sum(1, dtype=np.int64)
            out.append(a + np.flatnonzero((both + self.spare[i] >= least * self.lengths[i]) | (self.lengths[i] > MOST_BITS)))
        return np.concatenate([np.zeros(0, np.int64), *out])

    def _able(self, buckets: np.ndarray, i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Candidates whose text has enough of the item's words for its longest common subsequence to reach a limit."""
        out, least = [], min(NEAR_COPY[0], PARAPHRASE[0])
        for a in range(0, len(i), 4096):
            item, start, size = i[a : a + 4096], lo[a : a + 4096], (hi - lo)[a : a + 4096]
            heads = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(heads - start, size)
            seen = np.bitwise_or.reduceat(self.positions[np.repeat(item, size), buckets[place]], heads)
            n = self.lengths[item]
            out.append(a + np.flatnonzero((np.bitwise_count(seen) >= least * n) | (n > MOST_BITS)))
        return np.concatenate([np.zeros(0, np.int64), *out])


def _short_items(items: list[Item]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of items of fewer than LEAST_WORDS words, by length: their hashes in order, and the items they belong to."""
    out = {}
    for n in range(1, LEAST_WORDS):
        which = np.array([i for i, item in enumerate(items) if len(item.words) == n], np.int64)
        if len(which):
            keys = np.array([_runs(np.array(items[i].words, np.uint64), n)[0] for i in which], np.uint64)
            order = np.argsort(keys, kind="stable")
            out[n] = (keys[order], which[order])
    return out


def _runs(hashes: np.ndarray, width: int = RUN) -> np.ndarray:
    """Hashes of each so many words in a row."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mixed(out + hashes[j : j + n])
    return out


def _marks(hashes: np.ndarray) -> np.ndarray:
    """Each word as one bit of 64 * MARKS."""
    out = np.zeros((len(hashes), MARKS), np.uint64)
    at = (hashes >> np.uint64(20)) & np.uint64(64 * MARKS - 1)
    out[np.arange(len(hashes)), (at >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (at & np.uint64(63))
    return out


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Item]]:
    """The benchmark's searchable items in blocks of ITEM_BLOCK, by id."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    block: list[Item] = []
    for row in rows.orderBy("i", "t").toLocalIterator():
        item = Item(row["i"], row["t"])
        if item.words:
            block.append(item)
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


def fit_basis(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(basis, inverse frequencies): both from every word of every document, the basis from all benchmark items besides."""
    idf = inverse_frequency(term_counts(docs))
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    parts = [sketched(x, idf, width).select(F.lit(i).cast("long").alias("source"), "block", "data") for i, (x, width) in enumerate(((docs, 2 * HALF), (items, HALF)))]
    basis = randomised_svd(scratch.cut(_summed_sketches(parts[0].union(parts[1])), "sketch"), rank)
    scratch.drop("sketch")
    return basis, idf


def find_contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """One row per confirmed (document, item): cosine, LCS and answer ratios, and where the window starts."""
    docs = _text_of(df, id_col, text_col)
    basis, idf = fit_basis(docs, benchmark)
    scratch, parts = Scratch(df.sparkSession), []
    for items, only in _with_only(item_blocks(benchmark)):
        shared = df.sparkSession.sparkContext.broadcast(Index(basis, idf, items))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            schema, index = arrow_schema(HITS), shared.value
            for batch in batches:
                hits = index.search(batch.column(1), min_cosine)
                rows = [(batch.column(0)[r].as_py(), index.items[i].item_id, round(c, 6), lcs, len(index.items[i].words), lcs_r, ans, at) for r, i, c, lcs, lcs_r, ans, at in hits]
                yield record_batch(rows, schema)

        parts.append(docs.mapInArrow(search, HITS))
        if not only:
            parts[-1] = scratch.cut(parts[-1], "hits")
            shared.destroy()
    return reduce(DataFrame.union, parts) if parts else df.sparkSession.createDataFrame([], HITS)


def _with_only(blocks: Iterator) -> Iterator[tuple[object, bool]]:
    """Each block, and whether it is the only one."""
    first, second = next(blocks, None), next(blocks, None)
    if first is not None:
        yield first, second is None
    for block in chain([second] if second is not None else [], blocks):
        yield block, False


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """df without the rows that hold a benchmark item; all columns as they are."""
    basis, idf = fit_basis(_text_of(df, "doc_id", text_col) if "doc_id" in df.columns else df.select(F.monotonically_increasing_id().alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    at, scratch, label = df.columns.index(text_col), Scratch(df.sparkSession), None
    for n, (items, only) in enumerate(_with_only(item_blocks(benchmark))):
        shared = df.sparkSession.sparkContext.broadcast(Index(basis, idf, items))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {hit[0] for hit in shared.value.search(batch.column(at), min_cosine)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        df = df.mapInArrow(keep, df.schema)
        if not only:
            df = scratch.cut(df, f"kept-{n}")
            shared.destroy()
            scratch.drop(*([label] if label else []))
            label = f"kept-{n}"
    return df
