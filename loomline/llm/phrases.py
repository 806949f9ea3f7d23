"""Removal of passages that repeat: recurring windows are confirmed, compiled into automata, and located.

A window is ``WINDOW`` consecutive words of one document; a word is removed if a window that covers
it has the same words as one that starts earlier (in a document of a smaller id, or earlier in
the same document). Windows are judged on the input, not on what is left.

1. *Anchors.* Of the ``ANCHOR``-word phrases in a window the one of the least hash is its anchor, so that
   equal windows have equal anchors, and neighbouring windows mostly share theirs: about one phrase in
   seven is an anchor. Anchors are counted over the whole corpus; a bitmap of fixed size holds those that recur.
2. *Segments.* Each run of windows with a recurring anchor is sent, as the text that it covers, to
   the shard of that anchor: all documents are streamed, but a shard gets only what may be in its automaton.
3. *Confirmation.* Within a shard, windows that recur are found. Windows that always occur
   in a row are one phrase. Each phrase is compiled, word by word, into the Aho-Corasick automaton of
   its batch of anchors, with the place where it occurs first.
4. *Location.* The shard's segments are streamed through the automaton; each match that starts later than
   the phrase's first place is a span to remove.
5. *Hot anchors*, of which there are more segments than ``_most_segments``, are salted over many tasks: these
   first sum up their distinct windows, counts and first places; phrases that recur over all of them go to
   every salt of their anchor, where the segments are streamed through the automaton.

Automata match words exactly; hashes only choose what is compared. Two different windows that share a 64-bit
hash in one batch could hide each other (2^-64 a pair); nothing can be removed by that. The bitmap (2^27 bits)
spares segments of anchors that do not recur; full, it would spare none, and the result would be the same.

Defined cases: null texts have no words; texts of fewer words than a window keep them all; a null id comes
before all others; rows equal in id and text get one result; rows that share an id alone stand at one place,
so that of equal windows of theirs only later starts are removed; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, record_batch
from .textkernel import mixed, text_groups, words_of

WINDOW, ANCHOR = 20, 8
BITMAP_BITS = 27
#: Spark's bitmap aggregates hold this many bits a row.
BITMAP_ROW = 32768
#: Windows looked at together; bytes of text; segments and bytes of an automaton's batch.
CHUNK, TEXT_BYTES, BATCH_SEGMENTS, BATCH_BYTES = 1 << 20, 1 << 20, 16_384, 1 << 23
#: Hot anchors that a task may know of, at most.
MOST_HOT = 1 << 16
_STEP = np.uint64(0xD6E8FEB86659FD93)

SEGMENT = "anchor long, salt int, doc_id long, text_key long, first long, words binary"
SPAN = "doc_id long, text_key long, from_word long, to_word long"
PHRASE = "anchor long, words binary, n long, doc_id long, first long"


def _rolled(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k values in a row."""
    n = max(0, len(values) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + values[j : j + n]
    return mixed(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n])


def anchor_runs(hashes: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words in a row: each run of windows that share an anchor, as the anchor, the first window and the last."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return np.zeros(0, np.uint64), none, none
    phrases, width, starts = _rolled(hashes, anchor), window - anchor + 1, len(hashes) - window + 1
    low = np.uint64((1 << (CHUNK.bit_length() + 1)) - 1)
    found = []
    for a in range(0, starts, CHUNK):
        b = min(starts, a + CHUNK)
        part = phrases[a : b + width - 1]
        # The leftmost of equal phrases: a window's choice rests on its words alone.
        ranked = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        at = (_sliding_min(ranked, width) & low).astype(np.int64) + a
        valid = doc[a:b] == doc[a + window - 1 : b + window - 1]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        first = np.flatnonzero(begins)
        stops = np.flatnonzero(valid & np.append((~valid[1:]) | begins[1:], True))
        found.append((phrases[at[first]], first + a, stops + a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchor_counts(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, n) of anchors that occur more than once."""
    ddl = "anchor long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            for _, raw, offsets in text_groups(batch.column(0), TEXT_BYTES):
                hashes, doc, _ = words_of(raw, offsets)
                found, n = np.unique(anchor_runs(hashes, doc, window, anchor)[0].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], schema=schema)

    return docs.select("text").mapInArrow(count, ddl).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def _bitmap(counts: DataFrame) -> np.ndarray:
    """The recurring anchors as a bitmap of fixed size."""
    spot = F.col("anchor").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = counts.select(spot.alias("s")).groupBy(F.expr(f"s div {BITMAP_ROW}").alias("row_")).agg(F.bitmap_construct_agg(F.expr(f"s % {BITMAP_ROW}")).alias("bits"))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["row_"] * BITMAP_ROW // 8 :][: BITMAP_ROW // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def segments(docs: DataFrame, bitmap, hot, window: int, anchor: int, only_hot: bool) -> DataFrame:
    """Each run of windows with a recurring anchor: its anchor, salt, place and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, bits, parts = arrow_schema(SEGMENT), bitmap.value, hot.value
        hot_anchors = np.array(sorted(parts), np.int64)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for rows, raw, offsets in text_groups(batch.column(1), TEXT_BYTES):
                hashes, doc, at = words_of(raw, offsets)
                anchors, lo, hi = anchor_runs(hashes, doc, window, anchor)
                anchors = anchors.view(np.int64)
                spot = anchors & ((1 << BITMAP_BITS) - 1)
                picked = (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                is_hot = np.isin(anchors, hot_anchors)
                picked &= is_hot if only_hot else ~is_hot
                anchors, lo, hi = anchors[picked], lo[picked], hi[picked]
                if not len(anchors):
                    continue
                owner = doc[lo]
                firsts = np.searchsorted(doc, np.arange(len(offsets) - 1))
                ends = np.minimum(np.append(at, len(raw))[hi + window], offsets[owner + 1])
                whole = raw.tobytes()
                texts = [whole[a:b] for a, b in zip(at[lo].tolist(), ends.tolist(), strict=True)]
                first = lo - firsts[owner]
                which = pa.array(owner + rows.start)
                salt = np.zeros(len(anchors), np.int32)
                if only_hot:
                    own = mixed(keys.take(which).to_numpy().view(np.uint64) + first.astype(np.uint64))
                    salt = (own % np.array([parts[a] for a in anchors.tolist()], np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(salt), ids.take(which), keys.take(which), pa.array(first), pa.array(texts, pa.binary())], schema=schema)

    return docs.select("doc_id", "text", "text_key").mapInArrow(cut, SEGMENT)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < BATCH_SEGMENTS and sum(b.nbytes for b in held) < BATCH_BYTES:
            continue
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_numpy() for k in keys]
        same = np.all([c == c[-1] for c in columns], axis=0)
        stop = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if stop:
            yield table.slice(0, stop).combine_chunks()
            held = table.slice(stop).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Words:
    """Texts as one row of words, and as a string with as many characters for each word."""

    def __init__(self, texts: list[bytes]):
        lists = [t.split() for t in texts]  # at the white space of ASCII, as words are defined
        numbers: dict[bytes, int] = {}
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(lists)), np.int64, int(self.lengths.sum()))
        # Each digit has letters of its own, so that a match can only begin with a word.
        self.digits = max(1, -(-(max(1, len(numbers) - 1)).bit_length() // 6))
        letters = [(self.ids >> (6 * d) & 63) + 0x100 + 64 * d for d in range(self.digits)]
        self.text = np.stack(letters, axis=1).astype("<u4").tobytes().decode("utf-32-le") if len(self.ids) else ""

    def part(self, start: int, n: int) -> str:
        return self.text[start * self.digits : (start + n) * self.digits]


class _Windows:
    """All windows of a batch of segments, numbered by their words, with places and counts."""

    def __init__(self, words: _Words, place: np.ndarray, window: int):
        n, ids = len(words.ids), words.ids
        self.owner = np.repeat(np.arange(len(words.lengths)), words.lengths)
        hashes = _rolled(mixed((ids + 1).astype(np.uint64)), window)
        inside = self.owner[: len(hashes)] == self.owner[window - 1 :] if len(hashes) else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)
        _, self.number, self.counts = np.unique(hashes[self.at], return_inverse=True, return_counts=True)
        self.place = place[self.owner[self.at]] + self.at - words.starts[self.owner[self.at]]
        # Windows by number and place: the first of each number, and what follows it.
        order = np.lexsort((self.place, self.number))
        bounds = np.cumsum(self.counts) - self.counts
        self.first = order[bounds] if len(order) else order
        where = np.full(n + 1, -1, np.int64)
        where[self.at] = np.arange(len(self.at))
        after = where[self.at + 1]
        next_ = np.where((after >= 0) & (self.owner[np.minimum(self.at + 1, n - 1)] == self.owner[self.at]), self.number[np.maximum(after, 0)], -1) if len(self.at) else after
        if len(order):
            low, high = np.minimum.reduceat(next_[order], bounds), np.maximum.reduceat(next_[order], bounds)
            linked = (low == high) & (low >= 0)
            linked[linked] &= self.counts[low[linked]] == self.counts[linked]
            self.link = np.where(linked, low, -1)
        else:
            self.link = order

    def phrases(self) -> Iterator[tuple[int, int, int]]:
        """(window, length, place) of phrases of windows that recur: the first window, how many follow in a row, and where."""
        recur = np.flatnonzero(self.counts > 1)
        if not len(recur):
            return
        firsts = self.first[recur]
        order = np.argsort(self.at[firsts])
        recur, firsts = recur[order], firsts[order]
        goes_on = (self.at[firsts[1:]] == self.at[firsts[:-1]] + 1) & (self.link[recur[:-1]] == recur[1:])
        heads = np.flatnonzero(np.append(True, ~goes_on))
        lengths = np.diff(np.append(heads, len(recur)))
        yield from zip(firsts[heads].tolist(), lengths.tolist(), self.place[firsts[heads]].tolist(), strict=True)


#: Places in one number: a document's rank in its batch, then the word.
PLACE_BITS = 40


def _ranks(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rank of each id among the column's; null is the least."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    ids = column.fill_null(0).to_numpy(zero_copy_only=False)
    known = np.unique(ids[~null])
    return np.where(null, 0, np.searchsorted(known, ids) + 1).astype(np.int64)


def _spans(table: pa.Table, words: _Words, automaton, digits: int, place: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """Merged spans of matches that start later than their phrase's first place."""
    out, first = [], table.column("first").to_numpy()
    ids, keys = table.column("doc_id").to_pylist(), table.column("text_key").to_pylist()
    for i in rows.tolist():
        found = []
        for end, (n, earliest) in automaton.iter(words.part(int(words.starts[i]), int(words.lengths[i]))):
            start = (end + 1) // digits - n
            if place[i] + start > earliest:
                found.append((start, start + n))
        found.sort()
        at = int(first[i])
        while found:
            a, b = found[0]
            rest = 0
            while rest < len(found) and found[rest][0] <= b:
                b = max(b, found[rest][1])
                rest += 1
            out.append((ids[i], keys[i], at + a, at + b))
            found = found[rest:]
    return out


def _confirm_and_locate(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    schema = arrow_schema(SPAN)
    for table in _whole_groups(batches, ["anchor"]):
        anchors = table.column("anchor").to_numpy()
        _, inverse, counts = np.unique(anchors, return_inverse=True, return_counts=True)
        table = table.filter(pa.array(counts[inverse] > 1))
        if not table.num_rows:
            continue
        words = _Words(table.column("words").to_pylist())
        place = (_ranks(table.column("doc_id").combine_chunks()) << PLACE_BITS) + table.column("first").to_numpy()
        windows = _Windows(words, place, window)
        automaton = ahocorasick.Automaton()
        for w, n, earliest in windows.phrases():
            automaton.add_word(words.part(int(windows.at[w]), window + n - 1), (window + n - 1, earliest))
        if len(automaton):
            automaton.make_automaton()
            later = windows.place > windows.place[windows.first][windows.number]
            rows = np.unique(windows.owner[windows.at[later]])
            yield record_batch(_spans(table, words, automaton, words.digits, place, rows), schema)


def _distinct_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of each hot anchor in the task: its distinct windows, how often they occur, and where first."""
    schema = arrow_schema(PHRASE)
    for table in _whole_groups(batches, ["anchor", "salt"]):
        anchors = table.column("anchor").to_numpy()
        ids, first, texts = table.column("doc_id").to_pylist(), table.column("first").to_numpy(), table.column("words").to_pylist()
        words = _Words(texts)
        place = (_ranks(table.column("doc_id").combine_chunks()) << PLACE_BITS) + first
        windows = _Windows(words, place, window)
        out = []
        # A window's words hold its anchor, but another run's anchor may be in them too: windows are told apart by anchor.
        group = np.unique(anchors, return_inverse=True)[1][windows.owner[windows.at]] if len(windows.at) else np.zeros(0, np.int64)
        order = np.lexsort((windows.place, group, windows.number))
        number, group = windows.number[order], group[order]
        heads = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (group[1:] != group[:-1]))) if len(order) else order
        for a, n in zip(heads.tolist(), np.diff(np.append(heads, len(order))).tolist(), strict=True):
            w = order[a]
            i, at = int(windows.owner[windows.at[w]]), int(windows.at[w])
            offset = at - int(words.starts[i])
            out.append((int(anchors[i]), b" ".join(texts[i].split()[offset : offset + window]), n, ids[i], int(first[i]) + offset))
        yield record_batch(out, schema)


def _locate(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per anchor and salt: confirmed phrases (salt's rows without a text_key) come first, then segments."""
    import ahocorasick

    schema = arrow_schema(SPAN)
    for table in _whole_groups(batches, ["anchor", "salt"]):
        words = _Words(table.column("words").to_pylist())
        place = (_ranks(table.column("doc_id").combine_chunks()) << PLACE_BITS) + table.column("first").to_numpy()
        known = table.column("phrase").to_numpy(zero_copy_only=False).astype(bool)
        automaton = ahocorasick.Automaton()
        for i in np.flatnonzero(known).tolist():
            automaton.add_word(words.part(int(words.starts[i]), window), (window, int(place[i])))
        if len(automaton):
            automaton.make_automaton()
            yield record_batch(_spans(table, words, automaton, words.digits, place, np.flatnonzero(~known)), schema)


def _most_segments(total: int) -> int:
    """Segments of an anchor that one task may have; of more, fewer than MOST_HOT anchors can be."""
    return max(256, min(total // 4096, 100_000), total // MOST_HOT)


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))


def repeated_spans(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_key, from_word, to_word) of words that repeat an earlier window; spans may overlap."""
    spark, docs = df.sparkSession, _documents(df, id_col, text_col)
    counts = scratch.cut(anchor_counts(docs, window, anchor), "anchors")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    most = _most_segments(total)
    # At most total / most rows, and so never more than MOST_HOT.
    parts = {r["anchor"]: -(-r["n"] // most) for r in counts.where(F.col("n") > most).collect()}
    bitmap, hot = spark.sparkContext.broadcast(_bitmap(counts)), spark.sparkContext.broadcast(parts)
    scratch.drop("anchors")
    plain = segments(docs, bitmap, hot, window, anchor, False).repartition("anchor").sortWithinPartitions("anchor")
    spans = plain.mapInArrow(lambda b: _confirm_and_locate(b, window), SPAN)
    if parts:
        found = scratch.cut(segments(docs, bitmap, hot, window, anchor, True).repartition("anchor", "salt"), "hot")
        local = found.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(lambda b: _distinct_windows(b, window), PHRASE)
        phrases = local.groupBy("anchor", "words").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "first")).alias("at")).where("n > 1")
        phrases = scratch.cut(phrases.select("anchor", "words", "at.doc_id", "at.first"), "phrases")
        salts = spark.createDataFrame(list(parts.items()), "anchor long, parts long")
        every = phrases.join(F.broadcast(salts), "anchor").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
        every = every.select("anchor", "salt", F.lit(True).alias("phrase"), "doc_id", F.lit(0).cast("long").alias("text_key"), "first", "words")
        both = every.unionByName(found.withColumn("phrase", F.lit(False)))
        dealt = both.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.col("phrase").desc())
        spans = spans.unionByName(dealt.mapInArrow(lambda b: _locate(b, window), SPAN))
    out = scratch.cut(spans, "spans")
    if parts:
        scratch.drop("hot", "phrases")
    bitmap.destroy()
    hot.destroy()
    return out


KEPT = "doc_id long, text string, n_words long, n_removed long"


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Each row's doc_id, the text of its kept words (joined by one space), n_words and n_removed."""
    scratch = Scratch(df.sparkSession)
    spans = repeated_spans(df, scratch, id_col, text_col, window, anchor)
    # A document's spans are no more than its words.
    spans = spans.groupBy(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).agg(F.collect_list(F.struct("from_word", "to_word")).alias("spans"))
    docs = _documents(df, id_col, text_col)
    met = docs.join(spans, docs["doc_id"].eqNullSafe(spans["id_"]) & (docs["text_key"] == spans["key_"]), "left")
    met = met.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("spans.from_word").alias("from_word"), F.col("spans.to_word").alias("to_word"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(KEPT)
        for batch in batches:
            ids, texts, starts, ends = (c.to_pylist() for c in batch.columns)
            rows = []
            for i, text, a, b in zip(ids, texts, starts, ends, strict=True):
                words = (text or b"").split()
                stay = np.ones(len(words), bool)
                for x, y in zip(a or (), b or (), strict=True):
                    stay[x:y] = False
                kept = [words[j] for j in np.flatnonzero(stay).tolist()] if a else words
                rows.append((i, b" ".join(kept).decode(), len(words), len(words) - len(kept)))
            yield record_batch(rows, schema)

    return met.mapInArrow(keep, KEPT)
