"""Quality classifier by co-training: a text view and a metadata view teach each other.

* The *text view* sees the text's content: byte trigrams hashed into 2^11 columns (square
  roots of shares), and how far words repeat.
* The *metadata view* sees source, language, length and layout: lines and their lengths, and
  the shares of capitals, digits, signs and spaces.

Both start from labelled rows. In each round each view scores a pool of unlabelled rows
and hands those it is surest of, in the proportion of the classes, to the *other* view's
training set. Then each view is calibrated on held-out labelled rows (Platt scaling), the
calibrated log-odds are weighted and calibrated together, and every document is scored
in one map without a shuffle.

Fitting uses bounded samples: ``LABELLED`` labelled and ``POOL`` unlabelled documents with the
least hashes of their ids, whatever the corpus; scoring covers all rows, whole texts. Rows are
turned into views where they lie; only views, of bounded size, meet on the driver, a part of their table at a time.

Defined cases: null or empty texts have a zero text view and are scored like any other;
null source, language or id are values of their own; labels that are null are left out,
of repeated labels of an id the majority counts (ties are good); of rows that share an id one,
that with the least text digest, is fitted on; unless each class has a labelled document to fit on
and another to hold out there is no model: scores are null and every row is kept; an empty table gives an empty result;
other columns pass through ``accepted`` untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, record_batch
from .textkernel import text_groups, words_of

GRAM_BITS, HASHED = 11, 32
TEXT_DIMS = (1 << GRAM_BITS) + 3
SIZE_BINS = 24
META_DIMS = 2 * HASHED + SIZE_BINS + 9
LABELLED, POOL, HELD_OUT = 4000, 3000, 0.25
ROUNDS, PER_ROUND, SURE = 5, 100, 0.9
#: A row goes only where the odds against it are nearly two to one; clean rows near the border stay.
THRESHOLD = 0.35
GROUP_BYTES = 1 << 18

_UPPER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,"]] = True


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array over each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def views(raw: np.ndarray, offsets: np.ndarray, sources: list, langs: list) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of each text, as float32 rows."""
    n, size = len(offsets) - 1, np.diff(offsets)
    some = np.maximum(size, 1)
    text = np.zeros((n, TEXT_DIMS), np.float32)
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        gram = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS)
        doc = np.repeat(np.arange(n), size)
        whole = doc[:-2] == doc[2:]
        flat = np.bincount((doc[:-2] << GRAM_BITS | gram)[whole], minlength=n << GRAM_BITS)
        text[:, : 1 << GRAM_BITS] = np.sqrt(flat.reshape(n, -1) / np.maximum(size - 2, 1)[:, None])
    hashes, word_doc, _ = words_of(raw, offsets)
    words = np.maximum(np.bincount(word_doc, minlength=n), 1) if len(hashes) else np.ones(n, np.int64)
    if len(hashes):
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
        order = np.lexsort((hashes, word_doc))
        first = np.ones(len(order), bool)
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
        text[:, -3] = np.bincount(word_doc[again], minlength=n) / words
        text[:, -2] = np.bincount(word_doc[order][first], minlength=n) / np.sqrt(words) / 10
        text[:, -1] = np.log1p(size / words)
    meta = np.zeros((n, META_DIMS), np.float32)
    for row, (source, lang) in enumerate(zip(sources, langs, strict=True)):
        meta[row, zlib.crc32(repr(source).encode()) % HASHED] = 1
        meta[row, HASHED + zlib.crc32(repr(lang).encode()) % HASHED] = 1
    meta[np.arange(n), 2 * HASHED + np.minimum(np.log2(some).astype(np.int64), SIZE_BINS - 1)] = 1
    lines = _per_text(raw == 0x0A, offsets) + 1
    share = lambda mask: _per_text(mask[raw], offsets) / some
    numbers = [
        np.log1p(size), np.log1p(lines), np.log1p(size / lines), np.log1p(words / lines), np.log1p(size / words),
        np.sqrt(share(_UPPER)), np.sqrt(share(_DIGIT)), np.sqrt(share(_SIGN)), np.log1p(words),
    ]
    meta[:, 2 * HASHED + SIZE_BINS :] = np.stack(numbers, 1)
    return text, meta


class Logistic:
    """Logistic regression with an L2 penalty, by accelerated gradient steps; classes weigh the same."""

    def __init__(self, penalty: float):
        self.penalty, self.w = penalty, None

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 150) -> Logistic:
        n = max(1, len(x))
        self.mean = x.mean(0)
        # Rows are standardised within the products, so that the driver holds no second copy of them.
        square = sum((np.square(x[a : a + 256] - self.mean).sum(0, dtype=np.float64) for a in range(0, len(x), 256)), np.zeros(x.shape[1]))
        self.scale = (np.sqrt(square / n) + 1e-3).astype(np.float32)
        weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)

        def forward(w: np.ndarray) -> np.ndarray:
            v = w[:-1] / self.scale
            return x @ v + (w[-1] - self.mean @ v)

        def backward(r: np.ndarray) -> np.ndarray:
            total = r.sum()
            return np.append((r @ x - self.mean * total) / self.scale, total).astype(np.float32)

        w = np.zeros(x.shape[1] + 1, np.float32)
        ahead, rate = w.copy(), 2.0 / (_top_eigen(lambda v: backward(weight * forward(v)), len(w)) + 4 * self.penalty)
        for i in range(steps):
            p = _sigmoid(forward(ahead))
            grad = backward(((p - y) * weight).astype(np.float32)) + self.penalty * np.append(ahead[:-1], 0).astype(np.float32)
            new = ahead - rate * grad
            ahead = (new + i / (i + 3) * (new - w)).astype(np.float32)
            w = new
        self.w = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        w = self.w[:-1] / self.scale
        return x @ w + (self.w[-1] - self.mean @ w)


def _top_eigen(times, width: int) -> float:
    """No less than the greatest eigenvalue of a product, by power steps."""
    v = np.random.default_rng(0).standard_normal(width, dtype=np.float32)
    for _ in range(30):
        v = times(v)
        v /= max(float(np.linalg.norm(v)), 1e-20)
    return float(v @ times(v)) * 1.1 + 1e-6


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights w so that sigmoid(scores . w[:-1] + w[-1]) fits the labels, softened as Platt does; Newton steps."""
    up, down = int(y.sum()), int((~y).sum())
    target = np.where(y, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([score, np.ones(len(y))])
    start = np.append(np.full(x.shape[1] - 1, 1 / (x.shape[1] - 1)), 0.0)
    w = start.copy()
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-2 * (w - start))
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return w


#: One view's log-odds count for no more than this, so that neither outvotes the other alone.
MOST_ODDS = 5.0


class Model:
    """Both views, their calibrations and the last one; picklable, of a fixed size."""

    def __init__(self, text: Logistic, meta: Logistic, held: tuple, y: np.ndarray):
        self.text, self.meta = text, meta
        self.text_fit, self.meta_fit = platt(text.score(held[0]), y), platt(meta.score(held[1]), y)
        self.both_fit = platt(self._odds(*held), y)

    def _odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        pairs = ((self.text.score(text), self.text_fit), (self.meta.score(meta), self.meta_fit))
        return np.column_stack([np.clip(fit[0] * s + fit[1], -MOST_ODDS, MOST_ODDS) for s, fit in pairs])

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of being good: by text, by metadata, and by both."""
        odds = self._odds(text, meta)
        return _sigmoid(odds[:, 0]), _sigmoid(odds[:, 1]), _sigmoid(odds @ self.both_fit[:-1] + self.both_fit[-1])


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> Model | None:
    """A model from labelled documents (y: good) in a set order and pool ones; None unless both classes are fitted and held out."""
    held = np.zeros(len(y), bool)
    for label in (True, False):  # by class, so that a rare one is on both sides
        held[np.flatnonzero(y == label)[:: round(1 / HELD_OUT)]] = True
    if any(len(np.unique(part)) < 2 for part in (y[held], y[~held])):
        return None
    views, pools, open_ = (text, meta), (pool_text, pool_meta), np.ones(len(pool_text), bool)
    # Of each view's training set: the pool rows added, and the labels they were given.
    added: list[list[np.ndarray]] = [[], []]
    given: list[list[np.ndarray]] = [[], []]
    good = y[~held].mean()
    for _ in range(ROUNDS + 1):
        fitted = []
        for view, penalty in ((0, 3e-3), (1, 1e-3)):
            more = np.concatenate([np.zeros(0, np.int64), *added[view]])
            x = np.concatenate([views[view][~held], pools[view][more]])
            fitted.append(Logistic(penalty).fit(x, np.concatenate([y[~held], *given[view]])))
            del x
        if not open_.any() or (~held).sum() + sum(map(len, added[0])) > len(y) + ROUNDS * 2 * PER_ROUND:
            break
        for mine, other in ((0, 1), (1, 0)):
            p = _sigmoid(fitted[mine].score(pools[mine]))
            for label, sure, most in ((True, p, round(PER_ROUND * good)), (False, 1 - p, round(PER_ROUND * (1 - good)))):
                best = np.flatnonzero(open_ & (sure >= SURE))
                best = best[np.argsort(-sure[best], kind="stable")][: max(1, most)]
                open_[best] = False
                added[other].append(best)
                given[other].append(np.full(len(best), label))
    return Model(*fitted, (text[held], meta[held]), y[held])


SAMPLE = "doc_id long, label long, order_ long, tie_ string, text_view binary, meta_view binary"


def _featured(rows: DataFrame) -> DataFrame:
    """The rows' keys and both views: the text view as packed (column, value) pairs."""

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, raw, offsets in text_groups(batch.column(0), GROUP_BYTES):
                text, meta = views(raw, offsets, batch.column(1)[at].to_pylist(), batch.column(2)[at].to_pylist())
                keys = zip(*[c[at].to_pylist() for c in batch.columns[3:]], strict=True)
                for key, t, m in zip(keys, text, meta, strict=True):
                    cols = np.flatnonzero(t)
                    out.append((*key, cols.astype(np.int16).tobytes() + t[cols].tobytes(), m.tobytes()))
            yield record_batch(out, arrow_schema(SAMPLE))

    return rows.select("text", "source", "lang", "doc_id", "label", "order_", "tie_").mapInArrow(feature, SAMPLE)


def _unpacked(rows: DataFrame, place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of all rows, each at its id's place."""
    text, meta = np.zeros((len(place), TEXT_DIMS), np.float32), np.zeros((len(place), META_DIMS), np.float32)
    # A partition at a time, so that neither the JVM nor Python holds the packed rows of all.
    for doc_id, packed, numbers in rows.select("doc_id", "text_view", "meta_view").toLocalIterator():
        i, n = place[doc_id], len(packed) // 6
        text[i, np.frombuffer(packed, np.int16, n)] = np.frombuffer(packed, np.float32, n, 2 * n) if n else 0
        meta[i] = np.frombuffer(numbers, np.float32)
    return text, meta


def _columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), given("source"), given("lang"))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality") -> Model | None:
    """Co-train on the bounded samples; labels: (doc_id, target 0/1)."""
    docs = _columns(df, id_col, text_col)
    order = F.xxhash64("doc_id")
    votes = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    votes = votes.agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("long").alias("label"))
    picked = votes.withColumn("order_", order).orderBy("order_", "doc_id").limit(LABELLED)
    # The pool: the first ids by the same order after those that have a label.
    free = docs.select("doc_id").where("doc_id is not null").join(votes.select("doc_id"), "doc_id", "left_anti")
    free = free.withColumn("order_", order).orderBy("order_", "doc_id").limit(POOL).distinct()
    # Both are bounded by their limits; a row's text is met by a broadcast of ids.
    wanted = picked.select("doc_id", "label", "order_").unionByName(free.select("doc_id", F.lit(None).cast("long").alias("label"), "order_"))
    met = docs.join(F.broadcast(wanted), "doc_id").withColumn("tie_", F.md5(F.coalesce("text", F.lit(""))))
    # One row an id, chosen per task before the shuffle: what comes to the driver has the samples' bound.
    one = _featured(met).groupBy("doc_id").agg(F.min(F.struct("tie_", "label", "order_", "text_view", "meta_view")).alias("row")).select("doc_id", "row.*")
    scratch = Scratch(df.sparkSession)
    rows = scratch.cut(one, "sample")
    keys = sorted(rows.select("doc_id", "label", "order_").collect(), key=lambda r: (r["label"] is None, r["order_"], r["doc_id"]))
    known = sum(r["label"] is not None for r in keys)
    model = None
    if known:
        text, meta = _unpacked(rows, {r["doc_id"]: i for i, r in enumerate(keys)})
        good = np.array([r["label"] == 1 for r in keys[:known]])
        model = cotrain(text[:known], meta[:known], good, text[known:], meta[known:])
    scratch.drop("sample")
    return model


SCORES = "doc_id long, p_text double, p_meta double, p_quality double, keep boolean"


def _scored(model: Model | None, text: pa.Array, sources: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [[np.zeros(0)] * 3]
    for at, raw, offsets in text_groups(text, GROUP_BYTES):
        parts.append(model.probabilities(*views(raw, offsets, sources[at].to_pylist(), langs[at].to_pylist())))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def score_documents(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: the probability of being good by each view and both, and whether to keep it."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, m = arrow_schema(SCORES), shared.value
        for batch in batches:
            ids = batch.column(0)
            if m is None:
                none = [None] * len(ids)
                columns = [ids, none, none, none, [True] * len(ids)]
            else:
                p = [np.round(x, 6) for x in _scored(m, *batch.columns[1:4])]
                columns = [ids, *p, p[2] >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _columns(df, id_col, text_col).mapInArrow(score, SCORES)


def accepted(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that the model keeps, with all their columns."""
    if model is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, b=batch: b.column(names.index(c)).cast(pa.string()) if c in names else pa.nulls(b.num_rows, pa.string())
            p = _scored(shared.value, column(text_col), column("source"), column("lang"))[2]
            yield batch.filter(pa.array(np.round(p, 6) >= threshold))

    return df.mapInArrow(keep, df.schema)
