"""Token counts kept as additive rollups that change by signed, idempotent batches.

A batch of changes (insert, delete, revise) becomes one signed delta per source,
language and tokenizer version: +1/-1/0 documents, plus new minus old tokens and bytes.
Totals are the sum of committed deltas, so order does not matter and nothing is
recounted. A batch takes effect when its marker file is created, which only one attempt
can do; a batch id that has a marker is skipped, so retries and replays change nothing.
``compact`` folds committed deltas into a snapshot.

Deltas are summed per task before the shuffle, so a hot source costs one row per task.

Defined cases: a null source or language is a group of its own (null); a null or empty
text counts 0 tokens; a change with null counts adds 0 for them; unknown operations
raise; repeated rows count each time; an empty batch commits and adds nothing; a group
whose totals are all zero is left out; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, drop_path, path_fs, record_batch

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary goes to executors with the task; larger files are refused.
MOST_VOCABULARY_BYTES = 16 << 20
#: Texts longer than this are cut before white space that follows a letter, where no token spans.
PIECE_CHARS = 1 << 16

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_bytes")
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"
CHANGE = "op string, source string, lang string, tokenizer_version string, n_tokens long, n_bytes long, old_tokens long, old_bytes long"
OPS = ("insert", "delete", "revise")


def load_vocabulary(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; {MOST_VOCABULARY_BYTES} at most go to executors")
    return data


_encoders: dict[int, object] = {}


def encoder_of(vocabulary: bytes, key: int | None = None):
    """The tokenizer, built once per Python process and key."""
    key = hash(vocabulary) if key is None else key
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def pieces_of(text: str) -> Iterator[str]:
    """The text in pieces whose token counts add up to the whole text's.

    A cut lies before a space that stands between a letter and a letter: a token never
    reaches over it, since such a space starts a token of its own. A text without one
    stays whole, and is counted all the same.
    """
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = at + PIECE_CHARS
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(df: DataFrame, tokenizer_path: str = TOKENIZER_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, n_bytes, n_words, n_tokens) of whole texts; n_words by white space."""
    # A broadcast is one copy per executor; in the task itself it would be one per task.
    vocabulary = df.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))
    key = int.from_bytes(hashlib.md5(vocabulary.value).digest()[:8], "big")
    ddl = "doc_id long, source string, lang string, n_bytes long, n_words long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, encode = arrow_schema(ddl), encoder_of(vocabulary.value, key).encode_ordinary
        for batch in batches:
            head = [c.to_pylist() for c in batch.columns[:3]]
            rows = []
            for doc_id, source, lang, text in zip(*head, batch.column(3), strict=True):
                text = text.as_py() or ""
                rows.append((doc_id, source, lang, len(text.encode()), len(text.split()), sum(len(encode(p)) for p in pieces_of(text))))
            yield record_batch(rows, schema)

    text = F.col(text_col).cast("string").alias("text")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), text).mapInArrow(count, ddl)


def signed_deltas(changes: DataFrame) -> DataFrame:
    """One row per group: what the batch adds to its totals."""
    op, zero = F.col("op"), F.lit(0).cast("long")
    new = lambda c: F.coalesce(F.col(c), zero)
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
    known = F.when(op.isin(*OPS), sign).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null")))).cast("int"))
    moved = lambda n, old: F.when(op == "delete", -new(n)).when(op == "revise", new(n) - new(old)).otherwise(new(n))
    rows = changes.select(*KEYS, known.cast("long").alias("n_docs"), moved("n_tokens", "old_tokens").alias("n_tokens"), moved("n_bytes", "old_bytes").alias("n_bytes"))
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class RollupStore:
    """Committed deltas in a shared folder: data/<attempt>, commits/<batch>, snapshots/<n>."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once. False if it had been applied before."""
        if batch_id in self._snapshot()["batches"] or self._attempt(batch_id):
            return False
        attempt = uuid.uuid4().hex
        signed_deltas(changes).write.parquet(f"{self.path}/data/{attempt}")
        marker = f"{self.path}/commits/{quote(batch_id, safe='')}"
        if self._read(marker) == "":  # a writer died between creating and filling it
            drop_path(self.spark, marker)
        if not self._create(marker, attempt):
            drop_path(self.spark, f"{self.path}/data/{attempt}")
            return False
        return True

    def totals(self) -> DataFrame:
        """Current totals per group; groups that are all zero are left out."""
        snapshot = self._snapshot()
        return self._summed(snapshot, [b for b in self._committed() if b not in snapshot["batches"]])

    def _summed(self, snapshot: dict, batches: list[str]) -> DataFrame:
        """The sum of a snapshot and of exactly these batches besides."""
        names = [snapshot["data"], *map(self._attempt, batches)]
        paths = [f"{self.path}/data/{name}" for name in names if name]
        empty = self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else empty
        summed = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return summed.where(" or ".join(f"{c} != 0" for c in SUMS))

    def compact(self) -> bool:
        """Fold the batches committed so far into a snapshot; their ids stay known.

        The snapshot sums the very ids it lists: what is committed meanwhile stays outside. It
        follows the one it read, so of two compactions at once one gives up, and False comes back.
        """
        before = self._snapshot()
        fresh = sorted(b for b in self._committed() if b not in before["batches"])
        attempt = uuid.uuid4().hex
        self._summed(before, fresh).write.parquet(f"{self.path}/data/{attempt}")
        text = json.dumps({"data": attempt, "batches": sorted([*before["batches"], *fresh])})
        if not self._create(f"{self.path}/snapshots/{before['number'] + 1}", text):
            drop_path(self.spark, f"{self.path}/data/{attempt}")
            return False
        return True

    def _committed(self) -> list[str]:
        from urllib.parse import unquote

        return [b for b in map(unquote, self._names("commits")) if self._attempt(b)]

    def _attempt(self, batch_id: str) -> str | None:
        return self._read(f"{self.path}/commits/{quote(batch_id, safe='')}") or None

    def _snapshot(self) -> dict:
        """The last whole snapshot: its number, data and batches; number is that of the last file, whole or not."""
        numbers = sorted(map(int, self._names("snapshots")), reverse=True)
        found = (self._read(f"{self.path}/snapshots/{n}") for n in numbers)
        last = next((json.loads(x) for x in found if x), {"data": None, "batches": []})
        return last | {"number": max(numbers, default=-1)}

    def _names(self, folder: str) -> list[str]:
        fs, at = path_fs(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _create(self, path: str, text: str) -> bool:
        fs, at = path_fs(self.spark, path)
        if fs.exists(at):
            return False
        try:
            out = fs.create(at, False)  # fails where the file exists
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def _read(self, path: str) -> str | None:
        fs, at = path_fs(self.spark, path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def as_changes(op: str, counted: DataFrame, version: str, n_tokens: str, old_tokens: str | None = None) -> DataFrame:
    """Counted documents as changes of one kind; a revision keeps its bytes."""
    none = F.lit(None).cast("long")
    old = F.expr(old_tokens).cast("long") if old_tokens else none
    return counted.select(
        F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"),
        F.expr(n_tokens).cast("long").alias("n_tokens"), "n_bytes", old.alias("old_tokens"),
        (F.col("n_bytes") if old_tokens else none).alias("old_bytes"),
    )
