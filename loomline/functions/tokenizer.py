"""Exact token counts and cuts by a public byte-pair vocabulary; its path is a parameter.

``text.token_count`` is the estimate without a tokenizer; these are the exact branch.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Larger vocabularies are not sent to executors.
MOST_BYTES = 16 << 20

_built: dict[int, object] = {}


class Tokenizer:
    """A vocabulary that executors get once each, and columns that use it."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY):
        data = Path(path).read_bytes()
        if len(data) > MOST_BYTES:
            raise ValueError(f"{path} has {len(data)} bytes; {MOST_BYTES} at most go to executors")
        self.shared = spark.sparkContext.broadcast(data)

    def count(self, text: Column) -> Column:
        """Tokens of each whole text; null for null."""
        shared = self.shared

        @F.pandas_udf("long")
        def count(values: pd.Series) -> pd.Series:
            encode = encoder(shared.value).encode_ordinary
            return values.map(lambda v: None if v is None else len(encode(v))).astype("Int64")

        return count(text)

    def truncate(self, text: Column, most: int) -> Column:
        """Texts of more tokens cut after ``most`` of them, with an ellipsis; others as they are."""
        shared = self.shared

        @F.pandas_udf("string")
        def cut(values: pd.Series) -> pd.Series:
            own = encoder(shared.value)

            def one(v):
                tokens = None if v is None else own.encode_ordinary(v)
                return v if tokens is None or len(tokens) <= most else own.decode(tokens[:most]) + "..."

            return values.map(one)

        return cut(text)


def encoder(data: bytes):
    """The tokenizer, built once per Python process and vocabulary."""
    key = hash(data)
    if key not in _built:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        _built[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _built[key]
