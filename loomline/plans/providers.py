"""Model providers behind one interface; the defaults are deterministic and local.

A provider is a picklable object with ``generate``, ``validate``, ``embed``, ``rerank``,
``act``, ``chat`` and ``embed_many``. ``call`` runs one of its methods in an Arrow map, with retries, a rate limit
that its tasks share, and errors kept in the row; ``cached`` asks only for what a stored table lacks;
``embedded`` sends texts in batches bounded by number and tokens.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import for_embedding, structured, token_count
from ..operators.chunk import token_slices

# Personas and their temperatures.
PERSONAS = {
    "technical_expert": 0.6,
    "beginner": 0.9,
    "typo_prone": 0.95,
    "vague": 0.85,
    "precise": 0.5,
    "casual_manager": 0.8,
    "international_esl": 0.85,
}
DIMS = 64


@dataclass
class TokenBucket:
    """Requests and tokens per minute, kept to a share of the limit in windows of 15 s; one per task."""

    requests: float
    tokens: float
    share: float = 0.95
    window: float = 15.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    began: float = field(default=-math.inf)
    used: list = field(default_factory=lambda: [0.0, 0.0])

    def take(self, tokens: float) -> None:
        most = [x * self.share * self.window / 60 for x in (self.requests, self.tokens)]
        now = self.clock()
        if now - self.began >= self.window:
            self.began, self.used = now, [0.0, 0.0]
        full = self.used[0] + 1 > most[0] or self.used[1] + tokens > most[1]
        if full and self.used != [0.0, 0.0]:  # a request over the limit goes alone
            self.sleep(self.window - (now - self.began))
            self.began, self.used = self.clock(), [0.0, 0.0]
        self.used[0] += 1
        self.used[1] += tokens


def with_retries(call: Callable, tries: int = 10, sleep: Callable[[float], None] = time.sleep):
    """The call's value; after a failure wait min(2^i, 5) s; the last failure is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i + 1 == tries:
                raise
            sleep(min(2.0**i, 5.0))


class LocalProvider:
    """Answers from hashes and words alone, equal on every machine."""

    def generate(self, row: dict) -> str:
        words = [w for w in row["content"].split() if len(w) > 3] or ["nothing"]
        at = int(hashlib.md5(f"{row['chunk_id']}:{row['persona']}:{row['n']}".encode()).hexdigest()[:8], 16)
        return " ".join(words[(at + 7 * i) % len(words)] for i in range(4))

    def validate(self, row: dict) -> str:
        asked, there = set(row["query"].lower().split()), set(row["content"].lower().split())
        ok = bool(asked) and len(asked & there) * 2 >= len(asked)
        return json.dumps({"valid": ok, "reason": f"{len(asked & there)} of {len(asked)} words"})

    def embed(self, row: dict) -> str:
        return json.dumps(hashed_vector(row["text"]))

    def embed_many(self, texts: list[str]) -> list[str]:
        """Base64 of float32, as providers reply."""
        return [base64.b64encode(np.array(hashed_vector(t), "<f4").tobytes()).decode() for t in texts]

    def chat(self, row: dict) -> str:
        """The first words of the last message, as a fenced object."""
        return "```json\n" + json.dumps({"reply": row["messages"][-1]["content"][:20], "turns": len(row["messages"])}) + "\n```"

    def rerank(self, row: dict) -> str:
        a, b = hashed_vector(row["query"]), hashed_vector(row["text"])
        return json.dumps(round(sum(x * y for x, y in zip(a, b, strict=True)), 9))

    def act(self, row: dict) -> str:
        words = sorted(set(row["query"].lower().split()), key=lambda w: (-len(w), w))
        step = int(row["step"])
        return json.dumps({"search_calls": words[2 * step : 2 * step + 2], "reasoning": f"step {step}"})


def hashed_vector(text: str, dims: int = DIMS) -> list[float]:
    """Signed counts of hashed words, of unit length; zero for a text without words."""
    v = [0.0] * dims
    for w in text.lower().split():
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        v[h % dims] += 1.0 if h >> 32 & 1 else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


#: Tasks that share a rate limit.
LIMITED_TASKS = 8


def call(
    rows: DataFrame, provider, method: str, columns: list[str], limits: tuple[float, float] | None = None, tries: int = 10, tasks: int = LIMITED_TASKS
) -> DataFrame:
    """rows with ``value`` and ``error`` strings: one of them null.

    limits: requests and tokens a minute of the whole call. Rows are dealt to so many tasks, each
    of which keeps to its share.
    """
    names = rows.columns
    if limits:
        rows, limits = rows.repartition(tasks), (limits[0] / tasks, limits[1] / tasks)
    schema = rows.select(*names, F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("error")).schema

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(*limits) if limits else None
        for pdf in batches:
            values, errors = [], []
            for row in pdf[columns].to_dict("records"):
                try:
                    if bucket:
                        bucket.take(sum(len(str(v)) // 4 for v in row.values()))
                    values.append(with_retries(lambda row=row: getattr(provider, method)(row), tries))
                    errors.append(None)
                except Exception as e:
                    values.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pdf.assign(value=values, error=errors)

    return rows.mapInPandas(ask, schema)


def chat(rows: DataFrame, provider, messages: str, reply: str | None = None, tries: int = 10) -> DataFrame:
    """rows with value, error, prompt_tokens and completion_tokens of a chat call each.

    messages: an array of (role, content). With reply, the fields asked for, value is that struct, and a
    reply that does not fit them is an error; else value is the text. Tokens are estimated.
    """
    done = call(rows, provider, "chat", [messages], tries=tries)
    asked = F.aggregate(F.transform(messages, lambda m: token_count(m["content"])), F.lit(0).cast("bigint"), lambda s, n: s + n)
    done = done.withColumn("prompt_tokens", asked).withColumn("completion_tokens", F.coalesce(token_count(F.col("value")), F.lit(0).cast("bigint")))
    if reply is None:
        return done
    done = done.withColumn("got_", structured(F.col("value"), reply))
    error = F.coalesce("error", F.when(F.col("got_").isNull(), F.lit("the reply does not fit its schema")))
    return done.withColumn("error", error).withColumn("value", F.col("got_")).drop("got_")


def embedded(rows: DataFrame, provider, text: str, most_rows: int = 128, most_tokens: int = 50_000, tries: int = 10) -> DataFrame:
    """rows with ``vector`` and ``error``: texts go in batches bounded by number and by estimated tokens, in order.

    A failed batch's rows have its error, as have those of a reply with more or fewer vectors than texts. Blank texts go as one space.
    """
    schema = rows.select("*", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("error")).schema
    sent = rows.withColumn("sent_", F.coalesce(for_embedding(F.col(text)), F.lit(" ")))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("sent_").tolist()
            vectors, errors = [], []
            for a, b in token_slices([len(t) // 4 for t in texts], most_rows, most_tokens):
                try:
                    got = [np.frombuffer(base64.b64decode(v), "<f4") for v in with_retries(lambda a=a, b=b: provider.embed_many(texts[a:b]), tries)]
                    if len(got) != b - a:
                        raise ValueError(f"{len(got)} vectors for {b - a} texts")
                    vectors += got
                    errors += [None] * (b - a)
                except Exception as e:
                    vectors += [None] * (b - a)
                    errors += [str(e) or type(e).__name__] * (b - a)
            yield pdf.assign(vector=vectors, error=errors)

    return sent.mapInPandas(ask, schema)


def cached(rows: DataFrame, store: DataFrame, provider, method: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with value, new store rows): each distinct request that the store (key, value) lacks is asked once."""
    keyed = rows.withColumn("key", F.md5(F.concat_ws("\x1f", F.lit(method), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])))
    fresh = keyed.join(store.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", *columns)
    new = call(fresh, provider, method, columns).where("error is null").select("key", "value")
    return keyed.join(store.select("key", "value").union(new), "key", "left").drop("key"), new
