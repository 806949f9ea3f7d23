"""Chunks of a channel: by message, by thread, and by token budget.

Input rows are parents: channel_id, channel_name, pos, message_id, user, timestamp,
text, and ``thread`` (an array of replies) where the operator reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_count, truncate_to_tokens

BUDGET = 4096


def individual(messages: DataFrame) -> DataFrame:
    """One chunk per parent and per reply, with who wrote it, when, and its place in the thread."""
    head = ["channel_id", "channel_name", "pos"]
    parents = messages.select(
        *head, F.lit(-1).alias("reply_pos"), F.concat_ws("_", "channel_id", "message_id", F.lit("msg")).alias("chunk_id"), F.col("text").alias("content"),
        F.size("thread").cast("bigint").alias("reply_count"), F.lit(None).cast("string").alias("parent_message_id"),
        "message_id", "user", "timestamp", (F.size("thread") > 0).alias("is_thread_parent"), F.lit(False).alias("is_thread_reply"),
    )
    replies = messages.select(*head, F.col("message_id").alias("parent"), F.posexplode("thread").alias("reply_pos", "r"))
    replies = replies.select(
        *head, "reply_pos", F.concat_ws("_", "channel_id", "r.message_id", F.lit("reply")).alias("chunk_id"), F.col("r.text").alias("content"),
        F.lit(0).cast("bigint").alias("reply_count"), F.col("parent").alias("parent_message_id"),
        "r.message_id", "r.user", "r.timestamp", F.lit(False).alias("is_thread_parent"), F.lit(True).alias("is_thread_reply"),
    )
    return parents.union(replies).withColumn("chunk_type", F.lit("individual_message")).withColumn("token_count", token_count(F.col("content")))


def threads(messages: DataFrame) -> DataFrame:
    """A parent with replies as one text, with the ids of both; a parent without as a standalone chunk, with its user and time."""
    has = F.size("thread") > 0
    original = F.concat(F.lit("[Original Message by "), "user", F.lit("]\n"), "text", F.lit("\n\n"))
    replies = F.array_join(F.transform("thread", lambda r: F.concat(F.lit("[Reply by "), r["user"], F.lit("]\n"), r["text"])), "\n\n")
    content = F.when(has, F.concat(original, replies)).otherwise(F.col("text"))
    people = F.array_sort(F.array_distinct(F.concat(F.array("user"), F.transform("thread", lambda r: r["user"]))))
    return messages.select(
        "channel_id", "channel_name", "pos",
        F.concat_ws("_", "channel_id", "message_id", F.when(has, F.lit("thread")).otherwise(F.lit("standalone"))).alias("chunk_id"),
        F.lit("thread").alias("chunk_type"), content.alias("content"), token_count(content).alias("token_count"),
        F.size("thread").cast("bigint").alias("reply_count"), F.array_join(people, ",").alias("participants"),
        F.when(has, F.col("message_id")).alias("parent_message_id"), F.when(has, F.array_join("thread.message_id", ",")).alias("reply_message_ids"),
        (~has).alias("is_standalone"), *[F.when(~has, F.col(c)).alias(c) for c in ("message_id", "user", "timestamp")],
    )


def window_numbers(messages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """messages with ``window`` and ``truncated``: greedy packing in order.

    A window closes when the next message would exceed the budget; a message over the
    budget closes the open window and stands alone. Packing is sequential within a
    channel: rows are dealt by channel and sorted, and each task reads them as a stream
    with a state of three numbers, so a channel's length costs no memory.
    """
    schema = T.StructType([*messages.schema.fields, T.StructField("window", T.LongType()), T.StructField("truncated", T.BooleanType())])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, w, used, is_open = object(), 0, 0, False
        for pdf in batches:
            windows, cut = [], []
            for c, tokens in zip(pdf["channel_id"], pdf.pop("tokens_"), strict=True):
                if c != channel:
                    channel, w, used, is_open = c, 0, 0, False
                if tokens > budget:
                    w += is_open
                    windows.append(w)
                    w, used, is_open = w + 1, 0, False
                else:
                    if is_open and used + tokens > budget:
                        w, used = w + 1, 0
                    used, is_open = used + tokens, True
                    windows.append(w)
                cut.append(tokens > budget)
            yield pdf.assign(window=windows, truncated=cut)

    dealt = messages.withColumn("tokens_", token_count(F.col("text"))).repartition("channel_id").sortWithinPartitions("channel_id", "pos")
    return dealt.mapInPandas(pack, schema)


def folded_window_numbers(messages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(channel_id, pos, window, truncated) by a fold over each channel's array, without Python.

    The state holds the last window's number, tokens and openness; a second fold result per
    message comes from running it over prefixes' ends, kept as an array of numbers. For
    channels that fit a row.
    """
    tokens = token_count(F.col("text"))
    lists = messages.groupBy("channel_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), tokens.alias("tok")))).alias("items"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("w"), zero.alias("used"), F.lit(False).alias("open"), F.array().cast("array<bigint>").alias("out"))

    def step(s, x):
        over = x["tok"] > budget
        turn = ~over & s["open"] & (s["used"] + x["tok"] > budget)
        w = F.when(over, s["w"] + s["open"].cast("bigint")).when(turn, s["w"] + 1).otherwise(s["w"])
        used = F.when(over, zero).when(turn, x["tok"]).otherwise(s["used"] + x["tok"])
        return F.struct(F.when(over, w + 1).otherwise(w).alias("w"), used.alias("used"), (~over).alias("open"), F.array_append(s["out"], w).alias("out"))

    windows = F.aggregate("items", start, step, lambda s: s["out"])
    rows = lists.select("channel_id", F.explode(F.arrays_zip(F.col("items.pos").alias("pos"), F.col("items.tok").alias("tok"), windows.alias("window"))).alias("r"))
    return rows.select("channel_id", "r.pos", "r.window", (F.col("r.tok") > budget).alias("truncated"))


def windows(messages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One chunk per window: rendered text, member ids, first and last timestamp, tokens of the rendering, and whether a member has a thread."""
    has = F.size("thread") > 0 if "thread" in messages.columns else F.lit(False)
    placed = window_numbers(messages.withColumn("has_thread_", F.coalesce(has, F.lit(False))).drop("thread"), budget)
    # A message over the budget stands alone, cut and without a header.
    whole = F.concat(F.lit("[Message by "), "user", F.lit(" at "), "timestamp", F.lit("]\n"), "text")
    line = F.when(F.col("truncated"), truncate_to_tokens(F.col("text"), budget)).otherwise(whole)
    rows = F.array_sort(F.collect_list(F.struct("pos", "message_id", "timestamp", line.alias("line"))))
    grouped = placed.groupBy("channel_id", "channel_name", "window").agg(rows.alias("rows"), F.bool_or("truncated").alias("truncated"), F.bool_or("has_thread_").alias("has_threaded_messages"))
    content = F.array_join("rows.line", "\n\n---\n\n")
    return grouped.select(
        "channel_id", "channel_name", "window", F.concat_ws("_", "channel_id", F.lit("window"), "window").alias("chunk_id"),
        content.alias("content"), token_count(content).alias("token_count"), F.size("rows").cast("bigint").alias("message_count"),
        F.array_join("rows.message_id", ",").alias("message_ids"), F.element_at("rows.timestamp", 1).alias("start_timestamp"), F.element_at("rows.timestamp", -1).alias("end_timestamp"), "truncated", "has_threaded_messages",
    )


#: Metadata by kind of chunk; what is null is left out.
METADATA = {
    "individual_message": ("message_id", "user", "timestamp", "is_thread_parent", "is_thread_reply", "reply_count", "parent_message_id"),
    "thread": ("parent_message_id", "reply_count", "reply_message_ids", "participants", "message_id", "user", "timestamp", "is_standalone"),
    "sliding_window": ("message_ids", "message_count", "start_timestamp", "end_timestamp", "has_threaded_messages"),
}


def _metadata(kind: str):
    entries = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in METADATA[kind]]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())).alias("metadata")


def chunk_channel(messages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """All three kinds in one table of (chunk_id, chunk_type, channel_id, channel_name, content, token_count, metadata)."""
    common = ["chunk_id", "chunk_type", "channel_id", "channel_name", "content", "token_count"]
    packed = windows(messages, budget).withColumn("chunk_type", F.lit("sliding_window"))
    parts = [df.select(*common, _metadata(kind)) for kind, df in (("individual_message", individual(messages)), ("thread", threads(messages)), ("sliding_window", packed))]
    return parts[0].union(parts[1]).union(parts[2])


def merged_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Runs of turns of one role joined by a line break: key, run, role, content, n_turns, first_turn.

    Runs are numbered by a running sum over role changes; a conversation is one window partition.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    change = (~F.col("role").eqNullSafe(F.lag("role").over(w)) | F.lag(order).over(w).isNull()).cast("int")
    runs = turns.withColumn("change_", change).withColumn("run", F.sum("change_").over(w))
    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    merged = runs.groupBy(key, "run", "role").agg(rows.alias("rows"))
    return merged.select(key, "run", "role", F.array_join("rows.text", "\n").alias("content"), F.size("rows").cast("bigint").alias("n_turns"), F.element_at(f"rows.{order}", 1).alias("first_turn"))


def provider_messages(turns: DataFrame, initial: str | None = None, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns as a chat provider takes them: key, run, role, content, system.

    A first turn of role system is pulled out into ``system``. Where the rest does not begin with
    a user's turn, ``initial`` is put before it as one. Then neighbours of one role are one.
    """
    firsts = turns.groupBy(key).agg(F.min_by(F.struct("role", "text"), order).alias("head"), F.min(order).alias("at"))
    system = F.when(F.col("head.role") == "system", F.col("head.text"))
    firsts = firsts.select(key, "at", system.alias("system"), (F.col("head.role") == "system").alias("pulled"))
    rest = turns.join(firsts, key).where(~(F.coalesce("pulled", F.lit(False)) & (F.col(order) == F.col("at")))).select(key, order, "role", "text")
    if initial is not None:
        begins = rest.groupBy(key).agg(F.min_by("role", order).alias("first"), F.min(order).alias("at")).where("first != 'user' or first is null")
        rest = rest.unionByName(begins.select(key, (F.col("at") - 1).alias(order), F.lit("user").alias("role"), F.lit(initial).alias("text")))
    return merged_turns(rest, key, order).join(firsts.select(key, "system"), key).select(key, "run", "role", "content", "system")


def head_per_type(chunks: DataFrame, most: int = 100, order: str = "chunk_id") -> DataFrame:
    """The first chunks of each type, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("chunk_type").orderBy(order)
    return chunks.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= most).drop("n_")


def batches(rows: DataFrame, call: str, order: str, tokens: str, most_rows: int, most_tokens: int) -> DataFrame:
    """rows with ``batch``, the order of the first row of each request to a provider.

    A call's rows, in order, are cut into slices of most_rows. A slice over most_tokens is cut
    into parts of half its rows, rounded down, and so on; a row alone goes as it is. A slice
    is bounded, so each is cut in one task of its own, without Python per call.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(call).orderBy(order)) - 1
    sliced = rows.withColumn("slice_", F.floor(place / most_rows))
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", rows.schema[order].dataType)])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).drop(columns="slice_")
        firsts = list(token_slices(pdf[tokens].tolist(), most_rows, most_tokens))
        starts = [a for a, b in firsts for _ in range(a, b)]
        return pdf.assign(batch=pdf[order].to_numpy()[starts])

    return sliced.groupBy(call, "slice_").applyInPandas(cut, schema)


def token_slices(tokens: list[int], most_rows: int, most_tokens: int, base: int = 0) -> Iterator[tuple[int, int]]:
    """(from, to) of each request for texts of so many tokens."""
    n = len(tokens)
    if n > most_rows or (n > 1 and sum(tokens) > most_tokens):
        size = most_rows if n > most_rows else n // 2
        for a in range(0, n, size):
            yield from token_slices(tokens[a : a + size], most_rows, most_tokens, base + a)
    elif n:
        yield base, base + n
