"""Raw messages to clean ones: null texts, thread heads, blanks, flattening, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

UNKNOWN_USER = "unknown"


def cleaned(raw: DataFrame) -> DataFrame:
    """One row per channel with messages[] to one row per message: pos, message_id, timestamp, text, thread[].

    A null text drops the message with its thread; the thread's first entry (the parent
    again) goes always; null replies go; order stays in ``msg_pos`` and the array.
    """
    rows = raw.select("channel_id", F.posexplode("messages").alias("msg_pos", "m")).where("m.text is not null")
    rest = F.slice("m.thread_replies", F.lit(2), F.greatest(F.size("m.thread_replies") - 1, F.lit(0)))
    kept = F.filter(F.coalesce(rest, F.array().cast("array<struct<ts:string,text:string>>")), lambda r: r["text"].isNotNull())
    reply = lambda r: F.struct(ids.message_id(r["text"], r["ts"]).alias("message_id"), r["ts"].alias("timestamp"), r["text"].alias("text"))
    return rows.select("channel_id", "msg_pos", ids.message_id(F.col("m.text"), F.col("m.ts")).alias("message_id"), F.col("m.ts").alias("timestamp"), F.col("m.text").alias("text"), F.transform(kept, reply).alias("thread"))


def without_blanks(messages: DataFrame) -> DataFrame:
    """Blank messages go with their replies; blank replies go alone."""
    kept = messages.where(~text.is_blank(F.col("text")))
    return kept.withColumn("thread", F.filter("thread", lambda r: ~text.is_blank(r["text"]))) if "thread" in kept.columns else kept


def with_constants(messages: DataFrame, compat: bool = True) -> DataFrame:
    """user is unknown; in compat mode the timestamp is the message id, as downstream files have it."""
    out = messages.withColumn("user", F.lit(UNKNOWN_USER))
    return out.withColumn("timestamp", F.col("message_id")) if compat else out


def is_thread_parent(thread_ts: Column, reply_count: Column, ts: Column) -> Column:
    return (F.coalesce(thread_ts, F.lit("")) != "") & (F.coalesce(reply_count, F.lit(0)) > 0) & (ts == thread_ts)


def flattened(messages: DataFrame) -> DataFrame:
    """Parents and replies in one list: channel_id, msg_pos, reply_pos (-1: parent), message_id, timestamp, text."""
    parents = messages.select("channel_id", "msg_pos", F.lit(-1).alias("reply_pos"), "message_id", "timestamp", "text")
    replies = messages.select("channel_id", "msg_pos", F.posexplode("thread").alias("reply_pos", "r"))
    return parents.union(replies.select("channel_id", "msg_pos", "reply_pos", "r.message_id", "r.timestamp", "r.text"))


def files_of(raw: DataFrame) -> DataFrame:
    """One row per attachment of a top-level message."""
    rows = raw.select("channel_id", F.explode("messages").alias("m")).select("channel_id", F.col("m.ts").alias("timestamp"), F.explode("m.files").alias("f"))
    return rows.select("channel_id", "f.id", "f.name", F.col("f.url_private").alias("url"), F.col("f.url_private_download").alias("url_download"), "f.mimetype", "f.size", "timestamp")


def dependency_breaks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand with more than one value: (key, n_values)."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")
