"""Validated pairs and chunks to documents, queries and relevance judgements, with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import short_md5

#: Strategies in the order in which a pair's chunk is looked for.
STRATEGIES = ("sliding_window", "individual_message", "thread")


def documents(chunks: DataFrame) -> DataFrame:
    """id, chunk_id, content: one row per chunk id, the last by ``pos`` where ids repeat."""
    kept = chunks.groupBy("chunk_id").agg(F.max_by("content", "pos").alias("content"))
    return kept.select(short_md5("d_", F.col("chunk_id")).alias("id"), "chunk_id", "content")


def queries(pairs: DataFrame) -> DataFrame:
    """id, query, persona: one row per query text, the first persona by ``pos``."""
    kept = pairs.groupBy("query").agg(F.min_by("persona", "pos").alias("persona"))
    return kept.select(short_md5("q_", F.col("query")).alias("id"), "query", "persona")


def qrels(pairs: DataFrame) -> DataFrame:
    """query_id, document_id, score 1.0: one row per pair."""
    return pairs.select(short_md5("q_", F.col("query")).alias("query_id"), short_md5("d_", F.col("chunk_id")).alias("document_id"), F.lit(1.0).alias("score"))


def with_strategy(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each pair with the first strategy's chunk that has its id; pairs without one are not in it."""
    prio = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("chunk_type"))
    best = chunks.where(prio > 0).groupBy("chunk_id").agg(F.min_by(F.struct("chunk_type", "content"), prio).alias("c"))
    return pairs.join(best, "chunk_id").select(*pairs.columns, "c.chunk_type", "c.content")


def without_chunk(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    return pairs.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no stored result: what a resumed run still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def integrity(qrel_rows: DataFrame, query_rows: DataFrame, document_rows: DataFrame) -> DataFrame:
    """One row: counts, and judgements that name no query or no document."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    no_query = qrel_rows.join(query_rows.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    no_document = qrel_rows.join(document_rows.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    parts = [count(query_rows, "n_queries"), count(document_rows, "n_documents"), count(qrel_rows, "n_qrels"), count(no_query, "missing_queries"), count(no_document, "missing_documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out


def collisions(rows: DataFrame, text: str) -> DataFrame:
    """Shortened ids that stand for several texts: (id, n_texts)."""
    return rows.groupBy("id").agg(F.count_distinct(text).alias("n_texts")).where("n_texts > 1")


def persona_distribution(pairs: DataFrame) -> DataFrame:
    """persona, n, percent; the total is one number over a handful of groups."""
    counts = pairs.groupBy("persona").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def density(qrel_rows: DataFrame, query_rows: DataFrame, document_rows: DataFrame) -> DataFrame:
    row = integrity(qrel_rows, query_rows, document_rows)
    per = lambda c: F.round(F.try_divide(F.col("n_qrels").cast("double"), F.col(c)), 6)
    return row.select(per("n_queries").alias("per_query"), per("n_documents").alias("per_document"))
