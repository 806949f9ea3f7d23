"""From clean channels to a validated retrieval dataset, with resume; and the agent loop."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import short_md5
from ..functions.text import json_object_text
from ..operators import export, metrics, retrieval
from ..sources.scratch import shared_folder
from . import providers


def synthetic_queries(chunks: DataFrame, provider, per_chunk: int = 3, seed: int = 0) -> DataFrame:
    """Queries per chunk in seeded personas: query_id, query, chunk_id, content, persona; failures are left out."""
    names = list(providers.PERSONAS)
    pick = F.pmod(F.xxhash64("chunk_id", "n", F.lit(seed)), F.lit(len(names))).cast("int") + 1
    asked = chunks.select("chunk_id", "content", F.explode(F.sequence(F.lit(0), F.lit(per_chunk - 1))).alias("n"))
    asked = asked.withColumn("persona", F.element_at(F.array(*map(F.lit, names)), pick))
    done = providers.call(asked, provider, "generate", ["chunk_id", "content", "persona", "n"])
    return done.where("error is null").select(F.concat_ws("_", "chunk_id", F.lit("query"), "n").alias("query_id"), F.col("value").alias("query"), "chunk_id", "content", "persona")


def validated(queries: DataFrame, provider) -> DataFrame:
    """The queries that the provider finds answered by their chunk, with its reason."""
    done = providers.call(queries, provider, "validate", ["query", "content"])
    verdict = F.from_json("value", "struct<valid:boolean,reason:string>")
    return done.withColumn("v", verdict).where("error is null and v.valid").select("query_id", "query", "chunk_id", "content", "persona", F.col("v.reason").alias("validation_reason"))


def build(chunks: DataFrame, stored: DataFrame, provider, per_chunk: int = 3) -> DataFrame:
    """New validated pairs for chunks that have none stored yet."""
    todo = export.not_done(chunks, stored, "chunk_id")
    return validated(synthetic_queries(todo, provider, per_chunk), provider)


def searched_once(spark: SparkSession, docs: DataFrame, terms: DataFrame, folder: str, step: int, k: int = 100) -> DataFrame:
    """(term, doc_id, rank) of all terms asked in the rounds so far; only those that no earlier round asked are searched now.

    The folder keeps a round's new terms, those without a hit too, and their lists.
    """
    new = terms.where("term is not null").distinct()
    if step:
        new = new.join(spark.read.schema("term string").parquet(f"{folder}/terms"), "term", "left_anti")
    new.write.parquet(f"{folder}/terms/step={step}")
    new = spark.read.schema("term string").parquet(f"{folder}/terms/step={step}")
    lists = retrieval.bm25_lists(docs, new.select(F.col("term").alias("query_id"), "term"), k).select(F.col("query_id").alias("term"), "doc_id", "rank")
    lists.write.parquet(f"{folder}/lists/step={step}")
    return spark.read.schema(lists.schema).parquet(f"{folder}/lists").select("term", "doc_id", "rank")


def rerank_by_provider(run: DataFrame, queries: DataFrame, docs: DataFrame, provider) -> DataFrame:
    """A run in the order of the provider's scores of its texts; where a call fails the score counts 0."""
    told = providers.call(retrieval.with_texts(run, queries, docs).withColumnRenamed("content", "text"), provider, "rerank", ["query", "text"])
    return retrieval.reranked(run, told.select("query_id", "doc_id", F.expr("try_cast(value AS double)").alias("score")))


def agent_loop(
    spark: SparkSession, docs: DataFrame, queries: DataFrame, qrels: DataFrame, provider, most_steps: int = 10, scratch: str | None = None, rerank: bool = True
) -> DataFrame:
    """Rounds of propose, search, fuse, rerank, rank over all queries that have not found rank 1 yet.

    A round's calls and its outcome are written and reread, so a provider is asked once and lineage stays one
    round long. Lists are kept over rounds: a term is searched once, whichever queries and rounds ask for it.
    An action without calls counts as a step. Returns (query_id, step, n_calls, first_rank, hit_20).
    """
    root = f"{scratch}/agent-{uuid.uuid4().hex}" if scratch else shared_folder(spark, "agent")
    open_, out = queries.select("query_id", "query"), None
    for step in range(most_steps):
        acted = providers.call(open_.withColumn("step", F.lit(step)), provider, "act", ["query", "step"])
        action = F.from_json(json_object_text(F.col("value")), "struct<search_calls:array<string>,reasoning:string>")
        calls = acted.select("query_id", F.posexplode(action["search_calls"]).alias("pos", "term"))
        calls.write.parquet(f"{root}/calls/step={step}")
        calls = spark.read.schema(calls.schema).parquet(f"{root}/calls/step={step}")
        lists = searched_once(spark, docs, calls.select("term"), root, step).join(calls, "term")
        run = retrieval.fused(lists.select("query_id", (F.col("pos") + 1).alias("list_id"), "rank", "doc_id"))
        run = rerank_by_provider(run, queries, docs, provider) if rerank else run
        ranked = metrics.first_relevant_rank(run, qrels)
        counted = calls.groupBy("query_id").agg(F.count("*").alias("n_calls"))
        row = open_.select("query_id").join(counted, "query_id", "left").join(ranked, "query_id", "left")
        row = row.select("query_id", F.lit(step).alias("step"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_calls", "first_rank", "hit_20")])
        row.write.parquet(f"{root}/outcomes/round={step}")
        # One scan of all rounds, however many there are.
        out = spark.read.schema(row.schema).parquet(*[f"{root}/outcomes/round={i}" for i in range(step + 1)])
        open_ = queries.select("query_id", "query").join(out.where("first_rank = 1"), "query_id", "left_anti")
        if open_.isEmpty():
            break
    return out


def rekeyed(pairs: DataFrame) -> DataFrame:
    """Pairs with the id that exports derive from the query text."""
    return pairs.withColumn("query_id", short_md5("q_", F.col("query")))
