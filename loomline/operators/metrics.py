"""Retrieval metrics over runs (query_id, doc_id, rank) and judgements (query_id, doc_id, score).

Judgements without a query_id hold for every query of the run; they are met by document alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(qrels: DataFrame) -> list[str]:
    return [c for c in ("query_id", "doc_id") if c in qrels.columns]


def recall_at_k(run: DataFrame, qrels: DataFrame, k: int = 20, totals: DataFrame | None = None) -> DataFrame:
    """Per query with results and judgements: judged score found in the first k over all judged score.

    totals (query_id, total) stands in where qrels hold the run's documents alone. The run is
    bounded by its depth, so only its rows meet the judgements.
    """
    top = run.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    found = top.join(qrels, _keys(qrels)).groupBy("query_id").agg(F.sum("score").alias("found"))
    asked = run.select("query_id").distinct().join(found, "query_id", "left")
    if totals is None and "query_id" in qrels.columns:
        totals = qrels.groupBy("query_id").agg(F.sum("score").alias("total"))
    if totals is not None:
        met = asked.join(totals, "query_id")
    else:  # judgements for every query have one total, a number
        met = asked.withColumn("total", F.lit(float(qrels.agg(F.sum("score").alias("t")).first()["t"] or 0.0)))
    return met.where("total > 0").select("query_id", F.round(F.coalesce("found", F.lit(0.0)) / F.col("total"), 9).alias("recall"))


def first_relevant_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query of the run: rank of its first judged document, 0 without one; hit_20 tells if within 20."""
    hits = run.join(qrels.select(_keys(qrels)).distinct(), _keys(qrels)).groupBy("query_id").agg(F.min("rank").alias("r"))
    rank = F.coalesce("r", F.lit(0)).cast("bigint")
    return run.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", rank.alias("first_rank"), ((rank > 0) & (rank <= 20)).cast("bigint").alias("hit_20"))


def per_call_rank(lists: DataFrame, qrels: DataFrame) -> DataFrame:
    """first_relevant_rank for every single list of a query."""
    hits = lists.join(qrels.select(_keys(qrels)).distinct(), _keys(qrels)).groupBy("query_id", "list_id").agg(F.min("rank").alias("r"))
    return lists.select("query_id", "list_id").distinct().join(hits, ["query_id", "list_id"], "left").select("query_id", "list_id", F.coalesce("r", F.lit(0)).cast("bigint").alias("first_rank"))


def best_over_attempts(attempts: DataFrame, key: str, value: str) -> DataFrame:
    return attempts.groupBy(key).agg(F.coalesce(F.max(value), F.lit(0)).alias("best"))


def success_rates(outcomes: DataFrame) -> DataFrame:
    """One row of rates over (found 0/1, hit 0/1, steps)."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 9)
    return outcomes.agg(F.count("*").alias("n"), mean("found").alias("success_rate"), mean("hit").alias("recall_rate"), mean("steps").alias("mean_steps"))


def running_rates(outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """Rates over all outcomes of a key so far: (key, order, n, success_rate)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return outcomes.select(key, order, F.count("*").over(w).alias("n"), F.round(F.avg(F.col("found").cast("double")).over(w), 9).alias("success_rate"))


def best_calls(calls: DataFrame, most: int = 5) -> DataFrame:
    """Per query the distinct calls that ranked a judged document, best first: (query_id, place, call, rank)."""
    kept = calls.where("rank > 0").groupBy("query_id", "call").agg(F.min(F.struct("rank", "pos")).alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.rank", "b.pos")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", F.col("place").cast("bigint").alias("place"), "call", F.col("b.rank").alias("rank"))


def calls_histogram(calls: DataFrame) -> DataFrame:
    """How many queries kept so many calls."""
    return calls.groupBy("query_id").agg(F.count("*").alias("n_calls")).groupBy("n_calls").agg(F.count("*").alias("n_queries"))


def mapping_rate(rows: DataFrame, found: str) -> DataFrame:
    return rows.agg(F.round(F.avg(F.col(found).isNotNull().cast("double")), 9).alias("rate"))
