"""The corpus pipeline: quality, lines, near-duplicates, benchmark leaks, packing.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of
``docs``; each is written and reread before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import cotraining, jaccard_join, latent, lines, packing
from loomline.llm.common import Scratch, small_batches, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    small_batches(spark)
    return cotraining.accepted(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that repeat an earlier one; those left without any line go."""
    return lines.deduplicated(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near-duplicates (5-word shingles, 0.8)."""
    return jaccard_join.one_of_each(docs, 5, (8, 10))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and no paraphrase of one."""
    small_batches(spark)
    return latent.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, in tokens, with its bin and offset."""
    return packing.pack_tokens(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Three of the stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
