"""Line-level integrity of JSON Lines files: which lines do not parse, by file and exact line number.

Files are read in splits, and a line's number needs those of all splits before its own. Lines are counted
per split, the counts are summed along each file (a row per split), and only lines at fault meet the
sums: no sort of lines, and no file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is wrong with a line: nothing but white space, or no whole JSON object.
BLANK, BROKEN = "blank", "broken"


def _whole(value: Column) -> Column:
    """Whether the text is one JSON value and nothing besides.

    The parser leaves what follows a value unread, so the text goes as the first of two entries, the second its own
    digest: only a parser that took all of the text as one value finds that there. Lines that a variant cannot
    hold (16 MB and more) count as broken, as do objects that name a field twice.
    """
    digest = F.md5(value)
    read = F.try_parse_json(F.concat(F.lit("["), value, F.lit(',"'), digest, F.lit('"]')))
    return F.coalesce(F.try_variant_get(read, "$[1]", "string") == digest, F.lit(False))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line with its file, split and fault; ids grow by one from line to line within a task, and so within a split."""
    rows = spark.read.text(path, recursiveFileLookup=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_"), F.monotonically_increasing_id().alias("id_"), "value")
    fault = F.when(~F.col("value").rlike(r"\S"), F.lit(BLANK)).when(~F.startswith(F.ltrim("value"), F.lit("{")) | ~_whole(F.col("value")), F.lit(BROKEN))
    return rows.withColumn("fault", fault)


def _splits(lines: DataFrame) -> DataFrame:
    """A row per split: its first id, its lines and faults, and the lines of its file before it."""
    faults = [F.count_if(F.col("fault") == f).alias(f"n_{f}") for f in (BLANK, BROKEN)]
    counts = lines.groupBy("file", "split_").agg(F.min("id_").alias("first_"), F.count("*").alias("n_lines"), *faults)
    before = F.sum("n_lines").over(Window.partitionBy("file").orderBy("split_").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before_", F.coalesce(before, F.lit(0)))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, fault, value) of every line that is no JSON object; lines count from 1. No rows: all files are whole."""
    lines = _lines(spark, path)
    met = lines.where("fault is not null").join(_splits(lines).select("file", "split_", "first_", "before_"), ["file", "split_"])
    return met.select("file", (F.col("before_") + F.col("id_") - F.col("first_") + 1).alias("line"), "fault", "value")


def line_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_lines, n_blank, n_broken) of every file with lines."""
    totals = [F.sum(c).alias(c) for c in ("n_lines", f"n_{BLANK}", f"n_{BROKEN}")]
    return _splits(_lines(spark, path)).groupBy("file").agg(*totals)
