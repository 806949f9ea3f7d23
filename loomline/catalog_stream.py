"""Registered queries on landed files and streams, both made by Spark from the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _table, query
from .sources import integrity
from .sources.scratch import shared_folder
from .streaming import ingest

#: Document ids that share a file.
IDS_A_FILE = 1000
_DAMAGED = f"""d AS (SELECT doc_id, floor(doc_id / {IDS_A_FILE}.0)::BIGINT AS bucket, substr(md5(doc_id::VARCHAR), 1, 1) AS digit FROM documents WHERE doc_id IS NOT NULL),
  l AS (SELECT *, CASE digit WHEN '0' THEN 'blank' WHEN '1' THEN 'broken' WHEN '2' THEN 'broken' END AS fault, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS line FROM d)"""


def _damaged_files(spark: SparkSession, d: str) -> str:
    """Documents as JSON Lines in order of id, a file for so many ids; by a digit of the id's hash a line is
    emptied, loses its last character, or is an array."""
    digit, whole = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), F.to_json(F.struct("doc_id", "text"))
    line = F.when(digit == "0", F.lit(" ")).when(digit == "1", F.expr("left(w, length(w) - 1)")).when(digit == "2", F.concat(F.lit("["), "w", F.lit("]"))).otherwise(F.col("w"))
    docs = _table(spark, d, "documents").where("doc_id is not null").withColumn("w", whole)
    rows = docs.select(F.floor(F.col("doc_id") / F.lit(IDS_A_FILE)).alias("bucket"), "doc_id", line.alias("value"))
    path = shared_folder(spark, "lines")
    rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "value").write.partitionBy("bucket").text(path)
    return path


def _bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.regexp_extract("file", r"bucket=(-?\d+)", 1).cast("bigint")).drop("file")


@query(f"WITH {_DAMAGED} SELECT bucket, line, fault FROM l WHERE fault IS NOT NULL")
def jsonl_bad_lines(spark, d):
    """The exact numbers of damaged lines, without an order over all lines."""
    return _bucket(integrity.bad_lines(spark, _damaged_files(spark, d))).select("bucket", "line", "fault")


@query(f"WITH {_DAMAGED} SELECT bucket, count(*) AS n_lines, count(*) FILTER (WHERE fault = 'blank') AS n_blank, count(*) FILTER (WHERE fault = 'broken') AS n_broken FROM l GROUP BY bucket")
def jsonl_line_report(spark, d):
    """Lines and faults of each file."""
    return _bucket(integrity.line_report(spark, _damaged_files(spark, d)))


@query("SELECT DISTINCT md5(text) AS message_id, text IS NULL AS is_null, length(text) AS length FROM documents")
def stream_keyed_ingest(spark, d):
    """Documents as a stream, each text once, told apart by keyed state."""
    read = spark.readStream.schema(_table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    target = shared_folder(spark, "ingested")
    ingest.ingest(read.select(F.md5("text").alias("message_id"), "text"), target, shared_folder(spark, "ingest-state")).start().awaitTermination()
    rows = spark.read.schema("message_id string, text string, length int").parquet(target)
    return rows.select("message_id", F.col("text").isNull().alias("is_null"), F.col("length").cast("bigint").alias("length"))
