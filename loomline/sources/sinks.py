"""Sinks: JSON Lines, one file in place of another, keyed upsert, usage log, dumps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import preview, sanitised


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Null fields are left out."""
    df.write.mode(mode).json(path)


def per_channel(df: DataFrame, path: str, workspace: str = "workspace") -> None:
    """One folder per workspace and channel, names made safe."""
    safe = df.withColumn("channel_dir", sanitised(F.col("channel_name")))
    safe.write.mode("overwrite").partitionBy(workspace, "channel_dir").json(path)


CURRENT = "CURRENT"


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write a version's folder under the path, then rename one pointer file over the old pointer.

    Readers, through ``current``, see the old or the new table at any time; a failed write leaves
    the old. The version before last goes.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    before = read_pointer(spark, path)
    df.write.json(f"{path}/{version}")
    write_pointer(spark, path, version)
    fs, at = _file(spark, path)
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(s.getPath(), True)


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that the pointer names; empty before the first one."""
    version = read_pointer(spark, path)
    return spark.read.schema(schema).json(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def _file(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """The text as the folder's pointer, in place of the old one by a rename."""
    jvm = spark.sparkContext._jvm
    fs, staged = _file(spark, f"{path}/{CURRENT}.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}"), over)


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """The folder's pointer; None where there is none yet."""
    fs, at = _file(spark, f"{path}/{CURRENT}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def upserted(stored: DataFrame, new: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """Both tables with the latest row per key; ties go to the new one."""
    both = stored.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("new_").desc())
    return both.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_", "new_")


def usage_log(usage: DataFrame, path: str) -> None:
    usage.select("prompt", "completion", "reasoning").write.mode("append").csv(path)


def run_metadata(spark: SparkSession, path: str, workspace: str, **counts: int) -> None:
    row = spark.range(1).select(F.lit(workspace).alias("workspace_name"), F.current_timestamp().alias("archived_at"), *[F.lit(v).alias(k) for k, v in counts.items()])
    row.write.mode("overwrite").json(path)


def inspection(run: DataFrame, documents: DataFrame, qrels: DataFrame) -> DataFrame:
    """One line of text per ranked document, judged ones marked."""
    met = run.join(documents, "doc_id").join(qrels.select("query_id", "doc_id").distinct().withColumn("good", F.lit("*")), ["query_id", "doc_id"], "left")
    return met.select("query_id", "rank", F.concat_ws(" ", F.col("rank"), F.coalesce("good", F.lit(" ")), "doc_id", preview(F.col("text"), 500)).alias("value"))


def search_export(found: DataFrame) -> DataFrame:
    link = F.col("permalink") if "permalink" in found.columns else F.lit(None).cast("string")
    return found.select("text", F.col("user").alias("username"), "channel", F.col("date").cast("string").alias("timestamp"), link.alias("permalink"))
