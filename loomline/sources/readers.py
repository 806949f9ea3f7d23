"""Scans of landed archives and JSON Lines, lenient or strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

CORRUPT = "_corrupt_record"


def _multiline(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    read = spark.read.schema(f"{ddl}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return read.json(path).withColumn("file_name", F.col("_metadata.file_name"))


def raw_channels(spark: SparkSession, path: str) -> DataFrame:
    """Raw channel files that parse, one row each, with channel_id and the channel's name."""
    rows = _multiline(spark, path, schemas.RAW_CHANNEL).where(F.col(CORRUPT).isNull())
    return rows.select(F.col("channel_info.id").alias("channel_id"), _base(F.col("file_name")).alias("channel_name"), "channel_info", "members", "message_count", "messages")


def broken_files(spark: SparkSession, path: str, ddl: str = schemas.RAW_CHANNEL) -> DataFrame:
    """Names of files that do not parse, to report."""
    # A scan may not read the corrupt column alone, so the text is parsed here.
    whole = spark.read.text(path, wholetext=True).withColumn("file_name", F.col("_metadata.file_name"))
    parsed = F.from_json("value", f"struct<{_as_struct(ddl)}, {CORRUPT}:string>", {"columnNameOfCorruptRecord": CORRUPT})
    return whole.withColumn("r", parsed).where(F.col(f"r.{CORRUPT}").isNotNull()).select("file_name")


def clean_channels(spark: SparkSession, path: str) -> DataFrame:
    """Clean channel files; the name is the file's, a missing id is ``unknown``."""
    rows = _multiline(spark, path, schemas.CLEAN_CHANNEL).where(F.col(CORRUPT).isNull())
    return rows.select(F.coalesce("channel_id", F.lit("unknown")).alias("channel_id"), _base(F.col("file_name")).alias("channel_name"), "messages")


def _base(name):
    return F.regexp_replace(F.url_decode(name), r"\.json$", "")


def parents(channels: DataFrame) -> DataFrame:
    """Clean channels as parent rows in file order: what chunking reads."""
    rows = channels.select("channel_id", "channel_name", F.posexplode("messages").alias("pos", "m"))
    return rows.select("channel_id", "channel_name", "pos", "m.message_id", "m.timestamp", "m.text", F.coalesce("m.thread", F.array().cast(f"array<{schemas.CLEAN_REPLY}>")).alias("thread"))


def jsonl_lenient(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Lines that hold a brace and parse; others are skipped."""
    lines = spark.read.text(path).where(F.contains("value", F.lit("{")))
    parsed = lines.select(F.from_json("value", f"struct<{_as_struct(ddl)}, {CORRUPT}:string>", {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def jsonl_strict(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Every line parses, or the read fails."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def _as_struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of repeated keys the last row counts."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """A chunk file, of repeated ids the last line; no rows where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.CHUNK)
    rows = spark.read.schema(schemas.CHUNK).json(path).where("chunk_id is not null")
    return last_by_key(rows.withColumn("pos", F.monotonically_increasing_id()), "chunk_id", "pos").drop("pos")


def pair_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Validated pairs: a resumed run skips broken lines, an export fails on them."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schemas.PAIR)
    return jsonl_strict(spark, path, schemas.PAIR) if strict else jsonl_lenient(spark, path, schemas.PAIR)


def json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A file that is one JSON object, as (key, value) rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """Binary files: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def workspaces(spark: SparkSession, root: str) -> list[str]:
    """Folders that hold both chunks and validated pairs."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    has = lambda d, name: fs.exists(jvm.org.apache.hadoop.fs.Path(d, name))
    found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
    return sorted(d.getName() for d in found if has(d, "chunks") and has(d, "validated_query_chunk_pairs.jsonl"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
