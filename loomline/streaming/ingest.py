"""Incremental ingest: new chat rows are chunked batch by batch, each row once.

Which rows came before is known by a state store keyed by row: a batch costs what its own rows cost,
however much was ingested before. Nothing that was written is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def identity(columns: list[str], key: str) -> Column:
    """What tells rows apart: the key; where it is null, all columns, nulls being equal."""
    whole = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return F.when(F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("r"), whole))


def first_seen(rows: DataFrame, key: str, expiry: str | None = None) -> DataFrame:
    """A stream's rows whose key no earlier row had; of repeats within a batch, any one.

    expiry: how long a key is remembered after it came, by the clock of the batches (``30 days``), which
    bounds the state. A row is never too late, as its time is that of its batch. None: for ever.
    The state lies in the store the session names; with many keys, one on disk (RocksDB).
    """
    told = rows.withColumn("identity_", identity(rows.columns, key))
    if expiry is None:
        return told.dropDuplicates(["identity_"]).drop("identity_")
    timed = told.withColumn("seen_", F.current_timestamp()).withWatermark("seen_", expiry)
    return timed.dropDuplicatesWithinWatermark(["identity_"]).drop("identity_", "seen_")


def ingest(rows: DataFrame, target: str, checkpoint: str, key: str = "message_id", expiry: str | None = None):
    """A writer that appends a stream's rows with new keys, and their text's length, to a Parquet table.

    A micro-batch writes to a folder of its number, so a batch that is run again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("length", F.length("text")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    out = first_seen(rows, key, expiry).writeStream.foreachBatch(write)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def ingest_messages(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "message_id", expiry: str | None = None):
    """``ingest`` from a folder of JSON files."""
    return ingest(spark.readStream.schema(schema).json(source), target, checkpoint, key, expiry)
