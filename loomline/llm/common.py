"""Shared plumbing: scratch tables in the cluster's shared folder, table reads."""

from __future__ import annotations

import atexit
import functools
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS, MOST_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a local master, one of our own where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # The setting cannot be changed in a running session, so the folder is remembered here.
    return (found or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="loomline-")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def path_fs(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = path_fs(spark, path)
    fs.delete(at, True)


class Scratch:
    """Tables that cut lineage. A lost executor costs a re-read, never a re-run.

    ``cut`` writes and rereads, and lets go of the shuffle files behind the table; ``drop``
    removes tables no later step reads. An operator ends with ``last``: its decisions are
    written, every other table of it goes. Those few go when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        with _lean(self.spark):
            df.write.parquet(path)
        self.paths.setdefault(label, []).append(path)
        _written.setdefault(self.spark.sparkContext.applicationId, set()).add(path)
        atexit.unregister(_remove_written)
        atexit.register(_remove_written)
        let_go(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            for path in self.paths.pop(label):
                drop_path(self.spark, path)
                _written.get(self.spark.sparkContext.applicationId, set()).discard(path)

    def last(self, df: DataFrame, label: str) -> DataFrame:
        """df as a table, the only one left."""
        others = list(self.paths)
        out = self.cut(df, f"last-{label}")
        self.drop(*others)
        return out


@contextmanager
def _lean(spark: SparkSession):
    """Within it, an action's shuffle files go when it ends (what it wrote is read instead), and
    batches for Python are of so few rows that whole texts, long ones too, fit executors several times."""
    before = {k: spark.conf.get(k, d) for k, d in ((SHUFFLE_CLEANUP, "false"), (BATCH_ROWS, "10000"))}
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    spark.conf.set(BATCH_ROWS, str(min(MOST_BATCH_ROWS, int(before[BATCH_ROWS]) if int(before[BATCH_ROWS]) > 0 else MOST_BATCH_ROWS)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """For the rest of the session, batches for Python of at most MOST_BATCH_ROWS rows; for applications, whose plans run later."""
    now = int(spark.conf.get(BATCH_ROWS, "10000"))
    if now <= 0 or now > MOST_BATCH_ROWS:
        spark.conf.set(BATCH_ROWS, str(MOST_BATCH_ROWS))


#: Tables still there, by application: paths alone, so that no session or frame is held.
_written: dict[str, set[str]] = {}


def _remove_written() -> None:
    spark = SparkSession.getActiveSession()
    try:
        for path in _written.pop(spark.sparkContext.applicationId, ()) if spark is not None else ():
            drop_path(spark, path)
    except Exception:  # the JVM has gone; the cluster owns its checkpoint folder
        pass


def let_go(spark: SparkSession) -> None:
    """Have the driver free what a written table no longer needs.

    Plans, broadcasts and map statuses live as long as some frame in Python or the JVM does, and Spark's cleaner
    hears of their end from a collection only; it asks for one itself, but each half hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARROW = {"long": "int64", "int": "int32", "double": "float64", "float": "float32", "boolean": "bool", "string": "string", "binary": "binary"}


def arrow_schema(ddl: str):
    """A pyarrow schema for a flat ``name type, ...`` list, for use inside Arrow maps."""
    import pyarrow as pa

    return pa.schema([(name, pa.type_for_alias(_ARROW[kind])) for name, kind in (f.split() for f in ddl.split(","))])


def record_batch(rows: list[tuple], schema):
    """Rows as one record batch of the schema; no rows give an empty one."""
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
