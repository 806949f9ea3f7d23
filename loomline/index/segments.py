"""The store behind the indices: tables of immutable segments, and one pointer file that says which count.

A commit writes the tables of a new segment, ``<path>/<table>/segment=<n>``, and then puts a new
manifest in place of the old by renaming one file; until then readers see the old state, and a commit that
fails leaves it. A manifest names the live segments and holds a few sums, so that its size follows the
number of segments, which ``compact`` brings back to one. Commits may carry a growing sequence
number: one that is not above the last is a repetition and does nothing. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        text = sinks.read_pointer(self.spark, self.path)
        return json.loads(text) if text else {"next": 0, "sequence": None, "segments": []}

    def repeated(self, manifest: dict, sequence: int | None) -> bool:
        return sequence is not None and manifest["sequence"] is not None and sequence <= manifest["sequence"]

    def publish(self, old: dict, segments: list[int], sequence: int | None, **sums) -> None:
        """The next manifest, in place of the old; folders that neither of the two names go."""
        new = old | sums | {"next": old["next"] + 1, "segments": segments, "sequence": sequence if sequence is not None else old["sequence"]}
        sinks.write_pointer(self.spark, self.path, json.dumps(new))
        kept = {f"segment={n}" for n in (*segments, *old["segments"])}
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for table in (s.getPath() for s in fs.listStatus(at) if s.isDirectory()):
            for s in fs.listStatus(table):
                if s.isDirectory() and s.getPath().getName() not in kept:
                    fs.delete(s.getPath(), True)

    def write(self, df: DataFrame, table: str, segment: int, *by: str) -> None:
        """A segment's table; what a commit that failed left there is replaced."""
        # What was shuffled for a table goes once it is written.
        conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{table}/segment={segment}")
        finally:
            conf.set(CLEANUP, before)

    def read(self, table: str, schema: str, manifest: dict, where: Column | None = None) -> DataFrame:
        """Live segments' rows of a table, with ``segment``; conditions on partition columns choose the files that are read."""
        if not manifest["segments"]:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        rows = self.spark.read.schema(f"{schema}, segment int").parquet(f"{self.path}/{table}").where(F.col("segment").isin(manifest["segments"]))
        return rows if where is None else rows.where(where)
