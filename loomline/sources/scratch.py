"""Folders that the driver and all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; on a local master without it, under one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or _own(spark.sparkContext.applicationId)).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _own(application: str) -> str:
    return tempfile.mkdtemp(prefix="loomline-")


def checkpointed(df):
    """df read from the shared folder, partition by partition, with rows in their order: lineage ends here.

    Files go with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
