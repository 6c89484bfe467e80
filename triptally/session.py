"""Where intermediate tables may be written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    Only a local session without the setting gets a temporary folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so the setting is required there.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="triptally-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
