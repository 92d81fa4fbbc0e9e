"""Folders and lineage cuts that the driver and every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of its own only where driver and executors are one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tarn-panel-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def fresh_folder(spark: SparkSession, prefix: str = "panel") -> str:
    return f"{shared_root(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once and go on from the files."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def files_at(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and path for a URI or an absolute path as Spark has it: S3's connectors have schemes of their own there."""
    for scheme in ("s3a://", "s3n://"):
        uri = uri.replace(scheme, "s3://", 1) if uri.startswith(scheme) else uri
    return fs.FileSystem.from_uri(uri)
