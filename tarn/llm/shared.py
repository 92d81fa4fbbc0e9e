"""Lineage cuts and files that every executor and the driver can reach."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set on its context; one of our own only where everything runs on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tarn-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession) -> str:
    """URI of a fresh folder under the session's checkpoint directory.

    A cluster names the shared folder in ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) is a folder of our own made.
    """
    base = _checkpoint_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/tarn-{uuid.uuid4().hex}"


def files_at(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and path for a URI as Spark writes them: S3's connectors have schemes of their own there."""
    for scheme in ("s3a://", "s3n://"):
        uri = uri.replace(scheme, "s3://", 1) if uri.startswith(scheme) else uri
    return fs.FileSystem.from_uri(uri)


def folded(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """`docs` with all columns but `needed` folded into one, so no name clashes with an operator's own, and the way to each."""
    others = [c for c in docs.columns if c not in needed]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("__rest")] if others else []
    return docs.select(*(c for c in docs.columns if c in needed), *rest), lambda c: F.col("__rest").getField(c).alias(c) if c in others else F.col(c)


#: Whether shuffle files go as soon as the query that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once and go on from the files; the shuffle files before it go."""
    spark = df.sparkSession
    _checkpoint_dir(spark)
    # Spark looks at the setting where a frame is made; without it the files stay until the driver collects its garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Keys with at least so many rows, and a thousandth of all, are dealt over so many parts in a join.
HOT_ROWS, HOT_SALTS = 1000, 64


def hot_keys(counts: DataFrame, key: str, rows: str) -> DataFrame | None:
    """Keys of `counts` with very many rows, if there are such: a thousand at most, so they can be broadcast."""
    total, top = counts.agg(F.sum(rows), F.max(rows)).first()
    least = max(HOT_ROWS, (total or 0) // 1000)
    return F.broadcast(counts.filter(F.col(rows) >= least).select(key, F.lit(True).alias("__hot"))) if (top or 0) >= least else None


def joined(many: DataFrame, one: DataFrame, key: str, rows: str) -> DataFrame:
    """`dealt` by the counts that `one` has."""
    return dealt(many, one, key, hot_keys(one, key, rows))


def dealt(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """`many` with the columns of `one`, which has each key once.

    Rows of a `hot` key that a large share of `many` has are spread over parts, each of which gets a copy of `one`'s row.
    """
    if hot is None:
        return many.join(one, key)
    by = [c for c in many.columns if c != key] or [key]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(HOT_SALTS))).otherwise(F.lit(0))
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(hot, key, "left").withColumn("__salt", salt.cast("int")).drop("__hot")
    right = one.join(hot, key, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")


def table(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as compressed Parquet: for wide rows such as texts."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
