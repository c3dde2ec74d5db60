"""Folders and intermediate tables on the file system that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master may leave it unset; it then gets one below /tmp, removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_folder(spark)}/seqloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else as it is, for Spark to join as it can."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
