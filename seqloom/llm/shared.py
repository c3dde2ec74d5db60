"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOCAL_SHARED = "/tmp/checkpoints"
BATCH_BYTES = 8 << 20  # of one Arrow batch between the JVM and Python
SLICE_BYTES = 2 << 20  # of the texts that Python holds as strings at once


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster, where it has to be set. Only on one machine (a local
    master, as in tests) a folder of our own takes its place, and it is removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"{LOCAL_SHARED}/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table below the shared folder."""
    return f"{shared_dir(spark)}/seqloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage, survives lost executors and keeps a costly stage from running twice.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that are no longer read, and let Spark drop the shuffle files of finished steps.

    Spark removes shuffle files when the driver's garbage collector finds their step unreachable; long
    operators ask for that between steps, so that disk holds one step's files and not the sum of all.
    """
    jvm = spark.sparkContext._jvm
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    # What Python still holds keeps its step reachable, and so does the session's latest job.
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that very long texts do not add up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    if now.rstrip("b") == str(64 << 20) or now.lower() == "64m":  # as Spark sets it: nobody chose it
        spark.conf.set(key, str(BATCH_BYTES))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list]]:
    """Where each slice starts, and its values as Python objects; a slice has at most ``limit`` bytes, or one value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, texts.slice(at, stop - at).to_pylist()
        at = stop


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters take the faster built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def whole_text(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
