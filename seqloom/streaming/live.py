"""Streams with the batch operators: scoring new sequences, and labels in event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import scores
from seqloom.sources import tables


def score_stream(spark: SparkSession, source: str, schema: str, scorer: Callable, target: str, checkpoint: str) -> StreamingQuery:
    """Score the sequences (column seq) of each new Parquet file once, and append them to a Parquet table."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = scores.predict(stream, scorer)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: Column, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Counts per key and event-time window; state older than the watermark goes. Works on streams and on tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "key", "n"
    )


def unseen(stream: DataFrame, key: Sequence[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows whose key has not come before. With ``time`` a key is forgotten, and a row left out, when it is older than the watermark;
    without it keys are kept for good, on disk."""
    if time:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))
    return stream.dropDuplicates(list(key))


def score_new(
    spark: SparkSession, source: str, schema, key: Sequence[str], score: Callable[[DataFrame], DataFrame], target: str, time: str | None = None, late: str = "1 day"
) -> StreamingQuery:
    """Score the rows of new Parquet files whose key was not scored before, whatever file brings it again; ``score`` is a batch operator.

    A micro-batch has a folder of its own below ``target``, written again if it runs again, so nothing is scored twice or lost when the
    driver or an executor is. State and progress are below ``target`` too; the call after a stop goes on from there. The new rows of a
    micro-batch are stored before they are scored, so the keys are looked up once however often ``score`` reads its rows.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")  # counting them reads each key once more
    rows = unseen(spark.readStream.schema(schema).parquet(source), key, time, late)

    def add(batch: DataFrame, epoch: int) -> None:
        score(tables.written(batch, "new")).write.mode("overwrite").parquet(f"{target}/scored/epoch={epoch}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()


def scored(spark: SparkSession, target: str) -> DataFrame:
    """What ``score_new`` has written so far."""
    return spark.read.parquet(f"{target}/scored").drop("epoch")
