"""Streams with state: repeated and late rows, restarts, windows that close."""

import datetime as dt

from pyspark.sql import functions as F

from seqloom.streaming import live

SCHEMA = "variant string, seen timestamp"


def deliver(spark, path, *rows):
    at = [(v, dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)) for v, h in rows]
    spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_a_variant_is_scored_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    calls = []

    def score(rows):
        calls.append(1)
        return rows.select("variant", F.length("variant").alias("score"))

    run = lambda: live.score_new(spark, source, SCHEMA, ["variant"], score, target).awaitTermination()
    deliver(spark, source, ("a", 0), ("bb", 1), ("a", 2))
    run()
    deliver(spark, source, ("bb", 3), ("ccc", 4))
    deliver(spark, source, ("a", 0), ("dddd", -900))
    run()
    run()  # nothing new
    assert sorted(map(tuple, live.scored(spark, target).collect())) == [("a", 1), ("bb", 2), ("ccc", 3), ("dddd", 4)]
    assert calls


def test_a_micro_batch_that_runs_again_adds_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: live.score_new(spark, source, SCHEMA, ["variant"], lambda rows: rows.select("variant"), target).awaitTermination()
    deliver(spark, source, ("a", 0), ("b", 1))
    run()
    for part in (tmp_path / "out" / "progress" / "commits").iterdir():  # as if the driver was lost before the commit
        part.unlink()
    deliver(spark, source, ("b", 1), ("c", 2))
    run()
    assert sorted(r["variant"] for r in live.scored(spark, target).collect()) == ["a", "b", "c"]


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: live.score_new(spark, source, SCHEMA, ["variant"], lambda rows: rows.select("variant"), target, "seen", "2 hours").awaitTermination()
    deliver(spark, source, ("a", 0), ("b", 10))
    run()
    deliver(spark, source, ("late", 1), ("in time", 9), ("b", 10))
    run()
    assert sorted(r["variant"] for r in live.scored(spark, target).collect()) == ["a", "b", "in time"]


def test_windowed_counts_as_a_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "counts")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        counts = live.windowed_counts(stream, "seen", F.col("variant"), "1 hour", "2 hours")
        query = counts.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    deliver(spark, source, ("a", 0.1), ("a", 0.2), ("b", 1.5))
    run()
    deliver(spark, source, ("a", 0.3), ("a", 6))  # the first is within two hours of 1.5
    run()
    deliver(spark, source, ("a", 0.4), ("z", 12))  # the first is too late now
    run()
    got = sorted((r["start"].hour, r["key"], r["n"]) for r in spark.read.parquet(target).collect())
    assert got == [(0, "a", 3), (1, "b", 1), (6, "a", 1)]
