"""Samplers as wholes: a stream gives the batches of one run, however it is cut, stopped and started again."""

import shutil

import pytest
from pyspark.sql import functions as F

from seqloom.operators import intervals, samplers, sequences
from seqloom.sources import draws


@pytest.fixture(scope="module")
def sampler(spark):
    letters = [(f"c{i}", ("ACGTTGCAAC" * 40 + "N" * (90 * i))[: 400 + 40 * i]) for i in range(4)]
    table = spark.createDataFrame(letters, "name string, seq string")
    places = samplers.whole_sequences(sequences.catalogue(table), 30, F.when(F.col("name") == "c3", "validate").otherwise("train"))
    places = places.withColumn("place", F.substring("name", 2, 1).cast("long"))
    marks = spark.createDataFrame([(f"c{i}", a, a + 25, f) for i in range(4) for a, f in ((50, "x"), (60, "y"), (200, "x"), (205, "y"))], "chrom string, fs long, fe long, feature string")
    names = spark.createDataFrame([("x", 0, 0.5), ("y", 1, 0.5)], "feature string, ix int, threshold float")
    return samplers.Sampler(places, sequences.chunked(table, 30, 64), marks, names, 30, 10, 7, chunk=64)


def rows(df):
    return sorted(map(tuple, df.select("mode", "draw_id", "name", "start", "end", "strand", "seq", "positives", "sample", "batch_id").collect()))


def test_ranges_of_numbers(spark):
    got = draws.read(spark, {"train": 25, "test": 3}, {"train": 20}, per_task=2)
    assert got.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, got.collect())) == [("test", i) for i in range(3)] + [("train", i) for i in range(20, 25)]
    assert draws.read(spark, {"train": 4}, {"train": 9}).count() == 0


def test_every_sample_is_what_its_draw_says(spark, sampler):
    got = sampler.sampled(spark, {"train": 300, "validate": 80}, 16)
    seqs = {r["name"]: r["seq"] for r in sampler.chunks.filter("chunk_start = 0").select("name", F.lit("").alias("seq")).collect()}
    seen = got.collect()
    assert seen and set(seqs) == {"c0", "c1", "c2", "c3"}
    assert all(len(r["seq"]) == 30 and r["positives"] in ("0", "1", "0;1") and r["seq"].count("N") <= 9 for r in seen)
    assert {r["name"] for r in seen if r["mode"] == "validate"} <= {"c3"} and all(r["name"] != "c3" for r in seen if r["mode"] == "train")
    for mode in ("train", "validate"):
        own = sorted((r for r in seen if r["mode"] == mode), key=lambda r: r["draw_id"])
        assert [r["sample"] for r in own] == list(range(len(own))) and [r["batch_id"] for r in own] == [i // 16 for i in range(len(own))]
    # The labels of one sample by hand.
    r = seen[0]
    middle = r["start"] + 15
    by_hand = [ix for ix, spans in enumerate([((50, 75), (200, 225)), ((60, 85), (205, 230))]) if sum(a <= p < b for p in range(middle - 5, middle + 5) for a, b in spans) > 4]
    assert r["positives"] == ";".join(map(str, by_hand))


@pytest.mark.parametrize("step", [90, 500])
def test_a_stream_goes_on_where_it_stopped(spark, sampler, tmp_path, step):
    until = {"train": 200, "validate": 60}
    target = str(tmp_path / "t")
    sampler.stream(spark, {"train": 70, "validate": 20}, 8, target, step)
    assert rows(sampler.stream(spark, until, 8, target, step)) == rows(sampler.sampled(spark, until, 8))
    assert rows(sampler.stream(spark, until, 8, target, step)) == rows(sampler.sampled(spark, until, 8))  # nothing is left to do


def test_a_micro_batch_that_was_not_committed_runs_again(spark, sampler, tmp_path):
    until = {"train": 120, "validate": 40}
    target = str(tmp_path / "t")
    sampler.stream(spark, {"train": 60, "validate": 20}, 8, target, 30)
    commits = sorted((tmp_path / "t" / "progress" / "commits").glob("[0-9]*"))
    for part in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the driver was lost after the last write
        part.unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "t" / "carry" / f"epoch={commits[-1].name}")
    assert rows(sampler.stream(spark, until, 8, target, 30)) == rows(sampler.sampled(spark, until, 8))


def test_negatives(spark, sampler):
    from dataclasses import replace

    both = replace(sampler, sample_negative=True).sampled(spark, {"train": 100}, 8)
    positive = {r["draw_id"] for r in sampler.sampled(spark, {"train": 100}, 8).collect()}
    got = both.collect()
    assert {r["draw_id"] for r in got if r["positives"]} == positive and len(got) > len(positive)


def test_coverage_is_what_labels_use(spark, sampler):
    bins = spark.createDataFrame([("train", 1, "c0", 60, 70)], "mode string, draw_id long, chrom string, qs long, qe long")
    assert {r["feature"]: r["covered"] for r in intervals.coverage(bins, sampler.features, ["mode", "draw_id"]).collect()} == {"x": 10, "y": 10}
