"""Samplers as wholes: draw a position, fetch its window, label its bin, keep or draw again, number and batch what is kept.

A draw is a function of its number and mode, so a sampler has no state but the next number of each mode (``sources.draws``). Drawing
again is going on with the next number. What a run of draws leaves is numbered in draw order, across runs by the counts carried from one to the
next, so batches are the same whether the draws come at once, in micro-batches, or from a stream that was stopped and started again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.alphabet import DNA, Alphabet, ambiguous_share
from seqloom.operators import intervals, sampling, sequences
from seqloom.sources import draws, tables

MOST_AMBIGUOUS = 0.30
RUN = 1 << 14  # draws whose order one window holds
MODE_STEP = 104729  # apart, in seeds


@dataclass(frozen=True)
class Sampler:
    """What samples are drawn from, and how.

    ``places`` (mode, place, name, start, end): the ranges that positions come from, by length, with replacement; ``place`` is a number of its own.
    ``chunks``: the sequences, as ``sequences.chunked`` stores them with ``chunk``. ``features`` (chrom, fs, fe, feature) and ``names`` (feature,
    ix, threshold) label the ``center`` symbols round the position; ``length`` symbols round it are fetched, on a strand that is drawn too.
    """

    places: DataFrame
    chunks: DataFrame
    features: DataFrame
    names: DataFrame
    length: int
    center: int
    seed: int
    chunk: int = sequences.CHUNK
    sample_negative: bool = False
    most_ambiguous: float = MOST_AMBIGUOUS
    alphabet: Alphabet = DNA

    @cached_property
    def index(self) -> sampling.IntervalIndex:
        """The places laid end to end, mode by mode; built once and kept in the shared folder."""
        rows = self.places.filter(F.col("mode").isin(*sampling.MODES))
        return sampling.interval_index(rows, "place", F.col("end") - F.col("start"), group=_mode_number(), keep=lambda df: tables.written(df, "places"))

    @cached_property
    def stored(self) -> Sampler:
        """This sampler over tables in the shared folder, for runs that read them again and again: its chunks, and its features with the
        overlapping ones of a name merged, which cover the same symbols."""
        proper = F.col("fe") > F.col("fs")
        ranges = self.features.filter(proper).select("chrom", "feature", F.col("fs").alias("start"), F.col("fe").alias("end"))
        merged = intervals.merge(ranges, ["chrom", "feature"]).withColumnsRenamed({"start": "fs", "end": "fe"})
        features = merged.unionByName(self.features.filter(~proper).select("chrom", "feature", "fs", "fe"))
        names = tables.written(self.names, "names")
        return replace(self, chunks=tables.written(self.chunks, "chunks"), features=tables.written(features, "features"), names=names)

    def located(self, numbers: DataFrame, expected: int) -> DataFrame:
        """mode, draw_id, name, position, strand of the draws (mode, draw_id)."""
        seeds = {k: self.seed + MODE_STEP * k for k in range(len(sampling.MODES))}
        drawn = sampling.placed_draws(numbers, self.index, seeds, expected, _mode_number())
        found = drawn.join(self.places.select("mode", "place", "name", "start"), ["mode", "place"])
        return found.select("mode", "draw_id", "name", (F.col("start") + F.col("offset")).alias("position"), "strand")

    def kept(self, numbers: DataFrame, expected: int) -> DataFrame:
        """mode, draw_id, name, start, end, strand, seq, positives: the draws whose window was found, is clear enough and (unless negatives are
        wanted) has a positive label. ``positives`` are the numbers of the positive features, joined by ``;``."""
        at = tables.written(self.located(numbers, expected), "located")  # read by windows and by bins
        start, end = sequences.around(F.col("position"), self.length)
        windows = at.select("mode", "draw_id", "position", "name", start.alias("start"), end.alias("end"), "strand")
        found = sequences.fetch_chunked(windows, self.chunks, self.chunk).filter(sampling.retrieved(F.col("seq")))
        clear = found.filter(ambiguous_share(F.col("seq"), self.alphabet) <= self.most_ambiguous)
        qs, qe = sequences.around(F.col("position"), self.length, self.center)
        bins = at.select("mode", "draw_id", F.col("name").alias("chrom"), qs.alias("qs"), qe.alias("qe"))
        covered = intervals.coverage(bins, self.features, ["mode", "draw_id"]).join(self.names, "feature")
        positive = covered.filter(F.col("covered") > intervals.threshold_bases(F.lit(self.center), F.col("threshold")))
        labels = positive.groupBy("mode", "draw_id").agg(F.array_join(F.sort_array(F.collect_list("ix")), ";").alias("positives"))
        out = clear.drop("position").join(labels, ["mode", "draw_id"], "left" if self.sample_negative else "inner")
        return out.withColumn("positives", F.coalesce("positives", F.lit("")))

    def batches(self, numbers: DataFrame, expected: int, size: int, before: Mapping[str, int] | None = None) -> DataFrame:
        """The kept draws with ``sample`` (from 0 in draw order, per mode) and ``batch_id``; ``before`` has the samples of earlier draws."""
        out = numbered(tables.written(self.kept(numbers, expected), "kept"), before or {})
        return out.withColumn("batch_id", F.floor(F.col("sample") / size))

    def sampled(self, spark: SparkSession, until: Mapping[str, int], size: int) -> DataFrame:
        """All batches of the draws below ``until``."""
        return self.batches(draws.read(spark, until), sum(until.values()), size)

    def stream(self, spark: SparkSession, until: Mapping[str, int], size: int, target: str, step: int) -> DataFrame:
        """The same batches, drawn as a stream into ``target`` and read from there.

        Each micro-batch writes its own folder of samples, then the count of samples so far; running one again writes the same again. What all
        of them read is stored first (``stored``), so that none goes through the sequences and features as they were given. A
        call with a greater ``until`` goes on where the last one ended, whether that one ended well or not.
        """
        reached = _last_carry(spark, target)
        numbers = draws.stream(spark, until, step, reached={m: r["reached"] for m, r in reached.items()})

        def add(micro: DataFrame, epoch: int) -> None:
            before = _carry(spark, target, epoch - 1)
            path = f"{target}/samples/epoch={epoch}"
            self.stored.batches(micro, step, size, {m: r["samples"] for m, r in before.items()}).write.mode("overwrite").parquet(path)
            done = {r["mode"]: r["n"] for r in spark.read.parquet(path).groupBy("mode").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per mode
            came = {r["mode"]: r["n"] for r in micro.groupBy("mode").agg((F.max("draw_id") + 1).alias("n")).collect()}
            rows = [(m, before.get(m, {}).get("samples", 0) + done.get(m, 0), came.get(m, before.get(m, {}).get("reached", 0))) for m in sorted(until)]
            came_to[epoch] = {m: n for m, _, n in rows}
            spark.createDataFrame(rows, "mode string, samples long, reached long").coalesce(1).write.mode("overwrite").parquet(f"{target}/carry/epoch={epoch}")

        came_to: dict[int, dict[str, int]] = {}
        at = {m: r["reached"] for m, r in reached.items()}
        if any(at.get(m, 0) < n for m, n in until.items()):
            running = numbers.writeStream.foreachBatch(add).option("checkpointLocation", f"{target}/progress").start()
            try:
                while any(at.get(m, 0) < n for m, n in until.items()) and not running.awaitTermination(0.2):
                    last = running.lastProgress
                    at = came_to.get(last["batchId"], at) if last else at
            finally:
                running.stop()
            if running.exception():
                raise running.exception()
        return spark.read.parquet(f"{target}/samples").drop("epoch")


def _mode_number():
    return F.array_position(F.array(*map(F.lit, sampling.MODES)), F.col("mode")).cast("int") - 1


def numbered(kept: DataFrame, before: Mapping[str, int]) -> DataFrame:
    """``sample`` by mode and draw order: ranks within runs of ``RUN`` draws, plus the counts of the runs and calls before."""
    runs = kept.withColumn("_run", F.floor(F.col("draw_id") / RUN))
    sizes = runs.groupBy("mode", "_run").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("mode").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    carried = reduce(lambda out, m: F.when(F.col("mode") == m, F.lit(before[m])).otherwise(out), before, F.lit(0))
    sizes = sizes.select("mode", "_run", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + carried).alias("_before"))
    within = Window.partitionBy("mode", "_run").orderBy("draw_id")
    ranked = runs.withColumn("_within", F.row_number().over(within)).join(sizes, ["mode", "_run"])
    return ranked.withColumn("sample", F.col("_before") + F.col("_within") - 1).drop("_run", "_before", "_within")


def whole_sequences(catalogue: DataFrame, length: int, mode) -> DataFrame:
    """Places of a sampler over all positions: each sequence (name, length) but ``length`` symbols at either end; too short ones are left out."""
    rows = catalogue.select(F.col("name").alias("place"), "name", F.lit(length).cast("long").alias("start"), (F.col("length") - length).cast("long").alias("end"))
    return rows.filter("end > start").withColumn("mode", mode)


def _epochs(spark: SparkSession, target: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/carry")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema("mode string, samples long, reached long, epoch long").parquet(f"{target}/carry") if there else None


def _carry(spark: SparkSession, target: str, epoch: int) -> dict[str, dict]:
    table = _epochs(spark, target) if epoch >= 0 else None
    return {r["mode"]: r.asDict() for r in table.filter(F.col("epoch") == epoch).collect()} if table is not None else {}


def _last_carry(spark: SparkSession, target: str) -> dict[str, dict]:
    table = _epochs(spark, target)
    last = table.agg(F.max("epoch")).first()[0] if table is not None else None
    return _carry(spark, target, last) if last is not None else {}

