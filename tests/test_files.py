"""Readers and writers by round trips on small files, and the end-to-end runs on them."""

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import alphabet as A
from seqloom.operators import interpret, metrics, prep, sampling, variants
from seqloom.plans import runs
from seqloom.sources import readers, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_interval_readers(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "chr1\t1\t5\tCTCF\nchr2\t0\t9\tDNase\n")
    assert rows(readers.bed(spark, bed)) == [("chr1", 1, 5, "CTCF"), ("chr2", 0, 9, "DNase")]
    stranded = put(tmp_path, "b.bed", "chr1\t1\t5\t-\tCTCF\n")
    assert rows(readers.bed(spark, stranded, stranded=True)) == [("chr1", 1, 5, "-", "CTCF")]
    assert rows(readers.intervals(spark, put(tmp_path, "c.bed", "#x\nchr1\t2\t4\n"))) == [("chr1", 2, 4)]
    labelled = put(tmp_path, "d.bed", "chr1\t0\t9\nchr1\t1\t9\t0;2\nchr1\t2\t9\t-\t1\n")
    assert rows(readers.labelled_bed(spark, labelled)) == [("chr1", 0, 9, "+", ""), ("chr1", 1, 9, "+", "0;2"), ("chr1", 2, 9, "-", "1")]
    peaks = put(tmp_path, "e.narrowPeak", "chr1\t10\t20\tp1\t0\t.\t1.5\t2\t3\t4\n")
    assert rows(readers.narrow_peaks(spark, peaks, "K562|CTCF")) == [("chr1", 10, 20, ".", "K562|CTCF")]
    meta = readers.metadata(spark, put(tmp_path, "f.txt", "x.gz\tcell=K562; antibody=CTCF\n")).first()
    assert meta["file"] == "x.gz" and meta["fields"] == {"cell": "K562", "antibody": "CTCF"}


def test_matrix_axes(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(0, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "row_id long, seq array<array<double>>").write.parquet(path)
    assert readers.matrix(spark, path).first()["seq"] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    assert readers.matrix(spark, path, (1, 0)).first()["seq"] == [[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", [0.5, 0.25], [1.0, 0.0]), (1, "b", [0.125, 0.0], [0.0, 1.0])], "row_id long, name string, ref array<double>, alt array<double>")
    writers.score_text(df, str(tmp_path / "t"), ["name"], "ref", ["f", "g"])
    assert rows(readers.score_table(spark, str(tmp_path / "t"))) == [("a", "5.00e-01", "2.50e-01"), ("b", "1.25e-01", "0.00e+00")]
    writers.score_matrix(df, str(tmp_path / "m"), ["name"], "ref")
    assert rows(spark.read.parquet(str(tmp_path / "m"))) == [(0, [0.5, 0.25]), (1, [0.125, 0.0])]
    assert rows(readers.score_table(spark, str(tmp_path / "m.row_labels"))) == [("a",), ("b",)]
    writers.both_alleles(df, str(tmp_path / "both"), ["name"], "ref", "alt")
    both = spark.read.parquet(str(tmp_path / "both"))
    assert rows(both.filter("allele = 'alt'").select("name", "scores")) == [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    writers.rejected(spark.createDataFrame([("bad line",)], "value string"), str(tmp_path / "x"))
    assert rows(spark.read.text(str(tmp_path / "x.NA"))) == [("bad line",)]
    samples = spark.createDataFrame([("chr1", 0, 9, "+", "0;2"), ("chr1", 1, 9, "-", "")], "chrom string, start int, end int, strand string, positives string")
    writers.samples_bed(samples, str(tmp_path / "s"))
    assert rows(readers.labelled_bed(spark, str(tmp_path / "s"))) == rows(samples)
    writers.dataset(df.withColumn("split", F.when(F.col("row_id") == 0, "train").otherwise("test")), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).filter("split = 'train'").count() == 1


def test_small_operators(spark):
    one = spark.range(1)
    packed = one.select(A.unpack_sequence(F.array(*[F.array(F.lit(b)) for b in (0b10100000, 0b01100000, 0b00100000, 0b00100000)]), 3).alias("x"))
    assert packed.first()["x"] == [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.25] * 4]
    label = interpret.hover_text(F.lit("chr1"), F.lit(5), F.lit("A"), F.lit("G"), F.array(F.lit("TP53"), F.lit("X")))
    assert one.select(label).first()[0] == "chr1 5 A/G\nTP53, X"
    classes = spark.createDataFrame([([0.1, 0.9], 1), ([0.5, 0.5], 0), ([0.7, 0.3], 1)], "s array<double>, t int")
    assert abs(metrics.accuracy(classes, "s", "t").first()[0] - 2 / 3) < 1e-12
    places = spark.createDataFrame([("chr10", 1, 2), ("chr2", 5, 6), ("chr2", 1, 6), ("chrX", 0, 1)], "chrom string, start int, end int")
    assert [r["chrom"] for r in prep.genome_order(places).collect()] == ["chr2", "chr2", "chr10", "chrX"]
    assert [r["split"] for r in sampling.head_split(places, ["chrom", "start"], 0.5).orderBy("chrom", "start").collect()] == ["train", "train", "validate", "validate"]
    names = spark.createDataFrame([(0, "b"), (1, "a")], "line int, feature string")
    assert rows(prep.feature_index(names).select("feature", "feature_ix")) == [("a", 1), ("b", 0)]
    strands = spark.createDataFrame([("+",), (".",), ("-",)], "strand string")
    assert rows(variants.stranded(strands)) == [("+",), ("-",)]


def test_region_and_variant_runs(spark, tmp_path):
    rng = np.random.default_rng(1)
    genome = {f"chr{k}": "".join(rng.choice(list("ACGT"), 60)) for k in (1, 2)}
    table = spark.createDataFrame(list(genome.items()), "name string, seq string")
    bed = put(tmp_path, "r.bed", "chr1\t20\t30\tx\t0\t+\nchr2\t30\t40\tx\t0\t-\nchr3\t1\t2\nchr1\tx\t2\nchr1\t0\t2\n")
    target = str(tmp_path / "regions")
    runs.predict_regions(spark, bed, table, 10, runs.letter_shares(), list("ACGT"), target)
    got = {r["name"]: [float(r[c]) for c in "ACGT"] for r in readers.score_table(spark, target).collect()}
    turned = genome["chr2"][30:40][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == {n: [round(s.count(c) / 10, 2) for c in "ACGT"] for n, s in (("chr1", genome["chr1"][20:30]), ("chr2", turned))}
    assert rows(spark.read.text(f"{target}.NA")) == [("chr1\tx\t2",), ("chr3\t1\t2",)]
    base = genome["chr1"][29]
    other = "ACGT"[("ACGT".index(base) + 1) % 4]
    vcf = put(tmp_path, "v.vcf", f"#CHROM\tPOS\tID\tREF\tALT\nchr1\t30\tv1\t{base}\t{other}\nchr9\t30\tv2\tA\tC\n")
    target = str(tmp_path / "effects")
    runs.variant_file_effects(spark, vcf, table, 10, runs.letter_shares(), list("ACGT"), target, ("diffs", "abs_diffs"))
    diff = readers.score_table(spark, f"{target}_diffs").first()
    assert {c: float(diff[c]) for c in "ACGT"} == {c: (c == other) * 0.1 - (c == base) * 0.1 for c in "ACGT"}
    assert min(float(readers.score_table(spark, f"{target}_abs_diffs").first()[c]) for c in "ACGT") == 0
    assert len(rows(spark.read.text(f"{target}.NA"))) == 1
