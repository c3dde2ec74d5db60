"""Line numbers over files and splits, and rows in input order over many files."""

import pytest
from pyspark.sql import functions as F

from seqloom.sources import lines, readers, writers


@pytest.fixture
def small_splits(spark):
    for k, v in (("maxPartitionBytes", "64"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_numbers_over_files_and_splits(spark, tmp_path, small_splits):
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for name, n in (("b.txt", 90), ("a.txt", 3), ("d.txt", 1), ("c.txt", 40), ("e.txt", 0)):
        (folder / name).write_text("".join(f"{name} {i} {'x' * (i * 7 % 50)}\n" for i in range(n)))
    for name, n in (("a.txt", 3), ("b.txt", 90), ("c.txt", 40), ("d.txt", 1)):
        want += [(len(want) + i, i, f"{name} {i} {'x' * (i * 7 % 50)}") for i in range(n)]
    got = lines.numbered(spark, str(folder))
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r["line"], r["file_line"], r["value"]) for r in got.collect()) == want


def test_regions_and_scores_keep_the_order_of_the_input(spark, tmp_path, small_splits):
    rows = [f"chr{i % 3}\t{100 + i}\t{140 + i}" if i % 7 else "bad line" for i in range(60)]
    (tmp_path / "r.bed").write_text("\n".join(rows) + "\n")
    sizes = spark.createDataFrame([(f"chr{i}", 1000) for i in range(3)], "name string, length long")
    good, bad = readers.prediction_regions(spark, str(tmp_path / "r.bed"), sizes, 20)
    assert sorted(r["line"] for r in good.collect()) == [i for i in range(60) if i % 7] and bad.count() == 9
    scored = good.repartition(6).withColumn("prediction", F.array(F.col("line") / 2, F.lit(0.25)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    writers.score_text(scored, str(tmp_path / "s"), ["line", "name"], "prediction", ["a", "b"], ["line"])
    writers.score_matrix(scored.withColumn("row_id", F.col("line")), str(tmp_path / "m"), ["line", "name"], "prediction")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "s").glob("part-*"))
    text = [line.split("\t") for p in parts for line in p.read_text().splitlines() if not line.startswith("line")]
    assert len(parts) > 1 and [int(c[0]) for c in text] == [i for i in range(60) if i % 7]
    assert text[0] == ["1", "chr1", "5.00e-01", "2.50e-01"]
    labels = [line.split("\t")[0] for p in sorted((tmp_path / "m.row_labels").glob("part-*")) for line in p.read_text().splitlines() if not line.startswith("line")]
    ids = [r["row_id"] for p in sorted((tmp_path / "m").glob("part-*")) for r in spark.read.parquet(str(p)).collect()]
    assert list(map(int, labels)) == ids == [i for i in range(60) if i % 7]
