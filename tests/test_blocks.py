"""Block-compressed interval files: blocks from ranges, lines over block ends, regions that read only their blocks."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import intervals
from seqloom.sources import blocks


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    rng = random.Random(8)
    rows = sorted((f"chr{rng.randrange(3)}", s, s + rng.choice([1, 40, 900]), f"f{rng.randrange(4)}") for s in (rng.randrange(200000) for _ in range(3000)))
    text = "#head\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows)
    raw = text.encode()
    path = tmp_path_factory.mktemp("b") / "x.bed.gz"
    path.write_bytes(b"".join(blocks.packed(raw[i : i + 700]) for i in range(0, len(raw), 700)) + blocks._END)
    assert gzip.decompress(path.read_bytes()) == raw
    return str(path), rows, -(-len(raw) // 700) + 1


@pytest.mark.parametrize("size", [1000, 1 << 20])
def test_blocks_and_lines(spark, made, size):
    path, rows, n = made
    found = blocks.blocks(spark, path, size)
    assert found.count() == n == found.select("offset").distinct().count()
    got = blocks.features(found).collect()
    assert sorted(map(tuple, got)) == rows
    covers = blocks.index(spark, path, size)
    assert covers.agg(F.sum("lines")).first()[0] == len(rows)


def test_a_region_reads_its_blocks_only(spark, made):
    path, rows, n = made
    covers = blocks.index(spark, path)
    regions = spark.createDataFrame([(1, "chr1", 5000, 6000), (2, "chr1", 5500, 9000), (3, "chr2", 199000, 300000), (4, "none", 0, 10)], "id long, chrom string, qs long, qe long")
    read = blocks.touched(regions, covers)
    assert 0 < read.count() < n / 8
    whole = spark.createDataFrame(rows, "chrom string, fs long, fe long, feature string")
    keys = ["id", "chrom", "fs", "fe", "feature"]
    want = intervals.overlaps(regions, whole).select(keys).collect()
    assert sorted(blocks.overlaps(regions, covers).select(keys).collect()) == sorted(want) and len(want) > 20


def test_written_files_are_gzip(spark, tmp_path):
    df = spark.range(20000).select(F.concat_ws("\t", F.lit("c"), "id", F.col("id") + 5, F.lit("ä")).alias("value")).repartitionByRange(3, "value")
    files = blocks.write(df, str(tmp_path / "w")).collect()
    assert sum(r["lines"] for r in files) == 20000
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*.gz"))).decode()
    assert sorted(text.splitlines()) == sorted(r["value"] for r in df.collect())
    assert blocks.index(spark, str(tmp_path / "w")).agg(F.sum("lines")).first()[0] == 20000


def test_a_line_longer_than_blocks(spark, tmp_path):
    raw = ("a\t1\t2\t" + "x" * 5000 + "\nb\t3\t4\ty\n").encode()
    (tmp_path / "l.gz").write_bytes(b"".join(blocks.packed(raw[i : i + 900]) for i in range(0, len(raw), 900)))
    got = blocks.features(blocks.blocks(spark, str(tmp_path / "l.gz"))).collect()
    assert sorted((r["chrom"], r["fs"], len(r["feature"])) for r in got) == [("a", 1, 5000), ("b", 3, 1)]
