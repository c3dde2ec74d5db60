"""Row-range datasets: round trip, ranges, crops, and that a range reads its own parts only."""

import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import alphabet as A
from seqloom.sources import rows

LENGTH, TARGETS, PART = 37, 11, 16


def samples(n):
    rng = random.Random(1)
    return [(i, "".join(rng.choice("ACGTNacgt") for _ in range(LENGTH)), [rng.randint(0, 1) for _ in range(TARGETS)]) for i in range(n)]


def encoded(seq):
    return [[float(c == b) if c in "ACGT" else 0.25 for b in "ACGT"] for c in seq.upper()]


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "set")
    data = samples(100)
    rows.write(spark.createDataFrame(data, "row_id long, seq string, targets array<int>").repartition(5), path, LENGTH, TARGETS, rows=PART)
    return path, data


def collected(df):
    return sorted((r["row_id"], [list(x) for x in r["sequence"]], list(r["targets"])) for r in df.collect())


@pytest.mark.parametrize(("start", "stop"), [(0, None), (0, 100), (15, 17), (16, 32), (40, 41), (90, 500), (70, 70), (100, 120)])
def test_ranges(spark, dataset, start, stop):
    path, data = dataset
    got = collected(rows.read(spark, path, LENGTH, TARGETS, start, stop, rows=PART))
    assert got == [(i, encoded(s), t) for i, s, t in data[start:stop]]


@pytest.mark.parametrize(("use", "shift"), [(36, 0), (20, 0), (21, 0), (1, 0), (9, -7), (8, 10), (16, -2)])
def test_crops_equal_the_column_expressions(spark, dataset, use, shift):
    path, data = dataset
    got = collected(rows.read(spark, path, LENGTH, TARGETS, 30, 50, use, shift, rows=PART))
    whole = spark.createDataFrame([(i, encoded(s)) for i, s, _ in data[30:50]], "row_id long, x array<array<float>>")
    want = whole.select("row_id", A.center_crop(F.col("x"), use, shift).alias("x")).collect()
    assert [(i, x) for i, x, _ in got] == sorted((r["row_id"], [list(v) for v in r["x"]]) for r in want)


def test_packed_bytes_are_those_of_the_column_expressions(spark, dataset):
    path, data = dataset
    stored = {r["row_id"]: r for r in spark.read.parquet(path).collect()}
    lanes = [[int(row[k] > 0) for row in encoded(data[5][1])] for k in range(4)]
    bits = spark.createDataFrame([(lane,) for lane in [*lanes, data[5][2]]], "b array<int>")
    packed = [bytes(r["p"]) for r in bits.select(A.pack_bits(F.col("b")).alias("p")).collect()]
    assert bytes(stored[5]["seq"]) == b"".join(packed[:4])
    assert bytes(stored[5]["targets"]) == packed[4]


def test_a_range_reads_its_own_parts_only(spark, tmp_path):
    path = tmp_path / "set"
    data = samples(64)
    rows.write(spark.createDataFrame(data, "row_id long, seq string, targets array<int>"), str(path), LENGTH, TARGETS, rows=PART)
    for part in (0, 3):
        for file in pathlib.Path(path, f"part={part}").glob("*"):
            file.write_bytes(b"no parquet")
        for file in pathlib.Path(path, f"part={part}").glob(".*.crc"):
            file.unlink()
    read = rows.read(spark, str(path), LENGTH, TARGETS, 16, 48, rows=PART)
    assert [i for i, _, _ in collected(read)] == list(range(16, 48))
    with pytest.raises(Exception, match="(?i)parquet|file"):
        rows.read(spark, str(path), LENGTH, TARGETS, 10, 20, rows=PART).collect()


def test_lookup_counts_round_the_dataset(spark, dataset):
    path, data = dataset
    wanted = spark.createDataFrame([(3,), (3,), (103,), (-1,), (250,)], "row_id long")
    got = collected(rows.lookup(wanted, path, LENGTH, TARGETS, len(data), 10, rows=PART))
    first, last = rows.window(LENGTH, 10)
    assert got == [(i, encoded(data[i][1])[first:last], data[i][2]) for i in (3, 50, 99)]


def test_numbers_follow_the_order_over_files(spark):
    rng = np.random.default_rng(2)
    values = [(int(v), i) for i, v in enumerate(rng.integers(0, 50, 500))]
    df = spark.createDataFrame(values, "v long, i long").repartition(7)
    got = [(r["row_id"], r["v"], r["i"]) for r in rows.numbered(df, "v", "i").orderBy("row_id").collect()]
    assert got == [(n, v, i) for n, (v, i) in enumerate(sorted(values))]
    assert rows.numbered(df.limit(0), "v").count() == 0


def test_nulls_empty_tables_and_wrong_lengths(spark, tmp_path):
    kind = "row_id long, seq string, targets array<int>"
    rows.write(spark.createDataFrame([(0, None, None)], kind), str(tmp_path / "a"), 4, 3)
    assert collected(rows.read(spark, str(tmp_path / "a"), 4, 3)) == [(0, [[0.25] * 4] * 4, [0, 0, 0])]
    rows.write(spark.createDataFrame([], kind), str(tmp_path / "b"), 4, 3)
    assert collected(rows.read(spark, str(tmp_path / "b"), 4, 3)) == []
    with pytest.raises(Exception, match="4 symbols"):
        rows.write(spark.createDataFrame([(0, "ACG", [0, 0, 0])], kind), str(tmp_path / "c"), 4, 3)
    with pytest.raises(ValueError, match="do not fit"):
        rows.window(10, 8, 3)
