"""FASTA by byte ranges equals reading whole records, across lines, ranges and blocks."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.operators import sequences
from seqloom.sources import fasta


def write(tmp_path, name, records, width, newline="\n", end=True):
    text = ""
    for head, seq in records:
        lines = [seq[i : i + width] for i in range(0, len(seq), width)] if width else [seq]
        text += ">" + head + newline + newline.join(lines) + (newline if seq else "")
    (tmp_path / name).write_bytes((text if end else text.rstrip("\r\n")).encode())
    return [(h.split()[0], s) for h, s in records]


@pytest.fixture(scope="module")
def records():
    rng = random.Random(2)
    seq = lambda n: "".join(rng.choice("ACGTNacgt") for _ in range(n))
    return [("chr2 the second", seq(700)), ("chr1", seq(61)), ("empty", ""), ("chr10 x", seq(1)), ("chrX|" + "y" * 90, seq(120)), ("last", seq(59))]


@pytest.mark.parametrize(("size", "newline"), [(7, "\n"), (64, "\r\n")])
def test_index_and_windows(spark, tmp_path, records, size, newline):
    folder = tmp_path / "f"
    folder.mkdir()
    known = write(folder, "a.fa", records, 60, newline)
    known += write(folder, "b.fa", [("one", "ACGT" * 500), ("two more", "TTG")], 0, newline, end=False)
    table = fasta.index(spark, str(folder), size)
    got = table.orderBy("file", "record").collect()
    assert [(r["name"], r["length"]) for r in got] == [(n, len(s)) for n, s in known]
    assert [r["record"] for r in got] == [*range(6), 0, 1] and all(r["regular"] for r in got)
    assert got[0]["bases_per_line"] == 60 and got[0]["bytes_per_line"] == 60 + len(newline) and got[6]["bases_per_line"] == 2000
    rng = random.Random(4)
    windows = []
    for name, s in [*known, ("unknown", "A" * 50)]:
        for _ in range(12):
            a = rng.randrange(-5, len(s) + 5)
            windows.append((name, a, a + rng.randrange(-1, 130), rng.choice("+-.")))
    w = spark.createDataFrame(windows, "name string, start long, end long, strand string")
    whole = spark.createDataFrame(known, "name string, seq string")
    for padded in (False, True):
        want = sequences.fetch(w, whole, padded).select("name", "start", "end", "strand", "seq")
        assert sorted(map(tuple, fasta.fetch(w, table, padded, block=1 << 16 if padded else 16).collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in fasta.catalogue(table).collect()] == sorted((n, len(s)) for n, s in known)


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_uneven_lines_are_seen(spark, tmp_path, size):
    (tmp_path / "x.fa").write_text(">ok\nACGT\nACGT\nAC\n\n>short\nACGT\nAC\nACGT\n>long\nACGT\nACGTA\n>blank\nACGT\n\nACGT\n>twice\nACGT\nAC\nA\n>open\nACGT\nACGTAC")
    table = fasta.index(spark, str(tmp_path / "x.fa"), size)
    assert {r["name"]: r["regular"] for r in table.collect()} == {"ok": True, "short": False, "long": False, "blank": False, "twice": False, "open": False}
    w = spark.createDataFrame([("ok", 3, 9, "+")], "name string, start long, end long, strand string")
    assert fasta.fetch(w, table).first()["seq"] == "TACGTA"
    with pytest.raises(PySparkException, match="unequal length in short"):
        fasta.fetch(w.withColumn("name", F.lit("short")), table).collect()


def test_only_touched_blocks_are_read(spark, tmp_path):
    write(tmp_path, "g.fa", [("big", "ACGTACGTAC" * 20000)], 50)
    table = fasta.index(spark, str(tmp_path / "g.fa"), 10000)
    w = spark.createDataFrame([("big", 1000 + i, 1100 + i, "+") for i in range(50)] + [("big", 150000, 150100, "-")], "name string, start long, end long, strand string")
    rows, size, reach = fasta.touched(w, table, block=1000)
    assert (size, reach) == (1000, 102) and rows.select("_block").distinct().count() == 2
    assert rows.select("_block").distinct().count() * size < 0.02 * (tmp_path / "g.fa").stat().st_size
    assert {r["seq"] for r in fasta.fetch(w, table, block=1000).filter("start = 1000 or start = 150000").collect()} == {"ACGTACGTAC" * 10, "GTACGTACGT" * 10}
