"""Published golden values of labels, retrieval and encodings."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import alphabet as A
from seqloom.operators import intervals, prep, sequences

NAMES = ["CTCF", "eGFP-FOS", "GABP", "Pbx3", "Pol2", "TBP"]
SETS = {
    "1": [(16110, 16190, "CTCF"), (16128, 16158, "CTCF"), (16149, 16239, "CTCF")],
    "2": [(91128, 91358, "CTCF"), (91130, 91239, "CTCF"), (91156, 91310, "CTCF")],
    "3": [(8533, 8817, "eGFP-FOS"), (8541, 8651, "GABP"), (8574, 8629, "Pol2"), (8619, 9049, "CTCF"), (8620, 8680, "TBP"), (8645, 8720, "TBP")],
}


@pytest.mark.parametrize(
    ("query", "thresholds", "expected"),
    [
        (("7", 10, 211), 0.5, [0] * 6), (("1", 16100, 16350), 0.5, [1, 0, 0, 0, 0, 0]), (("2", 91027, 91228), 0.51, [0] * 6),
        (("3", 8619, 8719), 0.5, [1, 1, 0, 0, 0, 1]), (("3", 8619, 8719), [0.5, 0.0, 0.0, 0.0, 0.0, 1.0], [1, 1, 1, 0, 1, 0]),
    ],
)
def test_labels(spark, query, thresholds, expected):
    q = spark.createDataFrame([(0, *query)], "id int, chrom string, qs int, qe int")
    f = spark.createDataFrame([(c, *r) for c, rows in SETS.items() for r in rows], "chrom string, fs int, fe int, feature string")
    given = thresholds if isinstance(thresholds, list) else [thresholds] * 6
    names = spark.createDataFrame(list(zip(NAMES, given, strict=True)), "feature string, threshold float")
    got = {r["feature"]: r["label"] for r in intervals.label(q, f, names, ["id"]).collect()}
    assert [got[n] for n in NAMES] == expected


def test_threshold_forms():
    assert prep.thresholds(NAMES, {"default": 0.5, "CTCF": 0, "Pol2": 0.15}) == list(zip(NAMES, [0, 0.5, 0.5, 0.5, 0.15, 0.5], strict=True))
    assert dict(prep.thresholds(NAMES, lambda f: {"Pbx3": 0.3, "CTCF": 0.4}.get(f, 0.5)))["Pbx3"] == 0.3
    assert prep.thresholds(["a"], None) == [("a", None)] and prep.thresholds(["a"], 2) == [("a", 0.0)]


def test_retrieval(spark):
    lengths = {"chr1": 104, "chr2": 16, "chr3": 64, "chr4": 8}
    table = spark.createDataFrame([(n, ("AGCTTCCA" * 20)[:k]) for n, k in lengths.items()], "name string, seq string")
    rows = [("chr1", 0, 14, "+"), ("chr2", 17, 20, "+"), ("chr4", 2, 10, "-")]
    w = spark.createDataFrame(rows, "name string, start int, end int, strand string")
    assert {r["name"]: r["seq"] for r in sequences.fetch(w, table).collect()} == {"chr1": "AGCTTCCAAGCTTC", "chr2": "", "chr4": ""}
    assert [tuple(r) for r in sequences.catalogue(table).collect()] == sorted(lengths.items())


def test_protein_retrieval(spark):
    letters = A.PROTEIN.symbols
    table = spark.createDataFrame([("prot0", letters + "X" + letters), ("prot1", letters)], "name string, seq string")
    w = spark.createDataFrame([("prot0", 22, 42), ("prot0", 55, 59), ("prot0", 0, 42), ("prot0", 10000, 100001)], "name string, start int, end int")
    got = {(r["start"], r["end"]): r["seq"] for r in sequences.protein_fetch(w, table).collect()}
    assert got[22, 42] == "RNDCEQGHILKMFPSTWYV" and got[55, 59] == "" == got[10000, 100001] and len(got[0, 42]) == 41
    row = table.filter("name = 'prot1'").select(A.one_hot(F.col("seq"), A.PROTEIN).alias("e")).first()["e"]
    assert row == [[float(i == j) for j in range(20)] for i in range(20)]
