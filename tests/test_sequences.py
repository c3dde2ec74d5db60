import pytest
from pyspark.sql import functions as F

from seqloom.functions import alphabet as A
from seqloom.operators import sequences


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<int>'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_encode_and_decode(spark):
    q = [0.25] * 4
    e = one(spark, A.one_hot(F.col("s")), s="AnnUAtCa")
    a, c, t = [1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 0, 1.0]
    assert e == [a, q, q, q, a, t, c, a]
    assert one(spark, A.decode(A.one_hot(F.col("s"))), s="GnATNn") == "GNATNN"
    assert one(spark, A.one_hot(F.col("s")), s="") == []
    assert one(spark, A.decode(A.one_hot(F.col("s"), A.PROTEIN), A.PROTEIN), s="ARXaV") == "ARXXV"


@pytest.mark.parametrize("order", ["ACGT", "ATGC"])
def test_reverse_complement_encoding_matches_strings(spark, order):
    alphabet = A.DNA.ordered(order)
    s = F.col("s")
    got = one(spark, A.decode(A.reverse_complement_encoding(A.one_hot(s, alphabet), alphabet), alphabet), s="AACGTTN")
    assert got == one(spark, A.reverse_complement(s), s="AACGTTN") == "NAACGTT"


def test_reverse_complement_rejects_other_letters(spark):
    with pytest.raises(Exception, match="no complement"):
        one(spark, A.reverse_complement(F.col("s")), s="AXG")
    assert one(spark, A.allele_reverse_complement(F.col("s")), s="-") == "*"


def test_padding_and_truncation(spark):
    s = F.col("s")
    assert one(spark, A.pad_or_truncate(s, 7), s="acgt") == "NACGTNN"
    assert one(spark, A.pad_or_truncate(s, 2), s="acgta") == "CG"
    assert one(spark, A.pad_or_truncate(s, 4), s="acgt") == "acgt"


def test_bits_round_trip(spark):
    bits = [1, 0, 1, 1, 0, 0, 1, 0, 1, 1]
    packed = one(spark, A.pack_bits(F.col("b")), b=bits)
    assert packed == [0b10110010, 0b11000000]
    assert one(spark, A.unpack_bits(A.pack_bits(F.col("b")), 10), b=bits) == bits


def test_positions_round_trip(spark):
    assert one(spark, A.multi_hot(F.col("s"), 4), s="0;3") == [1, 0, 0, 1]
    assert one(spark, A.multi_hot(F.col("s"), 2), s="") == [0, 0]
    assert one(spark, A.positives(A.multi_hot(F.col("s"), 4)), s="3;1") == "1;3"


def test_out_of_bounds_is_empty_and_strand_is_checked_after_bounds(spark):
    table = spark.createDataFrame([("chr1", "ACGTNACG")], "name string, seq string")
    rows = [("chr1", -1, 3, "+"), ("chr1", 0, 9, "+"), ("chr1", 5, 5, "+"), ("chr2", 0, 2, "+"), ("chr1", 1, 4, "-"), ("chr1", 0, 9, "=")]
    w = spark.createDataFrame(rows, "name string, start int, end int, strand string")
    got = {(r["name"], r["start"], r["end"]): r["seq"] for r in sequences.fetch(w, table).collect()}
    assert got == {("chr1", -1, 3): "", ("chr1", 0, 9): "", ("chr1", 5, 5): "", ("chr2", 0, 2): "", ("chr1", 1, 4): "ACG"}
    with pytest.raises(Exception, match="strand must be"):
        sequences.fetch(w.filter("strand = '='").withColumn("end", F.lit(3)), table).collect()
    padded = spark.createDataFrame([("chr1", -2, 3, "-"), ("chr1", 6, 10, "+")], w.schema)
    assert sorted(r["seq"] for r in sequences.fetch(padded, table, padded=True).collect()) == ["CGNN", "NNCGT"][0:0] + sorted(["CGNN", "NNCGT"])


def test_geometry_checks_parity():
    with pytest.raises(ValueError):
        sequences.around(F.lit(5), 100, 3)
