import pytest
from pyspark.sql import functions as F

from seqloom.operators import mutagenesis, sampling, variants
from seqloom.sources import readers, writers


def muts(spark, seq, **options):
    df = spark.createDataFrame([("s", seq)], "name string, seq string")
    return mutagenesis.mutations(df, **options)


@pytest.mark.parametrize(("seq", "options", "rows"), [("ATCCG", {}, 15), ("ATC", {"n": 2}, 27), ("ATCG", {"n": 2, "start": 1, "end": 3}, 9), ("NA", {}, 7), ("A", {"n": 2}, 0)])
def test_mutation_counts(spark, seq, options, rows):
    assert muts(spark, seq, **options).count() == rows


def test_first_mutations(spark):
    got = muts(spark, "ATCCG").limit(4).select(F.col("muts")[0]["pos"], F.col("muts")[0]["alt"]).collect()
    assert [tuple(r) for r in got] == [(0, "C"), (0, "G"), (0, "T"), (1, "A")]


def test_argument_rules():
    for bad in [(5, -1, 3, 1), (5, 3, 2, 1), (5, 0, 6, 1), (5, 0, 5, 6), (5, 0, 5, 0)]:
        with pytest.raises(ValueError):
            mutagenesis.check_arguments(*bad)


def test_insertion_and_reference_mismatch(spark):
    seqs = spark.createDataFrame([("chr1", "ACGTACGTACGTACGTACGT")], "name string, seq string")
    v = spark.createDataFrame([("chr1", 10, "G", "GTT", "+"), ("chr1", 10, "A", "C", "-"), ("chr1", 1, "A", "C", "+")], "chrom string, pos int, ref string, alt string, strand string")
    got = variants.windows(v, seqs, 6).collect()
    assert len(got) == 2  # the last one's window leaves the sequence
    assert all(len(r["ref_seq"]) == len(r["alt_seq"]) == 6 for r in got)


def test_vcf_reader(spark, tmp_path):
    p = tmp_path / "v.vcf"
    p.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n1\t5\ta\t-\tA,C\nCHR1\t6\tb\tG\t.\nchr9\t1\tc\tA\tC\nchr1\tx\td\tA\tC\n")
    seqs = spark.createDataFrame([("chr1", "A" * 30)], "name string, seq string")
    good, bad = readers.vcf(spark, str(p), seqs)
    assert sorted((r["name"], r["ref"], r["alt_ix"], r["alt"]) for r in good.collect()) == [("a", "", 0, "A"), ("a", "", 1, "C"), ("b", "G", 0, ""), ("b", "G", 1, "")]
    assert bad.count() == 2
    p.write_text("#CHROM\tWHERE\tID\tREF\tALT\n")
    with pytest.raises(ValueError):
        readers.vcf(spark, str(p))


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "NNAC")], "name string, seq string").coalesce(1)
    writers.fasta(df, str(tmp_path / "x.fa"))
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "x.fa")).collect())) == [("a", "ACGT"), ("b", "NNAC")]


def test_gtf_and_scores(spark, tmp_path):
    (tmp_path / "g.gtf").write_text('#h\nchr1\tx\tgene\t11\t20\t.\t+\t.\tgene_id "i"; gene_type "protein_coding"; gene_name "N"; level 1;\nchr1\tx\tgene\t1\t2\t.\t+\t.\tgene_type "lincRNA"; level 1;\n')
    assert [tuple(r) for r in readers.genes(spark, str(tmp_path / "g.gtf")).collect()] == [("chr1", 10, 20, "+", "N")]
    (tmp_path / "s.tsv").write_text("chrom\tpos\tname\tref\talt\tf1\tf2\nchr1\t1\tv\tA\tC\t0.5\tNA\n")
    got = {r["feature"]: r["score"] for r in readers.variant_scores(spark, str(tmp_path / "s.tsv")).collect()}
    assert got == {"f1": 0.5, "f2": None}


def test_draws_do_not_depend_on_layout(spark):
    parts = spark.range(50).select(F.col("id").alias("part"), (F.col("id") % 7).alias("len"))
    a = sampling.weighted_draws(parts, "part", F.col("len"), 500, 3)
    b = sampling.weighted_draws(parts.repartition(7), "part", F.col("len"), 500, 3)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, b.collect())) and len(rows) == 500
    assert all(0 <= r[2] < r[1] % 7 for r in rows)
