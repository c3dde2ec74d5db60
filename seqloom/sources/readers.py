"""Readers of sequence, interval, variant and score files. Schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import sequences, variants
from seqloom.sources import lines as numbered_lines

BED3 = "chrom string, start int, end int"
FEATURES = "chrom string, start int, end int, feature string"
STRANDED = "chrom string, start int, end int, strand string, feature string"
NARROW_PEAK = "chrom string, start int, end int, name string, score int, strand string, signal double, p double, q double, peak int"
VARIANT_IDS = ("chrom", "pos", "name", "ref", "alt", "strand", "ref_match", "contains_unk")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", comment="#", mode="PERMISSIVE")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Name, seq. Each record is one row of the reader, so a file is split by Spark and never read whole."""
    raw = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, instr(value, '\n') + 1)")
    return raw.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_replace(body, r"\s+", "").alias("seq"))


def bed(spark: SparkSession, path: str, stranded: bool = False) -> DataFrame:
    """Interval features, with or without a strand column."""
    return _csv(spark, path, STRANDED if stranded else FEATURES)


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """Three-column intervals."""
    return _csv(spark, path, BED3)


def labelled_bed(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """Samples of 3 (no labels), 4 (labels) or 5 (strand, labels) columns; labels are a ``;``-joined list."""
    cols = F.split("value", "\t")
    row = spark.read.text(path).filter(F.trim("value") != "").select(cols.alias("c"))
    n = F.size("c")
    return row.select(
        F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).cast("int").alias("start"), F.get("c", F.lit(2)).cast("int").alias("end"),
        F.when(n == 5, F.get("c", F.lit(3))).otherwise("+").alias("strand"),
        F.when(n == 5, F.get("c", F.lit(4))).when(n == 4, F.get("c", F.lit(3))).otherwise("").alias("positives"),
    )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A list, one name per line, with its line number from 0."""
    return numbered_lines.numbered(spark, path).filter(F.trim("value") != "").select("line", F.col("value").alias("feature"))


def vcf(spark: SparkSession, path: str, sequences_table: DataFrame | None = None, length: int | None = None, require_strand: bool = False, strand_column: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Variants, and the rows that do not hold (unknown chromosome, out of bounds, malformed).

    A ``#CHROM`` header has to name the five first columns. Without a sequence table only the form is checked.
    """
    raw = spark.read.text(path)
    header = raw.filter(F.col("value").startswith("#CHROM")).head(1)
    if header and header[0]["value"].split("\t")[:5] != ["#CHROM", "POS", "ID", "REF", "ALT"]:
        raise ValueError("the header must name CHROM, POS, ID, REF and ALT")
    rows = raw.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("c", F.split("value", "\t"))
    add_chr = False
    if sequences_table is not None:
        add_chr = sequences_table.filter(~F.col("name").startswith("chr")).isEmpty()
    strand = F.get("c", F.lit(strand_column)) if strand_column is not None else F.lit("+" if not require_strand else ".")
    parsed = rows.select(
        "value", variants.chromosome(F.get("c", F.lit(0)), add_chr).alias("chrom"), F.get("c", F.lit(1)).try_cast("int").alias("pos"), F.get("c", F.lit(2)).alias("name"),
        F.get("c", F.lit(3)).alias("ref"), F.get("c", F.lit(4)).alias("alt"), F.coalesce(strand, F.lit(".")).alias("strand"),
    )
    ok: Column = F.col("pos").isNotNull() & F.col("alt").isNotNull()
    if require_strand:
        ok = ok & (F.col("strand") != ".")
    if sequences_table is not None:
        sizes = sequences_table.select(F.col("name").alias("chrom"), F.length("seq").alias("_len"))
        parsed = parsed.join(sizes, "chrom", "left")
        ok = ok & F.col("_len").isNotNull()
        if length is not None:
            centre = F.col("pos") + F.floor(F.length("ref") / 2)
            start, end = sequences.around_prediction(centre, length)
            ok = ok & F.coalesce(sequences.in_bounds(start, end, F.col("_len")), F.lit(False))
    flagged = parsed.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = variants.exploded(flagged.filter("_ok").select("chrom", "pos", "name", "ref", "alt", "strand"))
    return good, flagged.filter(~F.col("_ok")).select("value")


def prediction_regions(spark: SparkSession, path: str, sizes: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Regions of a BED file, re-centred to ``length``, with the number of their line; and the malformed lines."""
    text = numbered_lines.numbered(spark, path).filter(F.trim("value") != "").select("line", F.col("value").alias("feature"))
    row = text.withColumn("c", F.split("feature", "\t"))
    good = (F.size("c") >= 3) & F.get("c", F.lit(1)).rlike("^[0-9]+$") & F.get("c", F.lit(2)).rlike("^[0-9]+$")
    parsed = row.withColumn("name", F.get("c", F.lit(0))).join(sizes.select("name", "length"), "name", "left")
    parsed = parsed.withColumn("_ok", F.coalesce(good & F.col("length").isNotNull(), F.lit(False)))
    middle = F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)
    start, end = sequences.around_prediction(middle, length)
    kept = parsed.filter("_ok").select("line", "name", F.get("c", F.lit(1)).cast("int").alias("a"), F.get("c", F.lit(2)).cast("int").alias("b"), F.get("c", F.lit(5)).alias("s"))
    kept = kept.select("line", "name", start.alias("start"), end.alias("end"), F.when(F.col("s").isin("+", "-"), F.col("s")).otherwise("+").alias("strand"))
    return kept, parsed.filter(~F.col("_ok")).select(F.col("feature").alias("value"))


def score_table(spark: SparkSession, path: str) -> DataFrame:
    """A score file with a header; every column stays a string and ``NA`` stays ``NA``."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, nullValue="\u0000")


def variant_scores(spark: SparkSession, path: str) -> DataFrame:
    """Variant scores in long form; the columns that name a variant are taken by name, whatever their number."""
    wide = score_table(spark, path)
    ids = [c for c in wide.columns if c in VARIANT_IDS]
    features = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(ids, features, "feature", "score")
    return long.withColumn("score", F.col("score").try_cast("double"))


def narrow_peaks(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """The intervals and strand of a peak file, under a feature's name."""
    return _csv(spark, path, NARROW_PEAK).select("chrom", "start", "end", "strand", F.lit(feature).alias("feature"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """File, and a map of its ``key=value;`` fields."""
    c = F.split("value", "\t")
    fields = F.str_to_map(F.regexp_replace(F.get(c, F.lit(1)), r";\s*", ";"), F.lit(";"), F.lit("="))
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(c, F.lit(0)).alias("file"), fields.alias("fields"))


def genes(spark: SparkSession, path: str, levels: tuple[str, ...] = ("1", "2")) -> DataFrame:
    """Protein-coding genes of the given levels of a GTF file, as intervals from 0."""
    c = F.split("value", "\t")
    row = spark.read.text(path).filter(~F.col("value").startswith("#")).select(c.alias("c"))
    field = lambda k: F.regexp_extract(F.get("c", F.lit(8)), rf'(?:^|;)\s*{k}\s+"?([^";]+)"?', 1)
    row = row.filter((F.get("c", F.lit(2)) == "gene") & (field("gene_type") == "protein_coding") & field("level").isin(*levels))
    return row.select(
        F.get("c", F.lit(0)).alias("chrom"), (F.get("c", F.lit(3)).cast("int") - 1).alias("start"), F.get("c", F.lit(4)).cast("int").alias("end"),
        F.get("c", F.lit(6)).alias("strand"), field("gene_name").alias("gene"),
    )


def matrix(spark: SparkSession, path: str, sequence_axis: tuple[int, int] = (0, 1)) -> DataFrame:
    """row_id, seq (rows of numbers) and, where there, tgt, from Parquet; axes (1, 0) are transposed."""
    df = spark.read.parquet(path)
    if sequence_axis == (1, 0):
        columns = F.sequence(F.lit(0), F.size(F.get("seq", F.lit(0))) - 1)
        df = df.withColumn("seq", F.transform(columns, lambda j: F.transform("seq", lambda row: F.get(row, j))))
    return df
