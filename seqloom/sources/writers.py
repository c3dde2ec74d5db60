"""Writers of scores, samples, rejected rows and sequences. Every writer writes in parallel, one file per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import metrics, scores
from seqloom.sources import lines


def score_text(df: DataFrame, path: str, ids: list[str], array: str, features: list[str], order: Sequence[str] = ()) -> None:
    """K1: ids and one column per feature, two decimals in scientific form; in the order of the input where ``order`` names its columns."""
    scores.wide_text(lines.in_order(df, *order) if order else df, ids, array, features).write.csv(path, sep="\t", header=True)


def score_matrix(df: DataFrame, path: str, ids: list[str], array: str, labels: bool = True) -> None:
    """K2, K8: row_id and scores in row order over all files, and the row labels (ids, as text, in the same order) at ``path``.row_labels."""
    ordered = lines.in_order(df.select("row_id", *ids, F.col(array).cast("array<double>").alias("scores")), "row_id")
    ordered.select("row_id", "scores").write.parquet(path)
    if labels:
        ordered.select(*ids).write.csv(f"{path}.row_labels", sep="\t", header=True, emptyValue="")


def both_alleles(df: DataFrame, path: str, ids: list[str], ref: str, alt: str) -> None:
    """K4: one dataset with a partition per allele, from one pass over the predictions."""
    pair = F.array(F.struct(F.lit("ref").alias("allele"), F.col(ref).alias("scores")), F.struct(F.lit("alt").alias("allele"), F.col(alt).alias("scores")))
    df.select(*ids, F.explode(pair).alias("x")).select(*ids, "x.*").write.partitionBy("allele").parquet(path)


def rejected(df: DataFrame, path: str) -> None:
    """K6: the input lines that were left out."""
    df.select("value").write.text(f"{path}.NA")


def samples_bed(df: DataFrame, path: str) -> None:
    """K5: chrom, start, end, strand and the positions of the positive labels."""
    df.select("chrom", "start", "end", "strand", "positives").write.csv(path, sep="\t", header=False, emptyValue="")


def performance(per_feature: DataFrame, path: str, names: list[str]) -> None:
    """K7: a short table."""
    metrics.performance_text(per_feature, names).coalesce(1).write.csv(path, sep="\t", header=True)


def fasta(df: DataFrame, path: str, width: int | None = None) -> None:
    """One record per row of (name, seq), in lines of ``width`` symbols where one is given."""
    seq = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    df.select(F.concat(F.lit(">"), F.col("name").cast("string"), F.lit("\n"), seq)).write.text(path)


def dataset(df: DataFrame, path: str, split: str = "split") -> None:
    """Samples by split; Parquet's own encodings pack the bits."""
    df.write.partitionBy(split).parquet(path)
