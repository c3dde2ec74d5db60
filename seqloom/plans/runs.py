"""End-to-end runs: regions or variants in, scores out; and the evaluation of scored samples.

Each run composes the readers, windows, scorers and writers of the library; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import metrics, prep, scores, sequences, variants
from seqloom.sources import fasta, readers, writers


def letter_shares(symbols: str = "ACGT") -> Callable[[pd.Series], pd.Series]:
    """A scorer that needs no training: the share of each symbol in the sequence."""

    def score(seqs: pd.Series) -> pd.Series:
        upper = pc.utf8_upper(pa.array(seqs, pa.string()))
        length = np.maximum(pc.utf8_length(upper).to_numpy(), 1)
        shares = np.stack([pc.count_substring(upper, s).to_numpy() / length for s in symbols], axis=1)
        return pd.Series(list(shares), index=seqs.index)

    return score


def predict_windows(windows: DataFrame, sequence_table: DataFrame, scorer: Callable) -> DataFrame:
    """The windows (name, start, end, strand and any ids) with seq and prediction; windows out of bounds are left out.

    ``sequence_table`` has name and seq, or is a table of FASTA records (``fasta.index``). Windows meet pieces of sequences, never whole ones.
    """
    return scores.predict(fetched(windows, sequence_table).filter("seq <> ''"), scorer)


def fetched(windows: DataFrame, sequence_table: DataFrame) -> DataFrame:
    if "bytes_per_line" in sequence_table.columns:
        return fasta.fetch(windows, sequence_table)
    longest = windows.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    chunk = max(sequences.CHUNK, longest)
    return sequences.fetch_chunked(windows, sequences.chunked(sequence_table, longest, chunk), chunk)


def predict_regions(spark: SparkSession, bed: str, sequence_table: DataFrame, length: int, scorer: Callable, features: Sequence[str], target: str) -> None:
    """Regions of a BED file in; a score table at ``target`` and the rejected lines at ``target``.NA out."""
    sizes = sequence_table if "length" in sequence_table.columns else sequence_table.select("name", F.length("seq").alias("length"))
    regions, bad = readers.prediction_regions(spark, bed, sizes, length)
    writers.score_text(predict_windows(regions, sequence_table, scorer), target, ["line", "name", "start", "end", "strand"], "prediction", list(features), ["line"])
    writers.rejected(bad, target)


def variant_effects(rows: DataFrame, sequence_table: DataFrame, length: int, scorer: Callable, wanted: Sequence[str] = ("diffs",)) -> DataFrame:
    """Variants (chrom, pos, ref, alt, strand and any ids) with ref and alt predictions and an array for each wanted score."""
    both = variants.windows(rows, sequence_table, length)
    both = scores.predict_both(both, scorer, ("ref_seq", "alt_seq"), ("ref_prediction", "alt_prediction"))
    for name in scores.chosen(wanted):
        both = both.withColumn(name, scores.vector(F.col("ref_prediction"), F.col("alt_prediction"), name))
    return both


def variant_file_effects(spark: SparkSession, vcf: str, sequence_table: DataFrame, length: int, scorer: Callable, features: Sequence[str], target: str, wanted: Sequence[str] = ("diffs",)) -> None:
    """Variants of a VCF file in; a table ``target``_<score> for each wanted score and the rejected lines at ``target``.NA out."""
    good, bad = readers.vcf(spark, vcf, sequence_table, length)
    effects = variant_effects(good, sequence_table, length, scorer, wanted)
    ids = ["chrom", "pos", "name", "ref", "alt", "strand", "ref_match", "contains_unk"]
    for name in scores.chosen(wanted):
        writers.score_text(effects, f"{target}_{name}", ids, name, list(features))
    writers.rejected(bad, target)


def evaluate(samples: DataFrame, features: Sequence[str], least_positives: int = 1) -> DataFrame:
    """Feature, feature_ix, positives, roc_auc and average_precision of the wanted features, in their order.

    ``samples`` has feature, id, target and score. A feature with fewer positives has no metrics.
    """
    kept = prep.ordered_features(samples, list(features))
    table = kept.select("feature", "feature_ix").distinct().join(metrics.positives(kept), "feature", "left")
    clear = kept.drop("feature_ix")
    table = table.join(metrics.roc_auc(clear), "feature", "left").join(metrics.average_precision(clear), "feature", "left")
    enough = F.col("positives") >= least_positives
    return table.withColumns({m: F.when(enough, F.col(m)) for m in ("roc_auc", "average_precision")})


#: What a job specification can name (see ``jobs.Registry``).
OPERATIONS: Mapping[str, Callable] = {
    "letter_shares": letter_shares, "predict_regions": predict_regions, "variant_file_effects": variant_file_effects, "evaluate": evaluate,
}
