"""Variants: normalised rows, reference and alternate windows, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.alphabet import DNA, reverse_complement
from seqloom.operators.sequences import CHUNK, around_prediction, chunked, in_bounds


def chromosome(name: Column, add_chr: bool | Column = False) -> Column:
    """CHR to chr, chr in front where the reference has it everywhere, chrMT and MT to chrM."""
    name = F.when(name.startswith("CHR"), F.concat(F.lit("chr"), F.substring(name, 4, 1 << 20))).otherwise(name)
    add = F.lit(add_chr) if isinstance(add_chr, bool) else add_chr
    name = F.when(add & ~name.startswith("chr"), F.concat(F.lit("chr"), name)).otherwise(name)
    return F.when(name.isin("MT", "chrMT"), F.lit("chrM")).otherwise(name)


def exploded(rows: DataFrame) -> DataFrame:
    """One row per alternative, in order. ``-`` as reference is empty; ``.`` separates alternatives like ``,``."""
    ref = F.when(F.col("ref") == "-", "").otherwise(F.col("ref"))
    alts = F.split(F.regexp_replace("alt", r"\.", ","), ",")
    return rows.withColumn("ref", ref).select(*[c for c in rows.columns if c != "alt"], F.posexplode(alts).alias("alt_ix", "alt"))


def stranded(rows: DataFrame) -> DataFrame:
    """Rows that name a strand."""
    return rows.filter(F.col("strand") != ".")


def _canonical(seq: Column) -> Column:
    """Case and the kind of unknown symbol do not matter where encodings are compared."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def windows(variants: DataFrame, sequences: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """Variants (chrom, pos, ref, alt, strand) with ref_seq, alt_seq, ref_match and contains_unk.

    The window's centre is pos + len(ref) // 2. Substitutions and insertions are spliced into the window and the latter
    truncated to its centre; deletions are rebuilt from the reference sequence, cut at pos + 1; an
    alternative longer than the window is truncated alone. The given reference allele then overrides the
    reference window, and the strand comes last. Variants outside the bounds are left out.

    Sequences are read as overlapping chunks, each wide enough for a variant's surroundings: a variant meets one
    chunk by an equi-join, and never carries a whole chromosome.
    """
    longest = variants.agg(F.max(F.length("ref"))).first()[0] or 0
    reach = length + longest + 2
    n_ref, n_alt = F.length("ref"), F.length("alt_clean")
    rows = variants.withColumn("alt_clean", F.when(F.col("alt").isin("*", "-"), "").otherwise(F.upper("alt"))).withColumn("ref", F.upper("ref"))
    start, end = around_prediction(F.col("pos") + _half(n_ref), length)
    rows = rows.withColumn("name", F.col("chrom")).withColumn("start", start).withColumn("end", end)
    rows = rows.withColumn("chunk_no", F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / chunk).cast("int"))
    chunks = chunked(sequences.select("name", "seq"), 3 * reach + length, chunk).withColumnRenamed("length", "_length")
    got = rows.join(chunks, ["name", "chunk_no"]).filter(in_bounds(F.col("start"), F.col("end"), F.col("_length")))

    def stretch(a, b):
        """The reference from a to b, clipped to the sequence."""
        a = F.greatest(a, F.lit(0))
        return F.substring("piece", a - F.col("chunk_start") + 1, F.greatest(b - a, F.lit(0)))

    got = got.withColumn("window", stretch(F.col("start"), F.col("end")))
    # Where the reference allele starts in the window.
    middle = F.lit(length // 2 - (1 - length % 2))
    at = middle - _half(n_ref)
    spliced = F.concat(F.substring("window", F.lit(1), at), F.col("alt_clean"), F.substring("window", at + n_ref + 1, F.lit(length)))
    trim = F.floor((F.length(spliced) - length) / 2).cast("int")
    inserted = F.substring(spliced, trim + 1, F.lit(length))
    # A deletion: as much as is missing comes from the flanks, the odd symbol from the right.
    need_left = _half(F.lit(length) - n_alt)
    need_right = F.lit(length) - n_alt - need_left
    cut = F.col("pos") + 1
    deleted = F.concat(stretch(cut - need_left, cut), F.col("alt_clean"), stretch(cut + n_ref, cut + n_ref + need_right))
    long_alt = F.substring("alt_clean", _half(n_alt - length) + 1, F.lit(length))
    alt_seq = F.when(n_alt > length, long_alt).when(n_alt == n_ref, spliced).when(n_alt > n_ref, inserted).otherwise(deleted)
    # Does the sequence hold the given reference?
    here = F.when(n_ref < length, F.substring("window", at + 1, n_ref)).otherwise(F.col("window"))
    given = F.when(n_ref < length, F.col("ref")).otherwise(F.substring("ref", _half(n_ref - length) + 1, F.lit(length)))
    override = F.when(n_ref < length, F.concat(F.substring("window", F.lit(1), at), F.col("ref"), F.substring("window", at + n_ref + 1, F.lit(length)))).otherwise(given)
    made = got.withColumn("alt_seq", alt_seq).withColumn("ref_match", _canonical(here) == _canonical(given)).withColumn("ref_seq", F.upper(override))
    turned = [F.when(F.col("strand") == "-", reverse_complement(_canonical(F.col(c)), DNA)).otherwise(F.upper(c)).alias(c) for c in ("ref_seq", "alt_seq")]
    keep = [c for c in variants.columns if c not in ("strand", "ref")]
    return made.select(*keep, "ref", "strand", *turned, "ref_match", F.contains("window", F.lit("N")).alias("contains_unk"))
