"""Retrieval from sequence tables: chunked storage, bounds, windows, catalogues.

A sequence table has name, seq, length. Long sequences are stored as overlapping chunks, so that a
window touches one chunk only and no row grows with a chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.alphabet import DNA, Alphabet, one_hot, reverse_complement

CHUNK = 1 << 16


def catalogue(sequences: DataFrame) -> DataFrame:
    """Names and lengths in name order."""
    return sequences.select("name", F.length("seq").alias("length")).orderBy("name")


def chunked(sequences: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """Name, length, chunk_no, chunk_start, piece; pieces overlap by the longest window."""
    starts = F.sequence(F.lit(0), F.greatest((F.length("seq") - 1), F.lit(0)), F.lit(chunk))
    at = sequences.select("name", "seq", F.length("seq").alias("length"), F.posexplode(starts).alias("chunk_no", "chunk_start"))
    return at.select("name", "length", "chunk_no", "chunk_start", F.substring("seq", F.col("chunk_start") + 1, F.lit(chunk + window)).alias("piece"))


def in_bounds(start: Column, end: Column, length: Column, padded: bool = False) -> Column:
    """P1, without the blacklist: start below end and length, end above 0; inside the sequence unless padded."""
    ok = (start < length) & (start < end) & (end > 0)
    return ok if padded else ok & (start >= 0) & (end <= length)


def protein_in_bounds(start: Column, end: Column, length: Column) -> Column:
    """The looser protein rule."""
    return (start <= length) & (end <= length + 1) & (start >= 0)


def _substring(seq: Column, offset: Column, start: Column, end: Column) -> Column:
    return F.substring(seq, start - offset + 1, F.greatest(end - start, F.lit(0)))


def on_strand(plain: Column, alphabet: Alphabet = DNA) -> Column:
    """``-`` takes the reverse complement, ``.`` counts as ``+``, anything else raises."""
    turned = F.when(F.col("strand") == "-", reverse_complement(plain, alphabet)).when(F.col("strand").isin("+", "."), plain)
    return turned.otherwise(F.raise_error(F.concat(F.lit("strand must be +, - or .: "), F.col("strand"))))


def fetch(windows: DataFrame, sequences: DataFrame, padded: bool = False, alphabet: Alphabet = DNA) -> DataFrame:
    """Windows (name, start, end, strand) with seq; the empty string where the bounds fail.

    ``-`` takes the reverse complement, ``.`` counts as ``+``, anything else raises once the bounds hold.
    Padding is added after the strand was handled, on the side the coordinates name.
    """
    joined = windows.join(sequences.select("name", F.col("seq").alias("_seq"), F.length("seq").alias("_len")), "name", "left")
    start, end = F.greatest("start", F.lit(0)), F.least("end", "_len")
    plain = _substring(F.col("_seq"), F.lit(0), start, end)
    turned = on_strand(plain, alphabet)
    unknown = F.lit(alphabet.unknown)
    left = F.repeat(unknown, F.greatest(-F.col("start"), F.lit(0)).cast("int"))
    right = F.repeat(unknown, F.greatest(F.col("end") - F.col("_len"), F.lit(0)).cast("int"))
    found = F.concat(left, turned, right) if padded else turned
    valid = F.coalesce(in_bounds(F.col("start"), F.col("end"), F.col("_len"), padded), F.lit(False))
    return joined.withColumn("seq", F.when(valid, found).otherwise(F.lit(""))).drop("_seq", "_len")


def fetch_chunked(windows: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Windows inside the bounds from chunked storage: an equi-join on (name, chunk), on any size of sequence."""
    w = windows.withColumn("chunk_no", F.floor(F.col("start") / chunk).cast("int"))
    joined = w.join(chunks, ["name", "chunk_no"], "left")
    valid = F.coalesce(in_bounds(F.col("start"), F.col("end"), F.col("length")), F.lit(False))
    plain = _substring(F.col("piece"), F.col("chunk_start"), F.col("start"), F.col("end"))
    return joined.withColumn("seq", F.when(valid, on_strand(plain)).otherwise(F.lit(""))).drop("piece", "chunk_start", "chunk_no", "length")


def protein_fetch(windows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Protein windows; the empty string outside the bounds, an error for unknown names."""
    joined = windows.join(sequences.select("name", F.col("seq").alias("_seq")), "name", "left")
    known = F.when(F.col("_seq").isNull(), F.raise_error(F.concat(F.lit("unknown sequence "), F.col("name")))).otherwise(F.col("_seq"))
    valid = protein_in_bounds(F.col("start"), F.col("end"), F.length(known))
    return joined.withColumn("seq", F.when(valid, _substring(known, F.lit(0), F.col("start"), F.col("end"))).otherwise("")).drop("_seq")


def encoded(windows: DataFrame, alphabet: Alphabet = DNA) -> DataFrame:
    """Encoding, and whether an unknown symbol stands in the sequence."""
    return windows.withColumn("encoding", one_hot(F.col("seq"), alphabet)).withColumn("contains_unk", F.contains("seq", F.lit(alphabet.unknown)))


def around(position: Column, length: int, center: int | tuple[int, int] | None = None) -> tuple[Column, Column]:
    """The sampling window round a position; ``center`` is a bin's size or its [start, end]."""
    radius = length // 2
    left, right = radius, radius + length % 2
    if isinstance(center, tuple):
        left, right = left - center[0], right - (length - center[1])
    elif center is not None:
        if center % 2 != length % 2:
            raise ValueError("window and bin must be both even or both odd")
        left, right = center // 2, center // 2 + center % 2
    return position - left, position + right


def around_prediction(position: Column, length: int) -> tuple[Column, Column]:
    """The prediction window; an odd length widens the start."""
    return position - (length // 2 + length % 2), position + length // 2


def from_midpoint(start: Column, end: Column, length: int) -> tuple[Column, Column]:
    """A fixed window round a region's middle."""
    middle = start + F.floor((end - start) / 2)
    return middle - length // 2, middle + (length + 1) // 2
