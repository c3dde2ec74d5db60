"""Scores of reference and alternative predictions, scorers, and their written form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1e-24, 0.999999


def difference(ref: Column, alt: Column) -> Column:
    """X23."""
    return alt - ref


def absolute_difference(ref: Column, alt: Column) -> Column:
    """X24."""
    return F.abs(alt - ref)


def _odds(p: Column) -> Column:
    clamped = F.when(p == 0, LEAST).when(p >= 1, MOST).otherwise(p)
    return F.ln(clamped / (1 - clamped))


def logit_difference(ref: Column, alt: Column) -> Column:
    """Log odds of alt less those of ref; 0 and 1 are clamped, in the score alone."""
    return _odds(alt) - _odds(ref)


HANDLERS: dict[str, Callable[[Column, Column], Column]] = {
    "abs_diffs": absolute_difference, "diffs": difference, "logits": logit_difference, "predictions": lambda ref, alt: alt,
}


def chosen(names) -> list[str]:
    """The legal ones among the names, sorted; an error if there is none."""
    found = sorted(set(names) & set(HANDLERS))
    if not found:
        raise ValueError(f"no score among {sorted(HANDLERS)}: {names}")
    return found


def both_strands(forward: Column, backward: Column, mode: str = "mean") -> Column:
    """Mean or maximum of the outputs for a sequence and its reverse complement."""
    if mode not in ("mean", "max"):
        raise ValueError(f"mode must be mean or max: {mode}")
    return (forward + backward) / 2 if mode == "mean" else F.greatest(forward, backward)


def vector(values: Column, other: Column, score: str) -> Column:
    """A score for each feature of two prediction arrays."""
    return F.zip_with(values, other, HANDLERS[score])


def convolution_scorer(filters: np.ndarray, bias: np.ndarray, symbols: str = "ACGT") -> Callable[[pd.Series], pd.Series]:
    """A built-in model: the best match of each filter (features, symbols, width), then a sigmoid."""
    features, n, width = filters.shape
    lookup = np.full((256, n), 1.0 / n, dtype=np.float64)
    for i, s in enumerate(symbols):
        lookup[ord(s)] = lookup[ord(s.lower())] = np.eye(n)[i]

    def score(seqs: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(seqs), index=seqs.index, dtype=object)
        for size, group in seqs.groupby(seqs.str.len()):
            got = np.full((len(group), features), 0.5)
            for at in range(0, len(group) if size >= width else 0, 256):
                part = group.iloc[at : at + 256]
                raw = np.frombuffer("".join(part).encode("ascii", "replace"), dtype=np.uint8)
                rows = lookup[raw.reshape(len(part), int(size))]
                views = np.lib.stride_tricks.sliding_window_view(rows, width, axis=1)  # part, place, symbol, width
                best = np.tensordot(views, filters, axes=([2, 3], [1, 2])).max(axis=1) + bias
                got[at : at + 256] = 1 / (1 + np.exp(-best))
            for i, values in zip(group.index, got, strict=True):
                out.at[i] = values
        return out

    return score


def _once(scorer: Callable[[pd.Series], pd.Series], *columns: pa.Array) -> list[pa.Array]:
    """The scores of some columns of sequences, null where the sequence is; the scorer sees each distinct sequence once, and no null."""
    seqs = pa.chunked_array([c.cast(pa.string()) for c in columns]).combine_chunks().dictionary_encode()
    found = [] if not len(seqs.dictionary) else [np.asarray(x, dtype=np.float64) for x in scorer(pd.Series(seqs.dictionary.to_pylist(), dtype=object))]
    offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
    known = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0)))
    ends = np.cumsum([0, *map(len, columns)])
    return [known.take(seqs.indices.slice(a, b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def predict(df: DataFrame, scorer: Callable[[pd.Series], pd.Series], seq: str = "seq", out: str = "prediction") -> DataFrame:
    """Predictions as arrays, in Arrow batches; of each batch the scorer sees each distinct sequence once, and no null."""

    @F.arrow_udf("array<double>")
    def score(seqs: pa.Array) -> pa.Array:
        return _once(scorer, seqs)[0]

    return df.withColumn(out, score(F.col(seq)))


def predict_both(df: DataFrame, scorer: Callable[[pd.Series], pd.Series], seqs: tuple[str, str], outs: tuple[str, str]) -> DataFrame:
    """Two predictions per row from one pass over both sequences."""

    @F.arrow_udf("first array<double>, second array<double>")
    def score(first: pa.Array, second: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_once(scorer, first, second), ["first", "second"])

    scored = df.withColumn("_both", score(*map(F.col, seqs)))
    return scored.withColumns({outs[0]: F.col("_both.first"), outs[1]: F.col("_both.second")}).drop("_both")


def long_form(df: DataFrame, ids: list[str], array: str, features: list[str]) -> DataFrame:
    """One row per feature: ids, feature, score."""
    names = F.array(*[F.lit(f) for f in features])
    return df.select(*ids, F.posexplode(array).alias("_ix", "score")).select(*ids, F.get(names, F.col("_ix")).alias("feature"), "score")


def wide_text(df: DataFrame, ids: list[str], array: str, features: list[str]) -> DataFrame:
    """K1: one column per feature, written with two decimals in scientific form."""
    return df.select(*ids, *[F.format_string("%.2e", F.get(array, F.lit(i))).alias(f) for i, f in enumerate(features)])
