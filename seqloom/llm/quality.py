"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document is a bag of character-class bigrams (letters by themselves, upper case,
digits and marks by class) plus two repetition terms. Latent-semantic analysis (inverse document
frequency, then truncated singular vectors) is fitted on a bounded sample of labelled rows; the
labelled vectors and the projection are broadcast, their size is fixed by ``SAMPLE`` and ``RANK``. Every document is
then compared with all labelled vectors by exact cosine products in blocks, and its nearest
neighbours vote, weighted by similarity.

Defined cases: null text counts as empty; a text whose vector is zero gets the sample's mean label;
without labelled rows every score is 0.5; ties among neighbours break by sample order; very long texts are read whole, a
slice of the batch at a time; a labelled row of the sample has itself among its neighbours; an empty table gives no rows;
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches, whole_text

SAMPLE = 3000  # labelled rows that the classifier is fitted on, at most
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.7
BLOCK = 256

_MARKS = b" \n.,!?*%$#&|-:;()'\"@/<>_+=[]{}"
_CLASSES = 3 + 26 + len(_MARKS)
TERMS = _CLASSES * _CLASSES + 2


def _class_of_byte() -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)  # 0: all other bytes
    table[65:91] = 1
    table[48:58] = 2
    table[97:123] = 3 + np.arange(26)
    for n, mark in enumerate(_MARKS):
        table[mark] = 29 + n
    return table


CLASS_OF_BYTE = _class_of_byte()


def term_shares(texts: list[str]) -> np.ndarray:
    """Square roots of the terms' shares in each whole text, one row per text."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        kinds = CLASS_OF_BYTE[np.frombuffer(raw, dtype=np.uint8)]
        if len(kinds) > 1:
            out[i, :-2] = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=TERMS - 2) / (len(kinds) - 1)
        words = raw.split()
        if len(words) > 1:
            out[i, -2] = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
            out[i, -1] = sum(map(bytes.__eq__, words, words[2:])) / len(words)
    return np.sqrt(out)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))


def in_training(doc_id) -> F.Column:
    """Whether a row's label may be learnt from; a row without an id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> dict:
    """The model: weights, projection, labelled vectors and labels, all of bounded size.

    Labels come only from rows of the training part, the ``sample`` first ones by a hash of the id. Of several
    texts with one id the least counts, so that at most ``sample`` rows reach the driver.
    """
    known = labels.filter(F.col("quality").isNotNull() & in_training(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long"), F.col("quality").cast("double"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    @F.arrow_udf("binary")
    def shares(text: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for _, part in slices(text) for x in term_shares(part).astype(np.float16)], pa.binary())

    # ``known`` has at most ``sample`` rows of two numbers.
    picked = _texts(docs).join(F.broadcast(known.dropDuplicates()), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    picked = picked.select("doc_id", "quality", shares("text").alias("terms"))
    rows = sorted(((r.doc_id, r.quality, bytes(r.terms)) for r in picked.collect()), key=lambda r: r)
    if not rows:
        return {"empty": 0.5}
    y = np.array([r[1] for r in rows], dtype=np.float32)
    x = np.empty((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r[2], dtype=np.float16)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    weight[-2:] *= 2
    x *= weight
    projection = _right_vectors(x, min(rank, len(rows)))
    return {"empty": float(y.mean()), "weight": weight, "projection": projection, "known": _unit(x @ projection), "y": y}


def _right_vectors(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start: memory stays near that of ``x``."""
    start = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    turn = np.linalg.svd(x @ basis, full_matrices=False)[2]
    return np.ascontiguousarray(basis @ turn.T[:, :rank])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def votes(model: dict, texts: list[str], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """A score from 0 to 1 per text: the labels of its nearest labelled vectors, weighted by cosine."""
    out = np.full(len(texts), model["empty"], dtype=np.float64)
    if "known" not in model:
        return out
    known, y = model["known"], model["y"]
    k = min(neighbours, len(known))
    for at in range(0, len(texts), BLOCK):
        part = term_shares(texts[at : at + BLOCK])
        vectors = _unit((part * model["weight"]) @ model["projection"])
        cosine = vectors @ known.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, None).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        ok = (total > 0) & part.any(axis=1)
        out[at : at + BLOCK][ok] = (weight * y[near]).sum(axis=1)[ok] / total[ok]
    return np.clip(out, 0, 1)


def scored(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``) and score; fitted on ``training`` (default: docs).

    Only the text goes to Python; the other columns stay where they are.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(training if training is not None else docs, labels))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(votes(model.value, part) for _, part in slices(text))]))

    return docs.select(F.struct(*docs.columns).alias("row"), score(whole_text()).alias("score"))
