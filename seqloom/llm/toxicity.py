"""Toxicity by bags of subwords: averaged n-gram embeddings under a linear softmax.

A word is a stretch of characters that are not white space; its subwords are its n-grams of 3 to 5 characters, the white
space before and after it counting as one character each. A document is read in passages of ``PASSAGE`` words. A passage's vector is the average of
its subwords' embeddings, a linear softmax scores it, and the document has its most toxic passage's score, so that length does not thin
out what one passage says. Embeddings and softmax are trained jointly (in numpy, on the driver) on a bounded sample of labelled rows; a misspelling that
no label has seen shares most of its n-grams' vectors with the word it stands for.

Only subwords with evidence have an embedding of their own, all others stand for nothing in particular and have the zero vector: the documents of
the sample that hold the subword must be toxic more often than chance (``EVIDENCE`` standard deviations) and as often as the threshold asks.
Near copies in the sample (a shared least shingle of three words) count as one document, or a copied label would be evidence many times over.

Scale: the sample is read once and written to the shared folder; the model is ``BUCKETS`` numbers. An average followed by a linear layer is
linear in the n-grams, so what is broadcast is one number a bucket, its embedding times the difference of the softmax rows; scoring is one pass
over the text in slices of bounded size, without a shuffle.

Defined cases: null text counts as empty; a text without words gets the mean label of the sample; without labelled rows every score
is 0.5; only A-Z are lower-cased; very long texts are read whole; equal texts, and so repeated rows, get equal scores; ties do not arise, as
nothing is ranked; an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, small_batches, whole_text, written

SAMPLE = 3000  # labelled rows that the classifier is fitted on, at most
SAMPLE_CHARS = 8 << 20  # and their characters
BUCKETS = 1 << 18
DIMENSIONS = 4
SIZES = (3, 4, 5)  # of the n-grams
PASSAGE = 16  # words
EVIDENCE = 4.0
ROUNDS = 40
DECAY = 1e-7
THRESHOLD = 0.7

_SPACE = 32
_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - (BUCKETS.bit_length() - 1))
_SHINGLE_STEPS = np.random.default_rng(0).integers(1, 1 << 62, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _folded() -> np.ndarray:
    """Of each code point: A-Z lower-cased, white space as one character."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[65:91] += 32
    table[9:14] = _SPACE
    return table


FOLDED = _folded()


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where passages start, the text that each one is of, and for each size the bucket of the n-gram at every place and whether there is one."""
    joined = " " + " ".join(texts) + " " * max(SIZES)
    codes = FOLDED[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    n = int(ends[-1])
    space = codes == _SPACE
    words = np.flatnonzero(space[:n] & ~space[1 : n + 1])  # the white space before each word
    text_of = np.searchsorted(ends, words, side="right")
    number = np.arange(len(words)) - np.searchsorted(text_of, text_of)
    first = number % PASSAGE == 0
    hashed = codes[:n] * _STEP + codes[1 : n + 1]
    there = np.ones(n, dtype=bool)
    found = []
    for size in range(3, max(SIZES) + 1):
        there = there & ~space[size - 2 : n + size - 2]
        hashed = hashed * _STEP + codes[size - 1 : n + size - 1]
        if size in SIZES:
            found.append((((hashed + np.uint32(size)) * _MIX) >> _SHIFT, there))
    return words[first], text_of[first], found


def _distinct(text: str) -> dict:
    """The buckets of a whole text, and its least hashes over shingles of three words."""
    _, _, found = subwords([text])
    words = text.split()
    shingles = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))}
    least = [int(((np.array(list(shingles), dtype=np.uint64) + np.uint64(1)) * step).min()) for step in _SHINGLE_STEPS]
    return {"ids": np.unique(np.concatenate([b[there] for b, there in found])).astype(np.int32).tobytes(), "least": np.array(least, dtype=np.uint64).tobytes()}


def bags(text: str, place: np.ndarray) -> dict:
    """Of each passage how many subwords it has; and which chosen subword is in which passage how often."""
    starts, _, found = subwords([text])
    totals, hits = np.zeros(len(starts), dtype=np.int64), []
    if len(starts):
        for bucket, there in found:
            totals += np.add.reduceat(there, starts, dtype=np.int64)
            at = np.flatnonzero(there & (place[bucket] >= 0))
            hits.append((np.searchsorted(starts, at, side="right") - 1) * len(place) + place[bucket[at]])
    keys, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *hits]), return_counts=True)
    return {"totals": totals.tobytes(), "keys": keys.tobytes(), "counts": counts.tobytes()}


def in_training(doc_id) -> F.Column:
    """Whether a row's label may be learnt from; a row without an id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, toxic, text of the labelled rows to learn from, as a written table.

    Labels come only from rows of the training part: the ``sample`` first ones by a hash of the id, and of these as many as have
    ``sample_chars`` characters together (one at least). Of several texts with one id the least counts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & in_training(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long"), F.col("toxic").cast("double"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample).dropDuplicates()
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    # ``known`` has at most ``sample`` rows of two numbers, and so has the window over what it picks.
    picked = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    picked = written(picked, "toxic-sample")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, -1)
    small = picked.select("doc_id", "toxic", F.length("text").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    few = small.filter((F.col("before") == 0) | (F.col("before") + F.col("n") <= sample_chars)).select("doc_id", "toxic")
    return picked.join(F.broadcast(few), ["doc_id", "toxic"])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, of bounded size."""
    picked = sampled(docs, labels)

    @F.arrow_udf("struct<ids: binary, least: binary>")
    def distinct(text: pa.Array) -> pa.Array:
        return pa.array([_distinct(t) for _, part in slices(text) for t in part], pa.struct({"ids": pa.binary(), "least": pa.binary()}))

    rows = sorted(picked.select("doc_id", "toxic", distinct("text").alias("x")).collect(), key=lambda r: r[:2])
    if not rows:
        return {"empty": 0.5}
    y = np.array([r["toxic"] for r in rows])
    weight = copies_share([np.frombuffer(r["x"]["least"], np.uint64) for r in rows])
    chosen = evidence([np.frombuffer(r["x"]["ids"], np.int32) for r in rows], y, weight)
    empty = float((weight * y).sum() / weight.sum())
    if not len(chosen):
        return {"empty": empty}
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))

    @F.arrow_udf("struct<totals: binary, keys: binary, counts: binary>")
    def passages(text: pa.Array) -> pa.Array:
        kind = pa.struct({"totals": pa.binary(), "keys": pa.binary(), "counts": pa.binary()})
        return pa.array([bags(t, place) for _, part in slices(text) for t in part], kind)

    rows = sorted(picked.select("doc_id", "toxic", passages("text").alias("x")).collect(), key=lambda r: r[:2])
    read = lambda r, name: np.frombuffer(r["x"][name], np.int64)
    return trained([(read(r, "totals"), read(r, "keys"), read(r, "counts")) for r in rows], y, weight, chosen, empty)


def copies_share(least: list[np.ndarray]) -> np.ndarray:
    """One over the number of rows that least hashes link to a row, itself included."""
    parent = list(range(len(least)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, values in enumerate(least):
        for key in enumerate(values.tolist()):
            parent[root(i)] = root(seen.setdefault(key, i))
    roots = np.array([root(i) for i in range(len(least))], dtype=np.int64)
    return 1 / np.bincount(roots, minlength=len(least))[roots]


def evidence(ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The buckets whose documents are toxic more often than chance and as often as the threshold asks; documents count by weight."""
    sizes = [len(i) for i in ids]
    held = np.bincount(np.concatenate(ids), np.repeat(weight, sizes), BUCKETS)
    toxic = np.bincount(np.concatenate(ids), np.repeat(weight * y, sizes), BUCKETS)
    share = float((weight * y).sum() / weight.sum())
    apart = (toxic - share * held) / np.sqrt(share * (1 - share) * held + 1)
    return np.flatnonzero((apart > EVIDENCE) & ((toxic + share) / (held + 1) >= THRESHOLD))


def trained(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, chosen: np.ndarray, empty: float) -> dict:
    """Embeddings and softmax by the gradient of the passages' cross-entropy, with Adam's step sizes; a passage has its document's label.

    The shares stand once by passage and once by bucket, so that the way there and the way back are sums of neighbouring rows.
    """
    starts = np.cumsum([0] + [len(t) for t, _, _ in rows])
    totals = np.concatenate([t for t, _, _ in rows])
    passage = np.concatenate([at + keys // BUCKETS for at, (_, keys, _) in zip(starts, rows, strict=False)])
    ids = np.concatenate([keys % BUCKETS for _, keys, _ in rows])
    shares = (np.concatenate([c for _, _, c in rows]) / totals[passage]).astype(np.float32)
    lengths = np.diff(starts)
    label, importance = np.repeat(y, lengths), np.repeat(weight, lengths)
    importance = importance / importance.sum()
    by_passage = np.flatnonzero(np.diff(passage, prepend=-1))
    order = np.argsort(ids, kind="stable")
    by_bucket, passage_of, shares_of = np.flatnonzero(np.diff(ids[order], prepend=-1)), passage[order], shares[order]
    rng = np.random.default_rng(0)
    model = {
        "embedding": rng.normal(0, 0.1, (len(chosen), DIMENSIONS)),
        "softmax": rng.normal(0, 0.5, (DIMENSIONS, 2)),
        "bias": np.log(np.array([1 - empty + 1e-3, empty + 1e-3])),
    }
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    pace = {"embedding": 1.0, "softmax": 0.05, "bias": 0.05}
    target = np.stack([1 - label, label], axis=1)
    for turn in range(1, ROUNDS + 1):
        hidden = np.zeros((len(totals), DIMENSIONS))
        hidden[passage[by_passage]] = np.add.reduceat(model["embedding"][ids] * shares[:, None], by_passage)
        wrong = (_softmax(hidden @ model["softmax"] + model["bias"]) - target) * importance[:, None]
        back = wrong @ model["softmax"].T
        embedding = DECAY * model["embedding"]
        embedding[ids[order][by_bucket]] += np.add.reduceat(back[passage_of] * shares_of[:, None], by_bucket)
        for k, g in {"embedding": embedding, "softmax": hidden.T @ wrong, "bias": wrong.sum(axis=0)}.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.02 * (g * g - second[k])
            model[k] -= pace[k] * first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.98**turn)) + 1e-12)
    embedding = np.zeros((BUCKETS, DIMENSIONS))
    embedding[chosen] = model["embedding"]
    return {"empty": empty, "embedding": embedding, "softmax": model["softmax"], "bias": model["bias"]}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def folded(model: dict) -> dict:
    """What scoring needs: the log odds that each bucket adds, and those of the bias."""
    if "embedding" not in model:
        return {"empty": model["empty"]}
    apart = model["softmax"][:, 1] - model["softmax"][:, 0]
    return {"empty": model["empty"], "odds": model["embedding"] @ apart, "bias": float(model["bias"][1] - model["bias"][0])}


def scores(odds: dict, texts: list[str]) -> np.ndarray:
    """The toxic class's probability for the most toxic passage of each text."""
    out = np.full(len(texts), odds["empty"], dtype=np.float64)
    if "odds" not in odds or not texts:
        return out
    starts, text_of, found = subwords(texts)
    if not len(starts):
        return out
    total, count = np.zeros(len(starts)), np.zeros(len(starts), dtype=np.int64)
    for bucket, there in found:
        total += np.add.reduceat(np.where(there, odds["odds"][bucket], 0.0), starts)
        count += np.add.reduceat(there, starts, dtype=np.int64)
    chance = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + odds["bias"], -500, 500)))
    of_text = np.flatnonzero(np.diff(text_of, prepend=-1))
    out[text_of[of_text]] = np.maximum.reduceat(chance, of_text)
    return out


def scored(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``) and score; fitted on ``training`` (default: docs). Only the text goes to Python."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(folded(fit(training if training is not None else docs, labels)))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(scores(model.value, part) for _, part in slices(text))]))

    return docs.select(F.struct(*docs.columns).alias("row"), score(whole_text()).alias("score"))
