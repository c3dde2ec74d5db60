"""Best-fit packing of token pieces by a configuration linear program.

Documents become token ids (plus an end id) and pieces of at most ``CAPACITY`` tokens. Only the
histogram of piece lengths, at most ``CAPACITY`` numbers, reaches the driver. There:

1. lengths are put into at most ``CLASSES`` classes of neighbouring lengths, so that a class has many pieces,
2. the configuration program (fewest sequences whose configurations cover every class's count) is
   solved by multiplicative weights: classes lose weight as they get covered, and each round a
   knapsack dynamic programme prices the configuration of greatest weight,
3. configurations are rounded to whole sequences: each takes real lengths of its classes, and the length that fills its
   gap best stands for its last and smallest one,
4. what rounding leaves goes, longest first, to the best-fitting gap, on counts and never on single pieces.

The result is a list of patterns (lengths, how many sequences). Tasks number the pieces of each
length (large lengths are salted) and look their places up in the broadcast patterns, whose size
depends on ``CAPACITY`` and ``ROUNDS`` alone.

Defined cases: null text counts as empty and becomes one piece with the end id; repeated rows are
packed as often as they stand; an empty table gives no rows; ties are numbered by id and piece; very long texts are
tokenised whole, a bounded slice of the batch at a time; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, small_batches, whole_text, written

CAPACITY = 4096
END_ID = 1
CLASSES = 96
ROUNDS = 120
RATE = 0.5
RESERVE = 0.02
TRIES = 64
WASTE = 0.005
CACHED_WORDS = 400_000
NO_RANK = 1 << 40
# Texts of these characters need no Unicode normalisation, and lower-casing them is the same everywhere.
PLAIN_TEXT = re.compile("[\\t\\n\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
# The word pattern that a vocabulary must have for texts to be split here, and what it comes to for such texts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN_WORD = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")


class PairMerges:
    """Byte-pair merging of many short words at once: each round merges every word's best pair.

    Words are rows of symbol ids. A round looks up the ranks of all adjacent pairs, merges the first
    pair of the lowest rank in each row, and drops the rows that have no pair left.
    """

    def __init__(self, model: dict):
        vocab, merges = model["vocab"], model["merges"]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] * len(vocab) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.size = key[order], order.astype(np.int64), len(vocab)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        suffix = model.get("end_of_word_suffix") or ""
        shown = _shown_bytes()
        self.inner = np.array([vocab[c] for c in shown], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in shown], dtype=np.int64)

    def _ranks(self, a, b):
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (b >= 0), self.rank[at], NO_RANK)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (at least one byte each)."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        out: list = [None] * len(words)
        for least, most in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 32)):
            mine = np.flatnonzero((length <= most) & (length > least))
            if len(mine):
                raw = np.frombuffer(b"".join(words[i].ljust(most, b"\0") for i in mine.tolist()), dtype=np.uint8).reshape(len(mine), most)
                ids, sizes = self._merge(raw, length[mine])
                for i, row, n in zip(mine.tolist(), ids, sizes.tolist(), strict=True):
                    out[i] = row[:n]
        return out

    def _merge(self, raw, length):
        n, most = raw.shape
        column = np.arange(most)
        ids = np.where(column < length[:, None], self.inner[raw], -1)
        ids[np.arange(n), length - 1] = self.final[raw[np.arange(n), length - 1]]
        done, size = np.full((n, most), -1, dtype=np.int64), length.copy()
        rows = np.arange(n)
        rank = self._ranks(ids[:, :-1], ids[:, 1:]) if most > 1 else np.full((n, 0), NO_RANK)
        while len(rows):
            at = rank.argmin(axis=1)
            line = np.arange(len(rows))
            best = rank[line, at]
            over = best == NO_RANK
            if over.any():
                done[rows[over]] = ids[over]
                keep = ~over
                rows, ids, rank, at, best = rows[keep], ids[keep], rank[keep], at[keep], best[keep]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = self.made[best]
            take = np.minimum(column + (column > at[:, None]), most - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(take[:, : most - 1], most - 2), axis=1)
            rank[:, -1] = NO_RANK
            size[rows] -= 1
            right = np.minimum(at + 1, most - 1)
            rank[line, np.minimum(at, most - 2)] = np.where(at + 1 < size[rows], self._ranks(ids[line, at], ids[line, right]), NO_RANK)
            left = np.maximum(at - 1, 0)
            rank[line, left] = np.where(at > 0, self._ranks(ids[line, left], ids[line, at]), rank[line, left])
        return done, size


def _shown_bytes() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    shown = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}
    return [shown[b] for b in range(256)]


class Numbers(dict):
    """A number for each key, given at its first lookup; ``new`` lists the keys of the latest ones."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        number = self[key] = len(self)
        return number


class WordIds:
    """Token ids of whole texts, by way of their words.

    The vocabulary lower-cases, drops white space and never joins what its word pattern separates,
    so the ids of a text are those of its words in turn, and a word that was seen is looked up.
    Texts of plain Latin letters and ASCII are split here by the same word pattern; any
    other text is split at ASCII white space only, and the tokenizer itself encodes those parts. It encodes whole texts that
    hold one of its added tokens, and all texts if its steps are not the ones expected here. The
    cache is emptied when it has ``CACHED_WORDS`` words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, *bytes_ = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        as_words = split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed" and [x["type"] for x in bytes_] == ["ByteLevel"]
        self.by_words = as_words and (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and spec["model"]["type"] == "BPE" and not spec.get("post_processor")
        added = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.merges = PairMerges(spec["model"]) if self.by_words else None
        self.clear()

    def clear(self) -> None:
        self.place = Numbers()
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Parts that start with a tab are whole; the others are words by the pattern."""
        got: list = [None] * len(words)
        whole = [i for i, w in enumerate(words) if w[0] == "\t" or len(w) > 16]
        short = [i for i, w in enumerate(words) if w[0] != "\t" and len(w) <= 16]
        for at in range(0, len(whole), 4096):
            part = whole[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i].lstrip("\t") for i in part], add_special_tokens=False), strict=True):
                got[i] = np.array(e.ids, dtype=np.int64)
        for i, ids in zip(short, self.merges.encode([words[i].encode() for i in short]), strict=True):
            got[i] = ids
        self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in got], dtype=np.int64)])
        self.flat = np.concatenate([self.flat, *got])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        whole = [i for i, t in enumerate(texts) if not self.by_words or self.added.search(t)]
        if whole:
            got = self._encode([t if self.by_words and not self.added.search(t) else "" for t in texts])
            for i in whole:
                got[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, END_ID], dtype=np.uint32)
            return got
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.place) > CACHED_WORDS:
            self.clear()
        words = [PLAIN_WORD.findall(t.lower()) if PLAIN_TEXT.fullmatch(t) else ["\t" + p.decode() for p in t.encode().split()] for t in texts]
        count = [len(ws) for ws in words]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=sum(count))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        starts, sizes = self.starts[at], self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].astype(np.uint32)
        cuts = np.concatenate([[0], ends])[np.cumsum(count)]
        return [np.append(x, np.uint32(END_ID)) for x in np.split(ids, cuts[:-1])]


@lru_cache(maxsize=2)
def words_of(path: str) -> WordIds:
    """A worker's tokenizer: its cache serves all tasks that the worker runs."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches):
        words = words_of(tokenizer_path)
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                yield cut(batch.column("doc_id").slice(at, len(texts)), words.encode(texts))

    def cut(keys, encoded):
        rows = [(i, n, ids[n * capacity : (n + 1) * capacity]) for i, ids in enumerate(encoded) for n in range(-(-len(ids) // capacity))]
        columns = {
            "doc_id": keys.take(pa.array([r[0] for r in rows], pa.int64())),
            "piece": pa.array([r[1] for r in rows], pa.int32()),
            "start": pa.array([r[1] * capacity for r in rows], pa.int64()),
            "length": pa.array([len(r[2]) for r in rows], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, kind)


def length_classes(histogram: dict[int, int], classes: int = CLASSES) -> list[tuple[int, int]]:
    """First and last length of classes of neighbouring lengths; each has about the same share of all tokens."""
    share = sum(length * n for length, n in histogram.items()) / classes
    bounds, first, mass = [], None, 0.0
    for length in sorted(histogram):
        first, mass = length if first is None else first, mass + length * histogram[length]
        if mass >= share:
            bounds.append((first, length))
            first, mass = None, 0.0
    if first is not None:
        bounds.append((first, max(histogram)))
    return bounds


def configurations(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[dict[int, int], float]]:
    """Configurations and their fractional numbers, by multiplicative weights.

    ``counts`` maps a size to its number of items. Each round prices all configurations by a knapsack
    over the weights and adds the best one, as much of it as covers one of its sizes once. A configuration takes no more of a size than there is.
    The numbers are scaled so that all configurations together hold as much as all items.
    """
    sizes = np.array(sorted(counts), dtype=np.int64)
    if not len(sizes):
        return []
    number = np.array([counts[s] for s in sizes.tolist()], dtype=np.float64)
    weight, found = np.ones(len(sizes)), Counter()
    least = int(sizes[0])
    for _ in range(rounds):
        value = weight / number
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
        for room in range(least, capacity + 1):
            fit = int(np.searchsorted(sizes, room, side="right"))
            gain = best[room - sizes[:fit]] + value[:fit]
            top = int(gain.argmax())
            best[room], choice[room] = gain[top], top
        taken, room = Counter(), capacity
        while room >= least and choice[room] >= 0:
            taken[int(choice[room])] += 1
            room -= int(sizes[choice[room]])
        at = np.array(list(taken))
        many = np.minimum(np.array(list(taken.values()), dtype=np.float64), number[at])
        step = float((number[at] / many).min())
        found[tuple(sorted(zip(at.tolist(), many.astype(int).tolist(), strict=True)))] += step
        weight[at] *= np.exp(-rate * step * many / number[at])
        if weight.max() < 1e-250:
            weight /= weight.max()
    held = sum(x * sum(int(sizes[k]) * many for k, many in config) for config, x in found.items())
    scale = float(sizes @ number) / held
    return [({int(sizes[k]): many for k, many in config}, x * scale) for config, x in found.items()]


def configured(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """The sequences that configurations fill, as lengths and how many sequences, and the counts of what they leave.

    The shortest pieces, ``RESERVE`` of all tokens, are held back: they close the gaps of the last sequences.
    """
    held, mass, tokens = {}, 0, RESERVE * sum(k * v for k, v in histogram.items())
    for length in sorted(histogram):
        if mass < tokens:
            held[length] = min(histogram[length], int((tokens - mass) // length) + 1)
            mass += length * held[length]
    histogram = {k: v - held.get(k, 0) for k, v in histogram.items() if v > held.get(k, 0)}
    left = dict(histogram)
    bounds: dict[int, tuple[int, int]] = {}
    counts: dict[int, int] = {}
    for low, high in length_classes(histogram):
        n = sum(v for k, v in histogram.items() if low <= k <= high)
        mean = -(-sum(k * v for k, v in histogram.items() if low <= k <= high) // n)
        bounds[mean], counts[mean] = (low, high), n
    there = sorted(left)  # lengths that are left

    def longest(most: int, used: Counter, least: int = 1) -> int:
        """The longest length from ``least`` to ``most`` of which some is left beside ``used``, or 0."""
        at = bisect_right(there, most) - 1
        while at >= 0 and there[at] >= least:
            if left[there[at]] > used[there[at]]:
                return there[at]
            at -= 1
        return 0

    def filling(gap: int, used: Counter) -> list[int]:
        """Lengths for a gap: one or two that fill it exactly, or else the longest ones in turn."""
        first = longest(gap, used)
        for _ in range(TRIES if first and first < gap else 0):
            second = gap - first
            if second in left and left[second] > used[second] + (first == second):
                return [first, second]
            if not (shorter := longest(first - 1, used)):
                break
            first = shorter
        found: list[int] = []
        while length := longest(gap, used + Counter(found)):
            found.append(length)
            gap -= length
        return found

    made: list[tuple[tuple[int, ...], int]] = []
    for config, x in sorted(configurations(counts, capacity, rounds), key=lambda c: -c[1]):
        todo = int(x)
        slots = [size for size in sorted(config, reverse=True) for _ in range(config[size])]
        while todo > 0:
            used: Counter = Counter()
            gap, missing = capacity, 0
            for size in slots[:-1]:
                low, high = bounds[size]
                length = longest(min(high, gap), used, low)
                missing += not length
                used[length] += bool(length)
                gap -= length
            if missing:  # a class has run out: what is left is for best fit, as is what fills a sequence badly
                break
            for length in filling(gap, used):
                used[length] += 1
            chosen = +used
            if capacity - sum(k * v for k, v in chosen.items()) > capacity * WASTE:
                break
            times = min(todo, *(left[v] // many for v, many in chosen.items())) if chosen else 0
            if not times:
                break
            for v, many in chosen.items():
                left[v] -= times * many
                if not left[v]:
                    there.remove(v)
            made.append((tuple(sorted(chosen.elements(), reverse=True)), times))
            todo -= times
    return made, {k: v for k, v in (Counter(left) + Counter(held)).items() if v > 0}


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[list[int], int]]:
    """Lists of lengths and the number of sequences that hold exactly these lengths."""
    return _best_fit(*configured(histogram, capacity, rounds), capacity)


def _best_fit(made, left, capacity):
    """Put what is left, longest first, into the smallest gaps that hold it; open new sequences for the rest."""
    gaps: list[int] = []
    open_: dict[int, Counter] = defaultdict(Counter)

    def put(lengths, times):
        gap = capacity - sum(lengths)
        if gap not in open_ or not open_[gap]:
            insort(gaps, gap)
        open_[gap][lengths] += times

    for lengths, times in made:
        put(lengths, times)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if count >= each:
                    put((length,) * each, count // each)
                if count % each:
                    put((length,) * (count % each), 1)
                break
            gap = gaps[at]
            lengths, times = open_[gap].popitem()
            if not open_[gap]:
                gaps.pop(at)
            used = min(times, count)
            if times > used:
                put(lengths, times - used)
            put(lengths + (length,), used)
            count -= used
    return [(list(lengths), times) for gap in open_ for lengths, times in open_[gap].items()]


def places(found: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length, where its pieces go by rank: arrays sorted by length and first rank."""
    rows, first, ranks = [], 0, Counter()
    for lengths, times in found:
        offset = 0
        for length in lengths:
            rows.append((length, ranks[length], first, offset))
            ranks[length] += times
            offset += length
        first += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    bounds = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    return {"rank": np.ascontiguousarray(table[:, 1]), "sequence": np.ascontiguousarray(table[:, 2]), "offset": np.ascontiguousarray(table[:, 3]), "bounds": bounds}


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` has doc_id, piece, length and any other columns."""
    spark = cut.sparkSession
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = {int(r["length"]): int(r["n"]) for r in counted}
    table = spark.sparkContext.broadcast(places(patterns(histogram, capacity, rounds=rounds), capacity))
    # A length of many pieces is numbered in parts, none larger than a quarter of what a partition holds on average.
    part = max(1, sum(histogram.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = max(1, -(-max(histogram.values(), default=1) // part))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    by_length = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = written(sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(by_length), F.lit(0)).alias("_first")), "first-ranks")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(first, ["length", "_salt"])
    ranked = ranked.select(*cut.columns, (F.col("_rank") - 1 + F.col("_first")).alias("_rank"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)

    def run(batches):
        t = table.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                mine = np.flatnonzero(length == one)
                a, b = t["bounds"][one], t["bounds"][one + 1]
                at = a + np.searchsorted(t["rank"][a:b], rank[mine], side="right") - 1
                sequence[mine] = t["sequence"][at] + rank[mine] - t["rank"][at]
                offset[mine] = t["offset"][at]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """Tokenise, cut and pack: one row per piece."""
    return pack(written(pieces(docs, tokenizer_path, capacity, with_ids), "pieces"), capacity, rounds)
