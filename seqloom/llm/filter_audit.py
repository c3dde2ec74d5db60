"""Filter interaction audit: what each of five filters removes, in every order, per part of the corpus.

Every document gets a mask, one bit for each filter that it fails. Four filters look at the text alone. The fifth, duplicates, is
found by a fingerprint-routed RDD: texts travel to the partition that the xxhash of their bytes names, a partition keeps for each fingerprint
a chain of the different texts with their least id, and ids above the least one are emitted as duplicates. ``combineByKey`` then adds vectors of
counts by mask, one vector per part, from which all orders, steps and Shapley sums follow by arithmetic: the corpus is read once, not once an order.

Scale: a task holds the chains of at most ``HELD_BYTES`` of text before it passes them on, so copies within one stretch of input travel
once; a partition's chains are of ``PARTITION_BYTES`` on average (the number of partitions follows from the bytes of the table). Fingerprints
that many rows share (``HOT_SHARE`` of all rows or more, so at most 1 / ``HOT_SHARE`` of them) are salted first and meet in a second round, in
which all others are small rows without text. Vectors are added within each task before they travel. Labels are joined by id, to rows without text.

Defined cases: null text counts as empty, a null part is the empty string; equal ids with equal texts are no duplicates of each other; a row
without an id is no duplicate and makes none, and has no label; of several labels of one id the greatest counts; repeated rows count as often as they
stand; very long texts are read whole; fingerprints that collide are told apart by their texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 200
DUPLICATE = 1 << FILTERS.index("E")
HELD_BYTES = 16 << 20
PARTITION_BYTES = 16 << 20
HOT_SHARE = 1e-3
HOT_ROWS = 1000  # fewer copies are not worth a salt
SALTS = 64

_MARKS = re.compile(r"[#$%&*|]")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str, raw: bytes) -> int:
    """The bits of the filters that look at the text alone; ``raw`` is its UTF-8 form."""
    words = raw.split()
    few = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * len(raw.translate(None, _NOT_UPPER)) > 2 * len(text)
    marked = _MARKS.search(text) is not None
    return few | repeated << 1 | loud << 2 | marked << 3


def fingerprint(raw: bytes) -> int:
    """Spark's ``xxhash64`` of the text, unsigned."""
    return xxhash.xxh64_intdigest(raw, 42)


class Chains:
    """By fingerprint, the different texts with their mask, their least id and how many rows of each part have that id."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def add(self, print_: int, raw: bytes, mask: int, doc_id: int, parts: dict[str, int]) -> Iterator[tuple[int, str, int, int]]:
        """Takes rows of one text and id in; emits what is a duplicate now: id, part, mask, rows."""
        chain = self.by_print.setdefault(print_, [])
        entry = next((e for e in chain if e[0] == raw), None)
        if entry is None:
            chain.append([raw, mask, doc_id, dict(parts)])
            self.held += len(raw) + 200
            return
        least = entry[2]
        if doc_id == least:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return
        lost, lost_parts = (doc_id, parts) if doc_id > least else (least, entry[3])
        if doc_id < least:
            entry[2], entry[3] = doc_id, dict(parts)
        for part, n in lost_parts.items():
            yield lost, part, mask | DUPLICATE, n

    def drain(self) -> Iterator[tuple[int, bytes, int, int, dict[str, int]]]:
        for print_, chain in self.by_print.items():
            for raw, mask, doc_id, parts in chain:
                yield print_, raw, mask, doc_id, parts
        self.by_print, self.held = {}, 0


def settled(doc_id: int | None, part: str, mask: int, n: int, print_: int) -> tuple[int, tuple]:
    """A record without a text; neither equal ids nor equal texts bring them to one task."""
    return xxhash.xxh64_intdigest(f"{doc_id} {print_}"), (None, doc_id, part, mask, n)


def routed(rows: Iterable, number: int, hot: frozenset[int], judge: Callable[[str, bytes], int] = text_mask) -> Iterator[tuple[int, tuple]]:
    """Of a task's rows (doc_id, text, part): (where to, record). Records with a text are still to be compared, the others are settled."""
    chains = Chains()

    def sent() -> Iterator[tuple[int, tuple]]:
        for record in chains.drain():
            print_ = record[0]
            yield xxhash.xxh64_intdigest(print_.to_bytes(8, "little"), number % SALTS + 1) if print_ in hot else print_, record

    for doc_id, text, part in rows:
        text, part = text or "", part or ""
        raw = text.encode("utf-8", "surrogatepass")
        mask, print_ = judge(text, raw), fingerprint(raw)
        if doc_id is None:
            yield settled(None, part, mask, 1, print_ + number)
            continue
        for lost in chains.add(print_, raw, mask, doc_id, {part: 1}):
            yield settled(*lost, print_)
        if chains.held > HELD_BYTES:
            yield from sent()
    yield from sent()


def compared(records: Iterable[tuple[int, tuple]], hot: frozenset[int]) -> Iterator[tuple[int, tuple]]:
    """Records of a partition with every text met: duplicates and least ids are settled, but those of ``hot`` fingerprints go on with their texts."""
    chains = Chains()
    for where, record in records:
        if record[0] is None:
            yield where, record
        else:
            for lost in chains.add(*record):
                yield settled(*lost, record[0])
    for print_, raw, mask, doc_id, parts in chains.drain():
        if print_ in hot:
            yield print_, (print_, raw, mask, doc_id, parts)
        else:
            for part, n in parts.items():
                yield settled(doc_id, part, mask, n, print_)


def _planned(docs: DataFrame, text: str) -> tuple[int, frozenset[int]]:
    """How many partitions the texts want, and the hot fingerprints, by JVM functions alone: Spark's 64-bit hash is the fingerprint.

    At most 1 / ``HOT_SHARE`` texts can have so many rows, so the list that comes back is bounded.
    """
    column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    least = max(HOT_ROWS, int(docs.count() * HOT_SHARE))
    counts = docs.groupBy(F.xxhash64(column).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("bytes"))
    total = counts.agg(F.sum("bytes").alias("bytes"), F.collect_list(F.when(F.col("n") >= least, F.col("h"))).alias("hot")).first()
    wanted = -(-(total["bytes"] or 0) // PARTITION_BYTES)
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted), frozenset(h % (1 << 64) for h in total["hot"])


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", judge: Callable[[str, bytes], int] = text_mask) -> DataFrame:
    """doc_id, part, mask and rows: how many documents of that id and part have that mask. ``judge`` gives the bits below ``DUPLICATE``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"), F.col(part).cast("string"))
    partitions, hot = _planned(docs, text)
    sent: RDD = rows.rdd.mapPartitionsWithIndex(lambda number, task: routed(task, number, hot, judge))
    met = sent.partitionBy(partitions, int).mapPartitions(lambda records: compared(records, hot))
    if hot:
        met = met.partitionBy(partitions, int).mapPartitions(lambda records: compared(records, frozenset()))
    out = spark.createDataFrame(met.map(lambda record: record[1][1:]), "doc_id long, part string, mask int, rows long", verifySchema=False)
    return out.groupBy("doc_id", "part", "mask").agg(F.sum("rows").alias("rows"))


def _added(vector: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
    mask, rows, good, toxic = row
    vector[:, mask] += (rows, rows * good, rows * toxic)
    return vector


def count_vectors(masked: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): all, good and toxic documents by mask, one vector per part."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masked.join(known, "doc_id", "left").select("part", "mask", "rows", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    width = 1 << len(FILTERS)
    return joined.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(lambda row: _added(np.zeros((3, width), dtype=np.int64), row), _added, lambda a, b: a + b)


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """Every order and step of one part."""
    mask = np.arange(1 << len(FILTERS))
    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        alive = np.ones(len(mask), dtype=bool)
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails = mask & bit > 0
            removed, good, toxic = counts[:, alive & fails].sum(axis=1).tolist()
            redundant = int(counts[0, ~alive & fails].sum())
            alive &= ~fails
            steps.append(("".join(order), step, letter, int(counts[0, alive].sum()), removed, redundant, int(counts[0, bit]), good, toxic))
            shapley[letter] += removed
    for order, step, letter, *numbers in steps:
        yield part, order, step, *numbers, shapley[letter]


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", judge: Callable[[str, bytes], int] = text_mask) -> DataFrame:
    """One row per part, order of the filters and step, with the columns of ``RESULT``."""
    vectors = count_vectors(masks(docs, doc_id, text, part, judge), labels)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: report(*x)), RESULT, verifySchema=False)
