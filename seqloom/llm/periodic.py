"""Periodic runs of words: every shift of a document against itself.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least ``MIN_RUN`` words and
``MIN_EXPONENT`` periods, that no neighbouring word extends keeping q. Words become numbers, and for every lag up to n / ``MIN_EXPONENT`` the array of numbers is
compared with itself shifted by the lag, as whole vectors; stretches of equality that are long enough are runs. A lag's whole vector is
compared only if words stand at equal numbers four times in a row at steps of the lag from the start: any run of that period
covers such four, so nothing is missed and most lags cost n / lag comparisons instead of n. Of runs over the same stretch the smallest period stays.

Scale: a document is a row of work as long as it has at most ``WHOLE_BYTES`` bytes. Longer ones, up to any length, are written to the shared folder with their word
numbers and dealt over tasks as ranges of lags of about ``WORK`` comparisons each at most; what comes back are their runs, fewer than they have words, and
then each is put together. No other row is shuffled, and nothing depends on how rows are grouped.

Defined cases: null text counts as empty and has no words; a text without a run has no runs and its words joined by single spaces; very long texts are read
whole; repeated rows and rows without an id are judged like others; overlapping runs all count; ties cannot arise between runs, since no two have the same stretch; an empty
table gives no rows; other columns pass through, whatever their names (results are ``runs`` and ``collapsed`` beside ``row``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches, whole_text, written

MIN_RUN = 6
MIN_EXPONENT = 4
WHOLE_BYTES = 1 << 16
WORK = 1 << 28  # comparisons of one range of lags, at most

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32)


def runs_of_lags(ids: np.ndarray, lags: Iterable[int]) -> list[tuple[int, int, int]]:
    """(start, length, lag) of every stretch whose words a lag apart are equal, long enough for a run; multiples of a period included."""
    found = []
    for lag in lags:
        steps = ids[::lag]
        same = steps[1:] == steps[:-1]
        # A run has four periods, so from its first multiple of the lag on three neighbours in a row at steps of the lag are equal.
        if lag > 1 and not (same[2:] & same[1:-1] & same[:-2]).any():
            continue
        equal = np.zeros(len(ids) - lag + 2, dtype=bool)
        np.equal(ids[lag:], ids[:-lag], out=equal[1:-1])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        starts, lengths = edges[::2], edges[1::2] - edges[::2] + lag
        enough = lengths >= max(MIN_RUN, MIN_EXPONENT * lag)
        found += [(s, n, lag) for s, n in zip(starts[enough].tolist(), lengths[enough].tolist(), strict=True)]
    return found


def smallest_periods(found: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the stretches that several lags show, the least lag; by start, then period.

    A stretch of four periods that also has a smaller period has one that divides it, and that one's maximal stretch is the same.
    """
    least: dict[tuple[int, int], int] = {}
    for start, length, lag in found:
        least[start, length] = min(lag, least.get((start, length), lag))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda run: (run[0], run[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    stays = np.cumsum(dropped[:-1]) == 0
    return b" ".join(words if stays.all() else [words[i] for i in np.flatnonzero(stays)])


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # at the bytes 9 to 13 and 32, like the pattern [^\x20\x09-\x0D]+


def last_lag(n: int) -> int:
    return n // MIN_EXPONENT if n >= MIN_RUN else 0


def _found(text: str) -> dict:
    words = _words(text)
    runs = smallest_periods(runs_of_lags(word_numbers(words), range(1, last_lag(len(words)) + 1)))
    return {"runs": _structs(runs), "collapsed": kept_words(words, runs).decode("utf-8", "surrogatepass")}


def _structs(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def _whole(text: pa.Array) -> pa.Array:
    kind = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
    return pa.array([_found(t) for _, part in slices(text) for t in part], kind)


def _numbers(text: pa.Array) -> pa.Array:
    return pa.array([word_numbers(_words(t)).tobytes() for _, part in slices(text) for t in part], pa.binary())


def _ranges(n: Column) -> Column:
    """[first, last] lags in ranges of at most ``WORK`` comparisons."""
    last = F.when(n >= MIN_RUN, F.floor(n / MIN_EXPONENT)).otherwise(F.lit(0))
    each = F.greatest(F.floor(F.lit(WORK) / F.greatest(n, F.lit(1))), F.lit(1))
    starts = F.when(last > 0, F.sequence(F.lit(1).cast("long"), last.cast("long"), each.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + each - 1, last).alias("last")))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            key, numbers, first, last = (batch.column(c)[i].as_py() for c in ("_key", "_numbers", "_first", "_last"))
            found = runs_of_lags(np.frombuffer(numbers, dtype=np.int32), range(first, last + 1))
            kind = pa.schema([("_key", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "period")]])
            yield pa.RecordBatch.from_pylist([{"_key": key, "start": s, "length": n, "period": q} for s, n, q in found], kind)


def _collapsed(text: pa.Array, runs: pa.Array) -> pa.Array:
    out = []
    for t, found in zip(text, runs, strict=True):
        spans = [(r["start"], r["length"], r["period"]) for r in found.as_py()]
        out.append(kept_words(_words(t.as_py()), spans).decode("utf-8", "surrogatepass"))
    return pa.array(out, pa.string())


def runs(docs: DataFrame, text: str = "text", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``row`` (all columns of ``docs``), ``runs`` by start and period, and ``collapsed``, the words that stay."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), whole_text(text).alias("_text"))
    short = F.octet_length("_text") <= whole_bytes
    found = F.arrow_udf(_whole, f"struct<runs: {RUNS}, collapsed: string>")
    whole = rows.filter(short).select("row", found("_text").alias("x")).select("row", "x.runs", "x.collapsed")
    return whole.unionByName(_long(rows.filter(~short)))


def _long(rows: DataFrame) -> DataFrame:
    """Very long documents: their lags are dealt over tasks, by numbers of words that are written once."""
    numbered = rows.select("row", "_text", F.arrow_udf(_numbers, "binary")("_text").alias("_numbers"), F.monotonically_increasing_id().alias("_key"))
    numbered = written(numbered, "long-documents")  # keys stay what they are when a task runs again
    work = numbered.select("_key", "_numbers", F.explode(_ranges(F.octet_length("_numbers") / 4)).alias("_range"))
    tasks = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.select("_key", "_numbers", F.col("_range.first").alias("_first"), F.col("_range.last").alias("_last")).repartition(tasks, "_key", "_first")
    found = work.mapInArrow(_scanned, "_key long, start long, length long, period long")
    found = found.groupBy("_key", "start", "length").agg(F.min("period").alias("period"))
    one = F.struct("start", "period", "length")
    lists = found.groupBy("_key").agg(F.sort_array(F.collect_list(one)).alias("_runs"))
    ordered = F.transform(F.coalesce("_runs", F.array().cast("array<struct<start: bigint, period: bigint, length: bigint>>")), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    joined = numbered.drop("_numbers").join(lists, "_key", "left").select("row", "_text", ordered.alias("runs"))
    return joined.select("row", "runs", F.arrow_udf(_collapsed, "string")("_text", "runs").alias("collapsed"))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text, or, where crc32 of the decimal id is divisible by ten, its words with the tail from word a on in turns of p words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n.cast("long")).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), turned), F.lit(0))  # so that the words are cut once
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(changed, text)).otherwise(text)
