"""Repeated substrings across documents, by a column-wise collection Burrows-Wheeler transform.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document of a smaller id is removed.

The column-wise construction inserts one symbol of every string per round, so it wants many short
strings. Whole documents are far too long for it (a round sweeps the collection, and there would be as many
rounds as the longest document has bytes); the work is dealt out so that it only meets short ones:

1. each window of ``LENGTH`` bytes is named by the least hash of the ``ANCHOR``-byte strings inside it, so equal
   windows have equal names wherever they stand. Names, four bytes each, are dealt over buckets, and those
   that stand in two documents or more come back to their documents,
2. runs of windows of such a name are cut out as segments of at most ``LENGTH + SPAN - 1`` bytes; equal
   segments are combined, with their smallest document, before they are shuffled by name,
3. each task builds the transform and the common prefixes of its segments column by column (from the
   first column that can start a window); neighbours with a common prefix of
   ``LENGTH`` bytes or more are equal windows, and each window learns its smallest document,
4. the segments' answers go back to the documents, which are cut.

The sequential external files of the method are Spark's shuffle files, in and out; within a task
its arrays hold at most ``COLLECTION`` segments' worth at a time, dealt by name.

Defined cases: null text counts as empty; a null id counts as larger than every other; texts below ``LENGTH`` bytes stay
whole; rows of equal id never remove from each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy, whole_text, written

LENGTH = 50
ANCHOR = 24
WINDOW = LENGTH - ANCHOR + 1
SPAN = 35  # windows in a segment, at most
BATCH = 8 << 20
COLLECTION = 30_000  # segments in a task's arrays, about
LAST = (1 << 63) - 1


def window_names(raw: np.ndarray) -> np.ndarray:
    """The name of each window of LENGTH bytes: the least hash of the ANCHOR bytes at each place inside."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    raw = np.ascontiguousarray(raw)
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))  # eight bytes from each place on
    places = len(raw) - ANCHOR + 1
    x = np.zeros(places, dtype=np.uint64)
    for at in range(0, ANCHOR, 8):
        x ^= words[at : at + places]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    width = 1
    while 2 * width <= WINDOW:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = WINDOW - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _short(names: np.ndarray, buckets: int) -> np.ndarray:
    """A name's bucket and its low 32 bits, as one number."""
    return ((names >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | names & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _batches(batches, size=BATCH):
    """doc ids and texts in bytes, in groups of about ``size`` bytes."""
    ids, texts, total = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = t.encode()
            ids.append(i)
            texts.append(raw)
            total += len(raw)
            if total >= size:
                yield np.array(ids, dtype=np.int64), texts
                ids, texts, total = [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), texts


def _name_rows(buckets):
    def run(batches):
        for ids, texts in _batches(batches):
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            names = window_names(np.frombuffer(b"".join(texts), dtype=np.uint8))
            if not len(names):
                continue
            ends = np.cumsum(sizes)
            valid = np.ones(len(names), dtype=bool)  # windows must not cross from one document into the next
            for e in ends[:-1].tolist():
                valid[max(0, e - LENGTH + 1) : e] = False
            first = np.flatnonzero(valid & np.r_[True, (names[1:] != names[:-1]) | ~valid[:-1]])
            short = _short(names[first], buckets)
            doc = ids[np.searchsorted(ends, first, side="right")]
            order = np.lexsort((doc, short))
            short, doc = short[order], doc[order]
            new = np.r_[True, (short[1:] != short[:-1]) | (doc[1:] != doc[:-1])]
            short, doc = short[new], doc[new]
            starts = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
            many = np.diff(np.r_[starts, len(short)])
            # Names that two documents of this batch have are known to repeat: one of them stands for all.
            known = np.repeat(many > 1, many)
            d, s = doc[known], short[known]
            yield pa.RecordBatch.from_pydict({"key": pa.array(d), "doc": pa.array(d), "names": pa.array(s), "packed": pa.nulls(len(d), pa.binary())})
            short, doc = short[starts], doc[starts]
            bucket = short >> 32
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            packed = [
                (short[a:b] & 0xFFFFFFFF).astype("<u4").tobytes() + doc[a:b].astype("<i8").tobytes()
                for a, b in zip(edges.tolist(), np.r_[edges[1:], len(bucket)].tolist(), strict=True)
            ]
            none = pa.nulls(len(packed), pa.int64())
            yield pa.RecordBatch.from_pydict({"key": pa.array(bucket[edges]), "doc": none, "names": none, "packed": pa.array(packed, pa.binary())})

    return run


def _repeated(batches):
    """Pass known repeats on; find the names of each bucket that several documents have."""
    def of(bucket, parts):
        low = np.concatenate([np.frombuffer(p, dtype="<u4", count=len(p) // 12) for p in parts])
        doc = np.concatenate([np.frombuffer(p, dtype="<i8", offset=len(p) // 12 * 4) for p in parts])
        order = np.lexsort((doc, low))
        low, doc = low[order], doc[order]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        ends = np.r_[starts[1:], len(low)]
        keep = np.repeat(doc[starts] != doc[ends - 1], ends - starts)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[keep]), "name": pa.array(bucket << 32 | low[keep].astype(np.int64))})

    key, parts = None, []
    for batch in batches:
        known = batch.filter(batch.column("packed").is_null())
        if known.num_rows:
            yield pa.RecordBatch.from_pydict({"doc_id": known.column("doc"), "name": known.column("names")})
        rest = batch.filter(batch.column("packed").is_valid())
        for k, p in zip(rest.column("key").to_pylist(), rest.column("packed").to_pylist(), strict=True):
            if k != key and parts:
                yield of(key, parts)
                parts = []
            key = k
            parts.append(p)
    if parts:
        yield of(key, parts)


def _segments(buckets):
    """Segments of the windows whose names repeat, each with its document, place and number."""
    def run(batches):
        for batch in batches:
            out = {"name": [], "segment": [], "doc_id": [], "tie": [], "start": []}
            least: dict[bytes, int] = {}
            for i, tie, text, names in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text")), batch.column("names"), strict=True):
                raw = text.encode()
                short = _short(window_names(np.frombuffer(raw, dtype=np.uint8)), buckets)
                if not len(short):
                    continue
                listed = np.unique(names.values.to_numpy(zero_copy_only=False))
                hit = listed[np.minimum(np.searchsorted(listed, short), len(listed) - 1)] == short
                edge = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
                at = np.arange(len(short)) - np.repeat(edge, np.diff(np.r_[edge, len(short)]))
                starts = np.flatnonzero(at % SPAN == 0)
                ends = np.r_[starts[1:], len(short)]
                for a, b in zip(starts[hit[starts]].tolist(), ends[hit[starts]].tolist(), strict=True):
                    segment = raw[a : b + LENGTH - 1]
                    least[segment] = min(i, least.get(segment, LAST))
                    out["segment"].append(segment)
                    out["start"].append(a)
                mine = int(hit[starts].sum())
                out["name"].append(short[starts[hit[starts]]])
                out["doc_id"] += [i] * mine
                out["tie"] += [tie] * mine
            names = np.concatenate(out["name"]) if out["name"] else np.zeros(0, np.int64)
            out["sid"] = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in out["segment"]]
            # The text of a segment stands once in a batch, with its smallest document there.
            once = [least.pop(x, None) for x in out["segment"]]
            out["segment"] = [None if d is None else x for x, d in zip(out["segment"], once, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "name": pa.array(names), "segment": pa.array(out["segment"], pa.binary()), "doc_id": pa.array(out["doc_id"], pa.int64()),
                "tie": pa.array(out["tie"], pa.int64()), "start": pa.array(out["start"], pa.int32()), "sid": pa.array(out["sid"], pa.int64()), "least": pa.array(once, pa.int64()),
            })

    return run


def collection(strings: list[bytes], width: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of at least ``width - 1`` symbols in order: string, length, and prefix in common with the one before (at most ``width``).

    Each string's last ``width - 1`` symbols are entered first, sorted at once: suffixes that short hold no
    window. From there on, column by column, a round puts the next symbol before the suffix that each string inserted
    last. How many inserted suffixes stand before the new one follows from the symbols of the transform, how many
    of the first ones from a binary search; common prefixes are updated at the new rows and the rows after them.
    """
    m, seed = len(strings), width - 1
    size = np.array([len(s) for s in strings], dtype=np.int64)
    most = int(size.max())
    flat = np.frombuffer(b"".join(s.ljust(most, b"\0") for s in strings), dtype=np.uint8).reshape(m, most)
    symbols = np.zeros((m, most + 1), dtype=np.uint8)  # from 1 on, in order; 0 past the end. UTF-8 has fewer than 255 different bytes
    inside = np.arange(most) < size[:, None]
    symbols[:, :most][inside] = np.searchsorted(np.unique(flat[inside]), flat[inside]) + 1
    last = symbols.shape[1] * np.arange(m)
    every = symbols.reshape(-1)

    def keys(owner, length, n=seed):
        """The first n symbols of suffixes, as fixed-length strings (no symbol is 0, so they compare as such)."""
        at = (last + size)[owner] - length
        return np.ascontiguousarray(every[at[:, None] + np.arange(n)])

    def before(owner, length):
        """The symbol before a suffix; 0 at a string's start."""
        at = size[owner] - length - 1
        return np.where(at >= 0, every[last[owner] + np.maximum(at, 0)], 0).astype(np.uint8)

    def common(a, b):
        """Prefix in common of pairs of rows (owner, length), up to ``width``; the shorter one ends it."""
        x, y = keys(*a, width), keys(*b, width)
        differ = (x != y) | (x == 0)
        return np.where(differ.any(axis=1), differ.argmax(axis=1), width).astype(np.uint8)

    everyone = np.arange(m)
    first = keys(everyone, np.full(m, seed)).view(f"S{seed}").ravel()
    owner = np.argsort(first, kind="stable")
    first = first[owner]
    length = np.full(m, seed, dtype=np.int64)
    lcp = np.zeros(m, dtype=np.uint8)
    lcp[1:] = common((owner[:-1], length[:-1]), (owner[1:], length[1:]))
    bwt = before(owner, length)
    place = np.empty(m, dtype=np.int64)
    place[owner] = everyone
    live = everyone
    for j in range(seed + 1, most + 1):
        active = size[live] >= j
        live, place = live[active], place[active]
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        inserted = rank[place] - int((bwt == 0).sum())  # inserted suffixes before the new one, new ones among them
        by = np.argsort(inserted)
        live, inserted = live[by], inserted[by]
        length_now = np.full(len(live), j, dtype=np.int64)
        index = inserted + np.searchsorted(first, keys(live, length_now).view(f"S{seed}").ravel(), side="right")
        total = len(bwt) + len(live)
        fresh = np.zeros(total, dtype=bool)
        fresh[index] = True
        old = ~fresh

        def merged(values, new, fresh=fresh, old=old, total=total):
            out = np.empty(total, dtype=values.dtype)
            out[old], out[fresh] = values, new
            return out

        bwt, lcp = merged(bwt, before(live, length_now)), merged(lcp, 0)
        owner, length = merged(owner, live), merged(length, j)
        changed = np.unique(np.r_[index, index + 1])
        changed = changed[(changed > 0) & (changed < total)]
        lcp[changed] = common((owner[changed - 1], length[changed - 1]), (owner[changed], length[changed]))
        place = index
    return owner, length, lcp


def smallest_owners(strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each string and each window of it, the smallest document of any string with an equal window."""
    owner, length, lcp = collection(strings)
    wide = length >= LENGTH
    starts = np.flatnonzero(lcp < LENGTH)
    least = np.minimum.reduceat(docs[owner], starts)
    least = np.repeat(least, np.diff(np.r_[starts, len(lcp)]))
    owner, length, least = owner[wide], length[wide], least[wide]
    order = np.lexsort((-length, owner))
    return np.split(least[order], np.cumsum(np.bincount(owner, minlength=len(strings)))[:-1])


def _answers(limit):
    """name, sid, least for each distinct segment. Names come sorted, and a collection ends where a name ends.

    A name that only one segment has needs no collection: its windows stand nowhere else.
    """
    def solve(rows):
        names, sids, strings, docs = zip(*rows, strict=True)
        return table(names, sids, smallest_owners(list(strings), np.array(docs, dtype=np.int64)))

    def table(names, sids, got):
        return pa.RecordBatch.from_pydict({"name": pa.array(names, pa.int64()), "sid": pa.array(sids, pa.int64()), "least": pa.array(got, pa.list_(pa.int64()))})

    def run(batches):
        group, rows = [], []
        for batch in batches:
            alone = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "sid", "segment", "doc_id")), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) == 1:
                        alone.append(group[0])
                    else:
                        rows += group
                    group = []
                    if len(rows) >= limit:
                        yield solve(rows)
                        rows = []
                group.append(row)
            if alone:
                yield table([r[0] for r in alone], [r[1] for r in alone], [[r[3]] * (len(r[2]) - LENGTH + 1) for r in alone])
        rows += group
        if rows:
            yield solve(rows)

    return run


def _answers_by_window(distinct: DataFrame) -> DataFrame:
    """The same for names that too many segments share: window by window, combined before they are shuffled."""
    windows = distinct.select(
        "name", "sid", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("segment") - LENGTH), lambda i: F.substring("segment", i + 1, F.lit(LENGTH)))).alias("at", "window")
    )
    least = windows.groupBy("name", "window").agg(F.min("doc_id").alias("least"))
    placed = windows.join(least, ["name", "window"]).groupBy("name", "sid").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("x"))
    return placed.select("name", "sid", F.transform("x", lambda r: r["least"]).alias("least"))


def _cut(batches):
    for batch in batches:
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i, text, marks, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), batch.column("marks"), batch.column("copy").to_pylist(), strict=True):
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            if copy and len(raw) >= LENGTH:
                for k, v in zip(out, (i, len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest(), b""), strict=True):
                    out[k].append(v)
                continue
            if not marks.is_valid:
                for k, v in zip(out, (i, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw.tobytes()), strict=True):
                    out[k].append(v)
                continue
            change = np.zeros(len(raw) + 1, dtype=np.int32)
            start = marks.values.field("start").to_numpy(zero_copy_only=False)
            mask = marks.values.field("mask").to_numpy(zero_copy_only=False)
            if len(start):
                bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
                at = (start.astype(np.int64)[:, None] + np.arange(64))[bits]
                np.add.at(change, at, 1)
                np.add.at(change, at + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = raw[~gone].tobytes()
            out["doc_id"].append(i)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k[0] in "dn" else pa.binary() if k == "kept" else pa.string()) for k, v in out.items()})


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_repeats(docs: DataFrame, buckets: int | None = None, limit: int = COLLECTION) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document."""
    spark = docs.sparkSession
    buckets = buckets or 4 * max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), whole_text().alias("text"))
    named = base.mapInArrow(_name_rows(buckets), "key long, doc long, names long, packed binary")
    dealt = named.repartition("key").sortWithinPartitions("key")
    names = dealt.mapInArrow(_repeated, "doc_id long, name long").groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    tied = base.withColumn("tie", F.xxhash64("text"))
    # A later copy of a whole text goes as a whole; its windows need no search.
    digests = written(tied.select("doc_id", "tie", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = written(digests.join(firsts, "digest").filter("doc_id > first").select("doc_id", "tie").distinct(), "copies")
    names = names.join(copies.groupBy("doc_id").agg(F.collect_set("tie").alias("copied")), "doc_id", "left")
    first = tied.join(names, "doc_id").filter(~F.coalesce(F.array_contains("copied", F.col("tie")), F.lit(False)))
    found = first.select("doc_id", "tie", "text", "names").mapInArrow(
        _segments(buckets), "name long, segment binary, doc_id long, tie long, start int, sid long, least long"
    )
    found = written(found, "segments")
    tidy(spark, digests)
    distinct = found.filter("segment is not null").groupBy("name", "sid", "segment").agg(F.min("least").alias("doc_id"))
    distinct = written(distinct, "distinct-segments")
    tidy(spark)
    crowded = written(distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("name"), "crowded-names")
    few = distinct.join(crowded, "name", "left_anti").select("name", "sid", "segment", "doc_id")
    few = few.repartition("name").sortWithinPartitions("name", "sid", "segment")
    least = few.mapInArrow(_answers(limit), "name long, sid long, least array<long>")
    if not crowded.isEmpty():
        least = least.unionByName(_answers_by_window(distinct.join(crowded, "name", "left_semi")))
    least = written(least, "least")
    tidy(spark, distinct, crowded)
    marked = found.select("name", "sid", "doc_id", "tie", "start").join(least, ["name", "sid"])
    flags = F.transform("least", lambda x: F.when(x < F.col("doc_id"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    mask = F.aggregate(F.reverse(flags), F.lit(0).cast("long"), lambda s, x: s * 2 + x)
    marks = marked.select("doc_id", "tie", F.struct("start", mask.alias("mask")).alias("mark")).filter("mark.mask <> 0")
    marks = marks.groupBy("doc_id", "tie").agg(F.collect_list("mark").alias("marks"))
    marks = written(marks.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True), "marks")
    tidy(spark, found, least)
    cut = tied.join(marks, ["doc_id", "tie"], "left").select("doc_id", "text", "marks", "copy").mapInArrow(_cut, CUT)
    return cut.withColumn("doc_id", F.when(F.col("doc_id") == LAST, None).otherwise(F.col("doc_id")))
