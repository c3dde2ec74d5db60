"""Block-compressed, indexed interval files: blocks found in parallel, an index of what each block covers, reads of touched blocks only.

The format is gzip in members of at most 64 KB whose header holds their size, so any member can be found and opened by itself. Ranges of a file
are searched for the first header that leads to another one and walked from there. A block's lines are those that begin after its first line
end (in the first block: all), up to the end of the line that the block's end cuts; that line's rest is read from the next blocks.

``index`` has a row per block and chromosome with the least start and greatest end of its lines. A region query is an overlap join with this
index; the blocks that come out, and no others, are read. No task reads a whole file, and no region reads more than its blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import intervals
from seqloom.sources import fasta, tables

RANGE = 32 << 20
CONTENT = 65280  # bytes of text in a block that is written here
MOST = 1 << 16  # bytes of a block
# Fixed values of the format: the head of a member with an extra field "BC" of two bytes, and the empty member at the end.
_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

_BLOCK = "file string, offset long, bytes long"
_COVER = "file string, offset long, chrom string, lo long, hi long, lines long"


def packed(text: bytes) -> bytes:
    """One block."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(text) + squeeze.flush()
    return _HEAD + struct.pack("<H", len(body) + len(_HEAD) + 2 + 8 - 1) + body + struct.pack("<II", zlib.crc32(text), len(text))


def size_at(data: bytes, at: int) -> int | None:
    """The size of the block whose head stands at ``at``, or None where no head stands."""
    if data[at : at + 4] != _HEAD[:4] or data[at + 10 : at + 16] != _HEAD[10:16] or len(data) < at + 18:
        return None
    return struct.unpack_from("<H", data, at + 16)[0] + 1


def first_block(data: bytes, until: int, ends: bool) -> int | None:
    """The first head before ``until`` that leads to another head, or to the end of the file (``ends``)."""
    at = data.find(_HEAD[:4], 0, until + 3)
    while 0 <= at < until:
        size = size_at(data, at)
        if size and ((ends and at + size == len(data)) or size_at(data, at + size)):
            return at
        at = data.find(_HEAD[:4], at + 1, until + 3)
    return None


def _found(size: int):
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            start, here = row["range_start"], min(size, row["size"] - row["range_start"])
            with fasta._open(row["file"]) as source:
                data = source.read_at(min(here + 2 * MOST, row["size"] - start), start)
            at = first_block(data, here, start + len(data) == row["size"])
            out = []
            while at is not None and at < here:
                length = size_at(data, at)
                if length is None:
                    raise ValueError(f"no block at byte {start + at} of {row['file']}")
                out.append({"file": row["file"], "offset": start + at, "bytes": length})
                at += length
            yield pa.RecordBatch.from_pylist(out, kind)

    return find


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def blocks(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """file, offset, bytes of every block of a file or of a folder's files."""
    return fasta.ranges(spark, path, size).repartition(F.col("file"), F.col("range_start")).mapInArrow(_found(size), _BLOCK)


class _Reader:
    """Lines of single blocks; keeps the last file open."""

    def __init__(self) -> None:
        self.name, self.source = None, None

    def text(self, file: str, offset: int) -> tuple[bytes, int]:
        """A block's text and where the next block starts; nothing at the end of the file."""
        if file != self.name:
            self.name, self.source = file, fasta._open(file)
        raw = self.source.read_at(MOST, offset) if offset < self.source.size() else b""
        length = size_at(raw, 0) if raw else None
        return (zlib.decompress(raw[18 : length - 8], -15), offset + length) if length else (b"", offset)

    def lines(self, file: str, offset: int) -> list[bytes]:
        text, after = self.text(file, offset)
        if offset:
            begin = text.find(b"\n") + 1
            if not begin:
                return []  # the line goes on from before and past this block
            text = text[begin:]
        # The line that begins at or runs over the block's end is this block's: the next one starts after its first line end.
        while True:
            more, after = self.text(file, after)
            stop = more.find(b"\n")
            if not more or stop >= 0:
                return (text + more[: stop + 1]).splitlines()
            text += more


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("chrom", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("lines", pa.int64())])
    reader = _Reader()
    for row in _rows(batches):
        cover: dict[bytes, list[int]] = {}
        for line in reader.lines(row["file"], row["offset"]):
            if line.strip() and not line.startswith(b"#"):
                chrom, start, end = line.split(b"\t", 3)[:3]
                own = cover.setdefault(chrom, [int(start), int(end), 0])
                own[0], own[1], own[2] = min(own[0], int(start)), max(own[1], int(end)), own[2] + 1
        rows = [{"file": row["file"], "offset": row["offset"], "chrom": c.decode(), "lo": a, "hi": b, "lines": n} for c, (a, b, n) in cover.items()]
        yield pa.RecordBatch.from_pylist(rows, kind)


def index(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """file, offset, chrom, lo, hi, lines: what each block covers of each chromosome. Write it beside the file to use it again."""
    found = tables.written(blocks(spark, path, size), "blocks")
    return tables.written(found.repartitionByRange("file", "offset").mapInArrow(_covered, _COVER), "block-index")


def touched(regions: DataFrame, covers: DataFrame) -> DataFrame:
    """file, offset of the blocks that a region (chrom, qs, qe) can have lines in."""
    features = covers.select("chrom", F.col("lo").alias("fs"), F.greatest("hi", F.col("lo") + 1).alias("fe"), "file", "offset")
    return intervals.overlaps(regions.select("chrom", "qs", "qe"), features).select("file", "offset").distinct()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for row in _rows(batches):
        lines = [line.decode("utf-8", "replace") for line in reader.lines(row["file"], row["offset"])]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def lines(which: DataFrame) -> DataFrame:
    """The lines (column value) of the blocks ``which`` (file, offset)."""
    return which.select("file", "offset").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_read, "value string")


def features(which: DataFrame) -> DataFrame:
    """chrom, fs, fe, feature of the blocks' lines."""
    c = F.split("value", "\t")
    rows = lines(which).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    return rows.select(F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).cast("long").alias("fs"), F.get(c, F.lit(2)).cast("long").alias("fe"), F.get(c, F.lit(3)).alias("feature"))


def overlaps(regions: DataFrame, covers: DataFrame) -> DataFrame:
    """J1 on an indexed file: the regions (chrom, qs, qe and any columns) with the features that overlap them."""
    return intervals.overlaps(regions, features(touched(regions, covers)))


def write(df: DataFrame, path: str) -> DataFrame:
    """Text rows (column value) as block-compressed files, one per task; the files' names and lines come back.

    A file gets its name when it is whole, the same one if its task runs again.
    """
    system, inner = fasta._system(path)
    system.create_dir(inner)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, _ = fasta._system(path)
        name = f"{inner}/part-{TaskContext.get().partitionId():05d}.gz"
        held, n = b"", 0
        draft = f"{inner}/_{uuid.uuid4().hex}"
        with own.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                values = batch.column("value").to_pylist()
                n += len(values)
                held += "".join(f"{v}\n" for v in values).encode()
                while len(held) >= CONTENT:
                    out.write(packed(held[:CONTENT]))
                    held = held[CONTENT:]
            if held:
                out.write(packed(held))
            out.write(_END)
        own.move(draft, name)
        yield pa.RecordBatch.from_pylist([{"file": scheme + name, "lines": n}], pa.schema([("file", pa.string()), ("lines", pa.int64())]))

    return tables.written(df.select("value").mapInArrow(put, "file string, lines long"), "block-files")
