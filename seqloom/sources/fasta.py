"""FASTA files by byte ranges: an offset table of the records, and windows read as the bytes they stand in.

No record and no line is ever a row, so a record of any length, wrapped or not, is work for many tasks. The table is built from ranges of
``RANGE`` bytes: each task counts what its range holds of each record, and what a record's ranges have counted is put together by one row per
record and range. A window is turned into a byte range by the record's offset, symbols per line and bytes per line; only the blocks of
``BLOCK`` bytes that windows touch are read, each once, in the order of the file.

Lines of a record must have equal length, but the last; ``regular`` says whether they have, and reading from a record that is not is an error. Blank lines
at a record's end are allowed. A header line has at most ``HEADER`` bytes. Paths are local, or any that Arrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.alphabet import DNA, Alphabet
from seqloom.operators.sequences import in_bounds, on_strand
from seqloom.sources import tables

RANGE = 32 << 20
BLOCK = 64 << 10
HEADER = 64 << 10
_LINE, _MARK, _RETURN = 10, ord(">"), 13

_PART = (
    "file string, range_start long, part int, name string, header_offset long, first_base long, bases long, last_base long, "
    "first_line_end long, last_line_end long, line_gap_least long, line_gap_most long, last_gap long, returns int"
)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """The files of a folder (hidden ones and marks of writers left out), or the file itself, with their sizes, by name."""
    system, inner = _system(path)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner))
    scheme = path.split(":", 1)[0] + "://" if ":/" in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """file, size, range_start: every range of every file."""
    table = spark.createDataFrame(files(path), "file string, size long").filter("size > 0")
    return table.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("range_start"))


def place_of(before: bytes, start: int) -> str:
    """Whether the byte at ``start`` begins a line, or is inside a header or a sequence line; ``before`` is what precedes it."""
    if start == 0 or before.endswith(b"\n"):
        return "line"
    line = before[before.rfind(b"\n") + 1 :]
    known = b"\n" in before or len(before) == start  # else the line is longer than any header
    return "header" if known and line.startswith(b">") else "sequence"


def parts_of(raw: bytes, start: int, place: str, after: bytes) -> list[dict]:
    """What a range holds of each record: first of the one that goes on from before, then of each that begins here.

    ``place`` is where the first byte stands (``place_of``), ``after`` is what follows the range, for a header that is cut.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(data == _LINE)
    begins = np.concatenate([[0], ends + 1])
    begins = begins[begins < len(data)]
    stops = np.concatenate([ends, [len(data)]])[: len(begins)]
    new = (data[begins] == _MARK) & ((begins > 0) | (place == "line"))
    heads = np.flatnonzero(new).tolist()
    out = [_part(data, start, begins, stops, 1 if place == "header" else 0, heads[0] if heads else len(begins), place == "sequence")]
    for part, (head, last) in enumerate(zip(heads, [*heads[1:], len(begins)], strict=False), 1):
        line = raw[begins[head] : stops[head]] + (after if stops[head] == len(data) else b"")
        whole = line.split(b"\n", 1)[0]
        name = whole[1:].split(maxsplit=1)
        found = _part(data, start, begins, stops, head + 1, last, False)
        out.append(found | {"part": part, "name": (name[0] if name else b"").decode(), "header_offset": int(start + begins[head]), "first_base": int(start + begins[head] + len(whole) + 1)})
    return out


def _part(data: np.ndarray, start: int, begins: np.ndarray, stops: np.ndarray, first: int, last: int, goes_on: bool) -> dict:
    """Counts over the sequence lines numbered ``first`` to below ``last``; the first one may go on from before."""
    begins, stops = begins[first:last], stops[first:last]
    returned = (stops > begins) & (data[stops - 1] == _RETURN)
    widths = stops - begins - returned
    filled = widths > 0
    line_ends = stops[(stops < len(data)) & (filled | ((np.arange(len(stops)) == 0) & goes_on))] + start
    gaps = np.diff(line_ends)
    value = lambda array, pick: int(pick(array)) if len(array) else None
    return {
        "part": 0, "name": None, "header_offset": None, "first_base": None, "bases": int(widths.sum()), "last_base": value((stops - returned - 1 + start)[filled], np.max),
        "first_line_end": value(line_ends, np.min), "last_line_end": value(line_ends, np.max), "line_gap_least": value(gaps[:-1], np.min), "line_gap_most": value(gaps[:-1], np.max),
        "last_gap": int(gaps[-1]) if len(gaps) else None, "returns": int(returned.any()),
    }


def _counted(size: int):
    kind = [(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in _PART.split(", "))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            start = row["range_start"]
            with _open(row["file"]) as source:
                before = source.read_at(min(start, HEADER), start - min(start, HEADER))
                raw = source.read_at(min(size, row["size"] - start), start)
                after = source.read_at(min(HEADER, row["size"] - start - len(raw)), start + len(raw))
            found = parts_of(raw, start, place_of(before, start), after)
            yield pa.RecordBatch.from_pylist([f | {"file": row["file"], "range_start": start} for f in found], pa.schema(kind))

    return count


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _open(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def index(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """File, record (from 0, in file order), name, offset of the first symbol, length, bases_per_line, bytes_per_line, regular."""
    parts = ranges(spark, path, size).repartition(F.col("file"), F.col("range_start")).mapInArrow(_counted(size), _PART)
    parts = tables.written(parts, "fasta-parts")  # a row for each record and range
    in_file = Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.groupBy("file", "range_start").agg(F.max("part").alias("_new"))
    heads = heads.select("file", "range_start", F.coalesce(F.sum("_new").over(in_file), F.lit(0)).alias("_earlier"))
    rows = parts.join(heads, ["file", "range_start"]).withColumn("_record", F.col("_earlier") + F.col("part")).filter("_record > 0")
    of = Window.partitionBy("file", "_record").orderBy("range_start")
    whole = Window.partitionBy("file", "_record")
    rows = rows.withColumns({
        "_cross": F.col("first_line_end") - F.max("last_line_end").over(of.rowsBetween(Window.unboundedPreceding, -1)),
        "_bytes": F.min("first_line_end").over(whole) - F.max("first_base").over(whole) + 1, "_end": F.max("last_line_end").over(whole), "_last": F.max("last_base").over(whole),
    })
    final = lambda end: (end == F.col("_end")) & (F.col("_last") < F.col("_end"))  # noqa: E731: the last line may be shorter
    fits = lambda gap, end: (gap == F.col("_bytes")) | (final(end) & (gap < F.col("_bytes")))
    inner = (F.col("line_gap_least") == F.col("_bytes")) & (F.col("line_gap_most") == F.col("_bytes"))
    right = reduce(Column.__and__, [F.coalesce(c, F.lit(True)) for c in (inner, fits(F.col("last_gap"), F.col("last_line_end")), fits(F.col("_cross"), F.col("first_line_end")), F.col("_last") - F.col("_end") < F.col("_bytes"))])
    records = rows.withColumn("_right", right).groupBy("file", "_record").agg(
        F.max("name").alias("name"), F.max("first_base").alias("offset"), F.sum("bases").alias("length"), F.max("_bytes").alias("_bytes"), F.max("returns").alias("_returns"), F.min("_right").alias("regular"),
    )
    per_line = F.coalesce(F.col("_bytes") - 1 - F.col("_returns"), F.col("length"))
    return records.select("file", (F.col("_record") - 1).alias("record"), "name", "offset", "length", per_line.alias("bases_per_line"), F.coalesce("_bytes", F.col("length") + 1).alias("bytes_per_line"), "regular")


def byte_of(position: Column) -> Column:
    """Where a record's symbol stands in its file; null for a record without symbols."""
    per_line = F.nullif(F.col("bases_per_line"), F.lit(0))
    return F.col("offset") + F.floor(position / per_line) * F.col("bytes_per_line") + F.pmod(position, per_line)


def _blocks(block: int, reach: int):
    kind = pa.schema([("file", pa.string()), ("_block", pa.int64()), ("_data", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for row in _rows(batches):
            if row["file"] != name:
                opened, name = _open(row["file"]), row["file"]
            at = row["_block"] * block
            data = opened.read_at(max(0, min(block + reach, opened.size() - at)), at)
            yield pa.RecordBatch.from_pylist([{"file": name, "_block": row["_block"], "_data": data}], kind)

    return read


def touched(windows: DataFrame, records: DataFrame, padded: bool = False, block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """The windows with the bytes they stand in (_from, _bytes, _block; null where out of bounds), the size of blocks and the longest window's bytes."""
    known = records.select("name", "file", "offset", "length", "bases_per_line", "bytes_per_line", "regular")
    w = windows.join(known, "name", "left")
    start, end = F.greatest("start", F.lit(0)), F.least("end", "length")
    valid = F.coalesce(in_bounds(F.col("start"), F.col("end"), F.col("length"), padded), F.lit(False))
    first = F.when(valid & ~F.col("regular"), F.raise_error(F.concat(F.lit("lines of unequal length in "), F.col("name")))).when(valid, byte_of(start))
    w = w.withColumn("_valid", valid).withColumn("_from", first.cast("long")).withColumn("_bytes", (byte_of(end - 1) + 1 - F.col("_from")).cast("long"))
    reach = w.agg(F.max("_bytes")).first()[0] or 0
    size = max(block, reach)  # so that a window ends in its first block's reach
    return w.withColumn("_block", F.floor(F.col("_from") / size)), size, reach


def fetch(windows: DataFrame, records: DataFrame, padded: bool = False, alphabet: Alphabet = DNA, block: int = BLOCK) -> DataFrame:
    """Windows (name, start, end, strand and any columns) with seq, as ``sequences.fetch`` gives it, from the files of ``records``."""
    w, size, reach = touched(windows, records, padded, block)
    wanted = w.filter("_block is not null").select("file", "_block").distinct()
    data = wanted.repartitionByRange("file", "_block").sortWithinPartitions("file", "_block").mapInArrow(_blocks(size, reach), "file string, _block long, _data binary")
    joined = w.join(data, ["file", "_block"], "left")
    raw = F.substring("_data", (F.col("_from") - F.col("_block") * size + 1).cast("int"), F.col("_bytes").cast("int"))
    plain = F.coalesce(F.translate(raw.cast("string"), "\r\n", ""), F.lit(""))  # nothing but padding in a record without symbols
    turned = on_strand(plain, alphabet)
    left = F.repeat(F.lit(alphabet.unknown), F.greatest(-F.col("start"), F.lit(0)).cast("int"))
    right = F.repeat(F.lit(alphabet.unknown), F.greatest(F.col("end") - F.col("length"), F.lit(0)).cast("int"))
    found = F.concat(left, turned, right) if padded else turned
    return joined.withColumn("seq", F.when(F.col("_valid"), found).otherwise(F.lit(""))).select(*windows.columns, "seq")


def catalogue(records: DataFrame) -> DataFrame:
    """Names and lengths, without reading any sequence."""
    return records.select("name", "length").orderBy("name")
