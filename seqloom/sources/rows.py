"""Samples as bit-packed rows in parts of row numbers: ranges of rows read only their own parts, and are unpacked and cropped last.

A dataset is Parquet below one folder a part of ``ROWS`` row numbers. A row keeps its sequence as one bit for each
symbol and position (symbol after symbol, each filled up to whole bytes; an unknown symbol has all its bits set), and its
0/1 targets likewise. All sequences of a dataset have one length, all targets one number.

Defined cases: a null sequence is unknown throughout, null targets are zeros; another length is an error; an empty dataset reads as no rows;
ranges beyond the end are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.alphabet import DNA, Alphabet
from seqloom.sources import lines, tables

ROWS = 1 << 16  # row numbers to a part
SLICE = 1 << 24  # bytes of unpacked encodings held at once
STORED = "row_id long, seq binary, targets binary, part long"


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with row_id, its place from 0 in the given order: places in ordered files plus the rows of the files before."""
    spark, path = df.sparkSession, tables.folder(df.sparkSession, "ordered")
    lines.in_order(df, *order).write.parquet(path)
    raw = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    task = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(task, "_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    counts = raw.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return raw.join(tables.small(counts), "_file").select((F.col("_before") + F.col("_at")).alias("row_id"), *df.columns)


def _letters(column: pa.Array, length: int, unknown: str) -> np.ndarray:
    texts = [unknown * length if t is None else t for t in column.to_pylist()]
    if any(len(t) != length for t in texts):
        raise ValueError(f"all sequences must have {length} symbols")
    return np.frombuffer("".join(texts).encode("ascii", "replace"), dtype=np.uint8).reshape(len(texts), length)


def _pack(length: int, targets: int, alphabet: Alphabet):
    bases = np.frombuffer(alphabet.symbols.encode(), dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, SLICE // max(1, length * len(bases)))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                letters = _letters(batch.column("seq"), length, alphabet.unknown)
                same = letters[:, None, :] == bases[None, :, None]
                same |= ~same.any(axis=1, keepdims=True)
                marks = [[0] * targets if t is None else t for t in batch.column("targets").to_pylist()]
                if any(len(t) != targets for t in marks):
                    raise ValueError(f"all rows must have {targets} targets")
                bits = np.array(marks, dtype=np.int64).reshape(len(marks), targets) > 0
                packed = [pa.array([r.tobytes() for r in np.packbits(x, axis=-1)], pa.binary()) for x in (same, bits)]
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), *packed], ["row_id", "seq", "targets"])

    return run


def write(df: DataFrame, path: str, length: int, targets: int, alphabet: Alphabet = DNA, rows: int = ROWS) -> None:
    """K9: row_id (unique), seq and targets (0/1 numbers) as a dataset; one file a part, rows in order."""
    folded = df.select(F.col("row_id").cast("long"), alphabet.folded(F.col("seq")).alias("seq"), F.col("targets").cast("array<int>").alias("targets"))
    packed = folded.mapInArrow(_pack(length, targets, alphabet), "row_id long, seq binary, targets binary")
    parted = packed.withColumn("part", F.floor(F.col("row_id") / rows))
    parted.repartition("part").sortWithinPartitions("part", "row_id").write.partitionBy("part").parquet(path)


def _unpack(length: int, targets: int, symbols: int, first: int, last: int):
    used = max(0, last - first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, SLICE // max(1, 4 * used * symbols))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                n = batch.num_rows
                held = np.frombuffer(b"".join(batch.column("seq").to_pylist()), dtype=np.uint8).reshape(n, symbols, -1)
                # Only the bytes of the wanted positions are unpacked.
                bits = np.unpackbits(held[:, :, first // 8 : (last + 7) // 8], axis=-1)[:, :, first % 8 : first % 8 + used]
                values = bits.transpose(0, 2, 1).astype(np.float32)
                values[bits.all(axis=1)] = 1 / symbols
                inner = pa.ListArray.from_arrays(np.arange(n * used + 1, dtype=np.int32) * symbols, pa.array(values.reshape(-1)))
                outer = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * used, inner)
                marks = np.frombuffer(b"".join(batch.column("targets").to_pylist()), dtype=np.uint8).reshape(n, -1)
                marks = np.unpackbits(marks, axis=-1)[:, :targets].astype(np.int32)
                marks = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * targets, pa.array(marks.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), outer, marks], ["row_id", "sequence", "targets"])

    return run


def window(length: int, use: int | None = None, shift: int = 0) -> tuple[int, int]:
    """First and last position (exclusive) of ``use`` symbols around the middle, moved by ``shift``; all of them without ``use``."""
    if use is None:
        return 0, length
    first = length // 2 - (use + 1) // 2 + shift
    if first < 0 or first + use > length:
        raise ValueError(f"{use} symbols moved by {shift} do not fit into {length}")
    return first, first + use


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def _encodings(stored: DataFrame, length: int, targets: int, use: int | None, shift: int, alphabet: Alphabet) -> DataFrame:
    run = _unpack(length, targets, len(alphabet.symbols), *window(length, use, shift))
    return stored.select("row_id", "seq", "targets").mapInArrow(run, "row_id long, sequence array<array<float>>, targets array<int>")


def read(
    spark: SparkSession, path: str, length: int, targets: int, start: int = 0, stop: int | None = None,
    use: int | None = None, shift: int = 0, alphabet: Alphabet = DNA, rows: int = ROWS,
) -> DataFrame:
    """row_id, sequence (a row of numbers a position) and targets of the rows from ``start`` to ``stop`` (exclusive)."""
    stored = _stored(spark, path).filter((F.col("part") >= start // rows) & (F.col("row_id") >= start))
    if stop is not None:
        stored = stored.filter((F.col("part") <= (stop - 1) // rows) & (F.col("row_id") < stop))
    return _encodings(stored, length, targets, use, shift, alphabet)


def lookup(
    wanted: DataFrame, path: str, length: int, targets: int, number: int,
    use: int | None = None, shift: int = 0, alphabet: Alphabet = DNA, rows: int = ROWS,
) -> DataFrame:
    """S10 by row number: the rows that ``wanted`` (row_id) names; numbers count round the ``number`` rows of the dataset.

    Each distinct row is read once, however often it is asked for. Packed rows meet the numbers, encodings are made afterwards.
    """
    place = F.pmod(F.col("row_id").cast("long"), F.lit(number))
    asked = wanted.select(place.alias("row_id")).distinct().withColumn("part", F.floor(F.col("row_id") / rows))
    return _encodings(_stored(wanted.sparkSession, path).join(tables.small(asked), ["part", "row_id"]), length, targets, use, shift, alphabet)
