"""Text lines with their exact numbers, from splits that are read apart, and rows written in order over many files.

A split knows the order of its own lines. How many lines stand before it is a sum over the splits before, one row each, so numbers need no
sort, no shuffle of the lines and no task that reads a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.sources import tables


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_at``, the place of each row in its split; rows of a split come one after the other."""
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, splits = batch.column("file"), batch.column("_split").to_numpy()
        new = np.flatnonzero(pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False) | (splits[1:] != splits[:-1])) + 1
        at = np.empty(n, dtype=np.int64)
        for start, stop in zip([0, *new.tolist()], [*new.tolist(), n], strict=True):
            split = files[start].as_py(), int(splits[start])
            seen = seen if split == last else 0
            at[start:stop] = np.arange(seen, seen + stop - start)
            last, seen = split, seen + stop - start
        yield batch.append_column("_at", pa.array(at))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (its number from 0 over all files, by name), file_line (in its file) and value."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), "value")
    counts = raw.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    files = counts.groupBy("file").agg(F.sum("_n").alias("_all"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("file", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_files"))
    carried = counts.select("file", "_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).join(files, "file")
    placed = raw.mapInArrow(_places, "file string, _split long, value string, _at long")
    rows = placed.join(tables.small(carried, 1 << 20), ["file", "_split"])
    own = F.col("_before") + F.col("_at")
    return rows.select("file", (own + F.col("_files")).alias("line"), own.alias("file_line"), "value")


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows ranged over partitions and sorted within, so that the files a writer makes hold them in order, one after the other."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)
