"""The numbers of draws as a Spark data source, in batches and as a stream whose offset is the next number of each mode.

A draw is a pure function of its number (``sampling.draw``), so the source hands out numbers only: a stream that starts again from its
checkpoint, a task that runs twice, and a batch over the same range all give the same draws.

Options: ``first`` and ``until`` (JSON, mode to number), ``per_task`` (numbers of one task); for streams also ``step`` (numbers of each mode in one
micro-batch) and ``reached`` (JSON: the offsets that an earlier run of this stream has come to).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "mode string, draw_id long"
PER_TASK = 1 << 20
ROWS = 1 << 16  # of one Arrow batch


@dataclass
class DrawRange(InputPartition):
    mode: str
    first: int
    until: int


def ranges(first: Mapping[str, int], until: Mapping[str, int], per_task: int) -> list[DrawRange]:
    """Each mode's numbers in ranges of at most ``per_task``."""
    return [DrawRange(m, at, min(at + per_task, until[m])) for m in sorted(until) for at in range(first.get(m, 0), until[m], per_task)]


def numbers(part: DrawRange | None) -> Iterator[pa.RecordBatch]:
    """The numbers of a range; Spark asks for None where there is no range at all."""
    if part is None:
        return
    for at in range(part.first, part.until, ROWS):
        ids = pa.array(range(at, min(at + ROWS, part.until)), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([part.mode] * len(ids), pa.string()), ids], ["mode", "draw_id"])


class DrawNumbers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "draws"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Bounds:
    def __init__(self, options):
        self.first, self.until = (json.loads(options.get(k, "{}")) for k in ("first", "until"))
        self.per_task = int(options.get("per_task", PER_TASK))

    def read(self, part: DrawRange | None) -> Iterator[pa.RecordBatch]:
        return numbers(part)


class _Batch(_Bounds, DataSourceReader):
    def partitions(self) -> list[DrawRange]:
        return ranges(self.first, self.until, self.per_task)


class _Stream(_Bounds, DataSourceStreamReader):
    """An offset is never below one that a run before has come to: ``reached`` says where that one was."""

    def __init__(self, options):
        super().__init__(options)
        self.step = int(options.get("step", PER_TASK))
        self.at = {m: self.first.get(m, 0) for m in self.until} | json.loads(options.get("reached", "{}"))

    def initialOffset(self) -> dict:
        return {m: self.first.get(m, 0) for m in self.until}

    def latestOffset(self) -> dict:
        return {m: max(at, min(at + self.step, self.until.get(m, at))) for m, at in self.at.items()}

    def partitions(self, start: dict, end: dict) -> list[DrawRange]:
        self.at = {m: max(at, end.get(m, at)) for m, at in self.at.items()}
        return ranges(start, end, self.per_task)


def read(spark: SparkSession, until: Mapping[str, int], first: Mapping[str, int] | None = None, per_task: int = PER_TASK) -> DataFrame:
    """mode, draw_id: each mode's numbers from ``first`` to below ``until``."""
    spark.dataSource.register(DrawNumbers)
    return spark.read.format("draws").options(first=json.dumps(first or {}), until=json.dumps(until), per_task=per_task).load()


def stream(spark: SparkSession, until: Mapping[str, int], step: int = PER_TASK, reached: Mapping[str, int] | None = None, per_task: int = PER_TASK) -> DataFrame:
    """The same as a stream; it ends at ``until`` and goes on from there when a later run names a greater one."""
    spark.dataSource.register(DrawNumbers)
    reader = spark.readStream.format("draws").options(until=json.dumps(until), step=step, per_task=per_task)
    return reader.option("reached", json.dumps(reached or {})).load()
