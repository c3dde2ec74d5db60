"""Splits, weighted draws and candidate filters. Randomness is a pure function of (seed, row).

No partition order and no generator state enters a draw, so results repeat on any cluster layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, count
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.search import interval_number

MODULUS = 2147483647
FACTORS = (48271, 1597334677, 1103515245)
MODES = ("train", "validate", "test")
VALIDATE_SIZE, TEST_SIZE = 32_000, 640_000  # T16
LEAST_WEIGHT = 1e-10


def draw(row: Column, seed: int, stream: int = 0) -> Column:
    """A number from 0 to MODULUS - 1 from the row's number: congruences with an exclusive or of the high bits between them.

    One congruence alone keeps the order of small row numbers, and the last bit of its draws alternates.
    """
    modulus = F.lit(MODULUS).cast("long")
    first = F.pmod(F.pmod(row.cast("long"), modulus) * FACTORS[0] + F.lit(seed + 7919 * stream).cast("long"), modulus)
    second = F.pmod(first * FACTORS[1], modulus)
    return F.pmod(second.bitwiseXOR(F.shiftright(second, 13)) * FACTORS[2], modulus)


def uniform(row: Column, seed: int, stream: int = 0) -> Column:
    return draw(row, seed, stream) / F.lit(float(MODULUS))


def split_by_chromosome(df: DataFrame, chrom: Column, validate: Sequence, test: Sequence) -> DataFrame:
    """Validate wins over test."""
    split = F.when(chrom.isin(*validate), "validate").when(chrom.isin(*test), "test").otherwise("train")
    return df.withColumn("split", split)


def split_by_proportion(df: DataFrame, row: Column, seed: int, validate: float, test: float = 0.0) -> DataFrame:
    """In a shuffled order the first int(n v) rows validate, the next int(n t) test, the others train.

    The cut points are exact order statistics of the draw, found by counting per bucket of it, so no task sorts all rows.
    """
    keyed = df.withColumn("_draw", draw(row, seed)).withColumn("_row", row.cast("long"))
    ranked = global_rank(keyed, "_draw", "_row")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = ranked.crossJoin(F.broadcast(n))
    first, second = F.floor(F.col("_n") * validate), F.floor(F.col("_n") * test)
    split = F.when(F.col("_rank") <= first, "validate").when(F.col("_rank") <= first + second, "test").otherwise("train")
    return out.withColumn("split", split).drop("_draw", "_row", "_rank", "_n")


def global_rank(df: DataFrame, by: str, tie: str, buckets: int = 1024) -> DataFrame:
    """``_rank`` from 1 in the order of a draw: ranks within buckets of it plus the counts of the buckets before."""
    width = MODULUS // buckets + 1
    bucketed = df.withColumn("_bucket", F.floor(F.col(by) / width))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    sizes = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_bucket").orderBy(by, tie)
    ranked = bucketed.withColumn("_within", F.row_number().over(within)).join(F.broadcast(sizes), "_bucket")
    return ranked.withColumn("_rank", F.col("_within") + F.col("_before")).drop("_bucket", "_within", "_before")


def head_split(df: DataFrame, order: Sequence[str], share: float) -> DataFrame:
    """The first floor(p n) rows of a small ordered list train, the others validate."""
    position = F.row_number().over(Window.orderBy(*order))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return df.withColumn("split", F.when(position <= F.floor(total * share), "train").otherwise("validate"))


def weights(intervals: DataFrame, length: Column) -> DataFrame:
    """Length over total length; rows below the floor go, and the others are renormalised until none does."""
    rows = intervals.withColumn("_length", length.cast("double"))
    total = rows.agg(F.sum("_length")).first()[0] or 0.0
    while total > 0:
        kept = rows.filter(F.col("_length") / total >= LEAST_WEIGHT)
        smaller = kept.agg(F.sum("_length")).first()[0] or 0.0
        rows = kept
        if smaller == total:
            break
        total = smaller
    return rows.withColumn("weight", F.col("_length") / F.lit(total or 1.0)).drop("_length")


@dataclass(frozen=True)
class IntervalIndex:
    """Intervals laid end to end, group by group and block by block, so that a number below the total length falls into one of them."""

    key: str
    ends: list[int]  # of the blocks, which are few
    per_block: DataFrame  # _number, _block, _block_start, _block_length
    placed: DataFrame  # key, _block, _start, _end inside the block
    groups: dict[int, tuple[int, int]]  # where each group starts, and its length


def interval_index(intervals: DataFrame, key: str, length: Column, blocks: int = 1024, group: Column | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> IntervalIndex:
    """The index of ``intervals`` by length; ``group`` is a small number from 0, ``keep`` can store the placed intervals for later use."""
    block = (F.lit(0) if group is None else group.cast("int")) * blocks + F.pmod(F.col(key), F.lit(blocks)).cast("int")
    lengths = intervals.select(key, length.cast("long").alias("_length"), block.alias("_block")).filter("_length > 0")
    sums = {r["_block"]: r["n"] for r in lengths.groupBy("_block").agg(F.sum("_length").alias("n")).collect()}  # one row per block
    order = sorted(sums)
    ends = list(accumulate(sums[b] for b in order))
    kind = "_number int, _block int, _block_start long, _block_length long"
    per_block = intervals.sparkSession.createDataFrame([(i, b, ends[i] - sums[b], sums[b]) for i, b in enumerate(order)], kind)
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    placed = lengths.withColumn("_end", F.sum("_length").over(inside)).withColumn("_start", F.col("_end") - F.col("_length"))
    groups: dict[int, tuple[int, int]] = {}
    for b, end in zip(order, ends, strict=True):
        start, total = groups.get(b // blocks, (end - sums[b], 0))
        groups[b // blocks] = (start, total + sums[b])
    return IntervalIndex(key, ends, per_block, keep(placed), groups)


def weighted_draws(intervals: DataFrame, key: str, length: Column, n: int, seed: int, blocks: int = 1024, first: int = 0) -> DataFrame:
    """``n`` draws with replacement by length, each with a position inside its interval and a strand; ``first`` is the first one's number."""
    numbers = intervals.sparkSession.range(first, first + n).withColumnRenamed("id", "draw_id")
    return placed_draws(numbers, interval_index(intervals, key, length, blocks), {0: seed}, n)


def placed_draws(numbers: DataFrame, index: IntervalIndex, seeds: Mapping[int, int], expected: int, group: Column | None = None) -> DataFrame:
    """The draws ``numbers`` (draw_id and any columns) with key, offset, strand: where they fall; draws of a group without intervals are left out.

    A draw is a number below its group's length; the interval it falls into is found in two steps, by block of
    intervals (few) and within the block, so neither side is multiplied by the other. ``seeds`` has a seed for each group, and ``expected`` draws
    set how fine the second step is.
    """
    group = F.lit(0) if group is None else group

    def of_group(value: Callable[[int], Column]) -> Column:
        return reduce(lambda out, g: F.when(group == g, value(g)).otherwise(out), index.groups, F.lit(None).cast("long"))

    # Two congruences make one number of up to 62 bits, so that totals above 2^31 are covered evenly.
    wide = lambda g: draw(F.col("draw_id"), seeds[g]) * MODULUS + draw(F.col("draw_id") + 1, seeds[g], 1)
    at = of_group(lambda g: F.lit(index.groups[g][0]) + F.pmod(wide(g), F.lit(index.groups[g][1])))
    strand = of_group(lambda g: draw(F.col("draw_id"), seeds[g], 2) % 2)
    draws = numbers.withColumns({"_at": at, "strand": F.when(strand == 0, "+").otherwise("-")}).filter("_at is not null")
    found = draws.withColumn("_number", interval_number(F.col("_at"), index.ends)).join(F.broadcast(index.per_block), "_number")
    found = found.withColumn("_in_block", F.col("_at") - F.col("_block_start"))
    # Within the block, intervals and draws meet by coarse cells of the block's length.
    cell = F.greatest((F.col("_block_length") / max(1, isqrt(expected))).cast("long"), F.lit(1))
    left = found.withColumn("_cell", F.floor(F.col("_in_block") / cell))
    right = index.placed.join(F.broadcast(index.per_block.select("_block", "_block_length")), "_block")
    right = right.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_start") / cell), F.floor((F.col("_end") - 1) / cell)))).drop("_block_length")
    hit = left.join(right, ["_block", "_cell"]).filter((F.col("_in_block") >= F.col("_start")) & (F.col("_in_block") < F.col("_end")))
    return hit.select(*[c for c in numbers.columns], index.key, (F.col("_in_block") - F.col("_start")).alias("offset"), "strand")


def accepted(candidates: DataFrame, n: int, order: str = "draw_id") -> DataFrame:
    """The first ``n`` accepted candidates in draw order, or all of them if they are fewer."""
    return candidates.orderBy(order).limit(n)


def accepted_draws(draws: Callable[[int], DataFrame], accept: Callable[[DataFrame], DataFrame], n: int, order: str = "draw_id", rounds: int = 12) -> DataFrame:
    """The first ``n`` draws that ``accept`` lets through. ``draws(m)`` gives the first m draws.

    Draws are a function of their number, so a further round only asks for more of them, by the share accepted so far.
    An error if after ``rounds`` rounds too few were accepted.
    """
    tried, found = max(1, n), 0
    for _ in range(rounds):
        passed = accept(draws(tried))
        found = passed.count()
        if found >= n:
            return accepted(passed, n, order)
        tried = min(16 * tried, max(2 * tried, tried * n // max(found, 1) * 5 // 4))
    raise ValueError(f"{found} draws were accepted in {rounds} rounds, {n} are wanted")


def endless(draws: Callable[[int, int], DataFrame], size: int, first: int = 0) -> Iterator[DataFrame]:
    """Batch after batch without end; ``draws(first, n)`` gives n draws from number ``first`` on."""
    for start in count(first, size):
        yield draws(start, size)


def shuffled(df: DataFrame, row: Column, seed: int) -> DataFrame:
    """``place`` from 0 in the order of a draw by the row's number. Rows that share a number are in no set order."""
    keyed = df.withColumn("_draw", draw(row, seed)).withColumn("_row", row.cast("long"))
    return global_rank(keyed, "_draw", "_row").withColumn("place", F.col("_rank") - 1).drop("_draw", "_row", "_rank")


def sample_rows(df: DataFrame, row: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, or all if they are fewer: the first places of the shuffled table."""
    return shuffled(df, row, seed).filter(F.col("place") < n)


def loaded(df: DataFrame, row: str, size: int, subset: tuple[int, int] | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """The rows numbered from subset[0] to below subset[1] (or all, from 0), in order or shuffled, with ``place`` and ``batch_id``."""
    start = subset[0] if subset else 0
    rows = df.filter((F.col(row) >= start) & (F.col(row) < subset[1])) if subset else df
    placed = rows.withColumn("place", F.col(row) - start) if shuffle_seed is None else shuffled(rows, F.col(row), shuffle_seed)
    return batches(placed, F.col("place"), size)


def by_mode(parts: Mapping[str, DataFrame]) -> DataFrame:
    """The samples of several modes as one table with the column ``mode``, by which a filter reads one of them alone."""
    if unknown := sorted(set(parts) - set(MODES)):
        raise ValueError(f"modes must be among {MODES}: {unknown}")
    if not parts:
        raise ValueError("no mode has samples")
    return reduce(DataFrame.unionByName, [df.withColumn("mode", F.lit(m)) for m, df in parts.items()])


def defaults(validate: int | None = None, test: int | None = None) -> dict[str, int]:
    """How many samples to validate and to test with where no number is given."""
    return {"validate": VALIDATE_SIZE if validate is None else validate, "test": TEST_SIZE if test is None else test}


def has_positive(labels: Column, sample_negative: bool = False) -> Column:
    """Some label of the array is positive, or samples without one are wanted too."""
    return F.lit(True) if sample_negative else F.exists(labels, lambda x: x > 0)


def retrieved(seq: Column) -> Column:
    """The sequence was found and is not empty."""
    return F.coalesce(F.length(seq) > 0, F.lit(False))


def long_enough(seq: Column, length: int) -> Column:
    """P10: the window has ``length`` symbols at least."""
    return F.coalesce(F.length(seq) >= length, F.lit(False))


def complete(seq: Column, length: int, unknown: str = "N") -> Column:
    """Exactly ``length`` symbols, none of them unknown."""
    return F.coalesce((F.length(seq) == length) & ~F.contains(seq, F.lit(unknown)), F.lit(False))


def held_out(chrom: Column, start: Column, chroms: Sequence) -> Column:
    """Regions of the held-out chromosomes that start inside their chromosome."""
    return F.coalesce(chrom.isin(*chroms) & (start >= 0), F.lit(False))


def batches(df: DataFrame, order: Column, size: int) -> DataFrame:
    """Batch numbers for a list in order; the last batch is short. ``order`` counts from 0."""
    return df.withColumn("batch_id", F.floor(order / size))


def cyclic(df: DataFrame, position: str, n: int, size: int) -> DataFrame:
    """``n`` rows read in turn, over and over, from a list of ``size`` rows numbered from 0."""
    turns = df.sparkSession.range(n).withColumnRenamed("id", "turn")
    return turns.withColumn(position, F.col("turn") % size).join(df, position)


def excluded(chrom: Column, parts: Sequence[str]) -> Column:
    """Whether any of the parts stands inside the chromosome's name."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(chrom, F.lit(part))
    return out
