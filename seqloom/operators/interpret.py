"""Interpretation of score matrices and variants: rescaling, logo offsets, orders, texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _check_scaling(base: str, position: str) -> None:
    kinds = ("identity", "probability", "max_effect")
    if base not in kinds or position not in kinds:
        raise ValueError(f"scaling must be one of {kinds}")


def rescaled(cells: Sequence[Column], base: str = "identity", position: str = "identity") -> list[Column]:
    """X29, C9 within a row: the scores of one position's bases, rescaled over bases, then over positions. Zero sums give null."""
    _check_scaling(base, position)
    low, total = F.least(*cells), reduce(add, cells)
    scaled = {"identity": list(cells), "probability": [F.try_divide(s, total) for s in cells], "max_effect": [s - low for s in cells]}[base]
    if position == "max_effect":
        spread, sums = F.greatest(*cells) - low, reduce(add, scaled)
        return [F.try_divide(s, sums) * spread for s in scaled]
    return [F.try_divide(s, total) for s in scaled] if position == "probability" else scaled


def rescale(matrix: DataFrame, key: list[str], base: str = "identity", position: str = "identity") -> DataFrame:
    """A long score matrix (pos, base, score), rescaled over bases, then over positions. Zero sums give null."""
    _check_scaling(base, position)
    at = Window.partitionBy(*key, "pos")
    s = F.col("score")
    low, high, total = (f("score").over(at) for f in (F.min, F.max, F.sum))
    rows = matrix.withColumn("_spread", high - low).withColumn("_total", total)
    scaled = {"identity": s, "probability": F.try_divide(s, total), "max_effect": s - low}[base]
    rows = rows.withColumn("_scaled", scaled)
    if position == "max_effect":
        rows = rows.withColumn("_scaled", F.try_divide(F.col("_scaled"), F.sum("_scaled").over(at)) * F.col("_spread"))
    elif position == "probability":
        rows = rows.withColumn("_scaled", F.try_divide(F.col("_scaled"), F.col("_total")))
    return rows.select(*key, "pos", "base", F.col("_scaled").alias("score"))


def offsets(cells: Sequence[Column], bases: Sequence[str]) -> list[Column]:
    """X46 within a row: where each of one position's letters starts: those of one sign stand on the smaller ones, equal ones by base."""

    def under(j: int, i: int) -> Column:
        smaller = (F.abs(cells[j]) <= F.abs(cells[i])) if bases[j] < bases[i] else (F.abs(cells[j]) < F.abs(cells[i]))
        return F.when(smaller & (F.signum(cells[j]) == F.signum(cells[i])), cells[j]).otherwise(F.lit(0.0))

    return [reduce(add, [under(j, i) for j in range(len(cells)) if j != i]) for i in range(len(cells))]


def logo_offsets(matrix: DataFrame, key: list[str]) -> DataFrame:
    """Where each letter of a logo starts: at each position, letters of one sign stand on the smaller ones."""
    w = Window.partitionBy(*key, "pos", F.signum("score")).orderBy(F.abs("score"), "base").rowsBetween(Window.unboundedPreceding, -1)
    return matrix.withColumn("offset", F.coalesce(F.sum("score").over(w), F.lit(0.0)))


def heatmap_order(matrix: DataFrame, bases: str) -> DataFrame:
    """The row of each base in a heat map, last base first."""
    row = F.lit(len(bases)) - F.instr(F.lit(bases), F.col("base"))
    return matrix.withColumn("row", row)


def chromosome_key(chrom: Column) -> Column:
    """1 to 22, X 23, Y 24, M 25, others 26."""
    name = F.substring(chrom, 4, 100)
    number = F.when(name.rlike("^([1-9]|1[0-9]|2[0-2])$"), name.try_cast("int"))
    return F.coalesce(number, F.when(name == "X", 23).when(name == "Y", 24).when(name == "M", 25).otherwise(26))


def variant_order(variants: DataFrame) -> DataFrame:
    """By chromosome key, position, ref, alt; unknown chromosomes by name."""
    return variants.orderBy(chromosome_key(F.col("chrom")), "chrom", "pos", "ref", "alt")


def variant_places(variants: DataFrame, tie: str, width: int = 1 << 16) -> DataFrame:
    """T1 as a column: ``place`` from 1 by chromosome key, chromosome, position and ``tie``.

    Rows are numbered within buckets of ``width`` positions of a chromosome; one row per bucket carries the counts before it.
    """
    rows = variants.withColumn("_key", chromosome_key(F.col("chrom"))).withColumn("_bucket", F.floor(F.col("pos") / width))
    bucket = ["_key", "chrom", "_bucket"]
    before = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).select(F.struct(*bucket).alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*bucket).orderBy("pos", tie))
    placed = rows.withColumn("_inside", inside).join(sizes, F.struct(*bucket).eqNullSafe(F.col("_at")))
    return placed.withColumn("place", F.col("_before") + F.col("_inside")).drop("_key", "_bucket", "_inside", "_before", "_at")


def hover_text(chrom: Column, pos: Column, ref: Column, alt: Column, genes: Column | None = None) -> Column:
    """A variant's label, with its genes if there are any."""
    label = F.concat_ws(" ", chrom, pos.cast("string"), F.concat_ws("/", ref, alt))
    return label if genes is None else F.when(F.size(genes) > 0, F.concat_ws("\n", label, F.array_join(genes, ", "))).otherwise(label)


def largest_difference(differences: Column) -> Column:
    """The greatest value over the features."""
    return F.array_max(differences)
