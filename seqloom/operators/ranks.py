"""Ranks and running counts of many values per key, in buckets with carried sums.

Values are first counted by (key, value): these levels are mergeable counts, combined before any shuffle. A key with many levels is cut at its own
approximate quantiles into buckets of about ``LEVELS`` levels; running sums are windows by (key, bucket), and what carries over is one row per
bucket, summed in a short array per key. So no window and no task holds a key's rows, however hot the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources import tables

LEVELS = 1 << 18  # of one bucket, about
MOST_BUCKETS = 1 << 14  # of a key


def below(bounds: Column, value: Column, many: int) -> Column:
    """How many of the sorted ``bounds`` (about ``many``) are below ``value``, in two steps of about sqrt(many) comparisons."""
    width = max(1, int(many**0.5))
    heads = F.filter(bounds, lambda b, i: (i % width == 0) & (b < value))
    inside = lambda n: F.size(F.filter(F.slice(bounds, (n - 1) * width + 1, width), lambda b: b < value))
    return F.transform(F.array(F.size(heads)), lambda n: F.when(n == 0, 0).otherwise((n - 1) * width + inside(n)))[0]


def levels(df: DataFrame, keys: list[str], value: str, positive: Column | None = None, size: int | None = None) -> DataFrame:
    """keys, value, _bucket, n (rows) and p (rows where ``positive``), one row per key and value, stored.

    Null values are left out; NaN is the greatest value.
    """
    marked = F.lit(0) if positive is None else F.coalesce(positive.cast("int"), F.lit(0))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.sum(marked.cast("long")).alias("p"))
    counts = tables.written(counts, "levels")
    size = size or LEVELS
    most = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    buckets = min(-(-most // size), MOST_BUCKETS)
    if buckets < 2:
        return counts.withColumn("_bucket", F.lit(0))
    # Bounds are approximate and may differ when computed again, so they are stored before rows are dealt by them.
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = tables.written(counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, F.lit(10 * buckets))).alias("_bounds")), "bounds")
    return counts.join(bounds, keys).withColumn("_bucket", below(F.col("_bounds"), F.col(value), buckets)).drop("_bounds")


def carried(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _bucket, n_before, p_before (in lower buckets), n_all, p_all: one row per bucket of ``levels``."""
    one = F.struct(F.col("_bucket").alias("b"), F.col("n"), F.col("p"))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_all"))
    start = F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p")))
    last = lambda out, c: F.element_at(out, -1)[c]
    running = F.aggregate("_all", start, lambda out, x: F.concat(out, F.array(F.struct((last(out, "n") + x["n"]).alias("n"), (last(out, "p") + x["p"]).alias("p")))))
    each = sums.withColumn("_sums", running).select(*keys, "_sums", F.posexplode(F.transform("_all", lambda x: x["b"])).alias("_i", "_bucket"))
    before, total = F.get("_sums", F.col("_i")), F.element_at("_sums", -1)
    return each.select(*keys, "_bucket", before["n"].alias("n_before"), before["p"].alias("p_before"), total["n"].alias("n_all"), total["p"].alias("p_all"))


def running(df: DataFrame, keys: list[str], value: str, positive: Column | None = None, size: int | None = None) -> DataFrame:
    """keys, value, n, p of each level, with n_upto, p_upto (rows at this value or lower) and n_all, p_all."""
    rows = levels(df, keys, value, positive, size)
    up = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"n_upto": F.sum("n").over(up), "p_upto": F.sum("p").over(up)}).join(carried(rows, keys), [*keys, "_bucket"])
    return summed.select(*keys, value, "n", "p", (F.col("n_upto") + F.col("n_before")).alias("n_upto"), (F.col("p_upto") + F.col("p_before")).alias("p_upto"), "n_all", "p_all")


def average_rank() -> Column:
    """Of a level of ``running``: the mean of its rows' ranks, counted from 1."""
    return F.col("n_upto") - (F.col("n") - 1) / 2
