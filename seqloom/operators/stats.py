"""Statistics per feature: rank tests, false discovery rates, quantile transforms, intervals of means."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import ranks


def rank_sum(df: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """U of the rows where ``group`` is true, with the tie-corrected normal score for 'greater'; from counts by value alone."""
    levels = ranks.running(df, [key], value, F.col(group))
    sums = levels.groupBy(key).agg(
        F.sum(F.col("p") * ranks.average_rank()).alias("r"), F.max("p_all").alias("n1"), F.max("n_all").alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties")
    )
    s = sums.withColumn("n2", F.col("n") - F.col("n1"))
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.try_divide(F.col("ties"), F.col("n") * (F.col("n") - 1)))
    z = F.try_divide(u - F.col("n1") * F.col("n2") / 2 - 0.5, F.sqrt(var))
    return s.select(key, u.alias("u"), z.alias("z"))


def upper_tail(df: DataFrame, z: str = "z", out: str = "p") -> DataFrame:
    """The normal upper tail, one Arrow batch at a time (one row per feature)."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else math.erfc(v / math.sqrt(2)) / 2)

    return df.withColumn(out, tail(F.col(z)))


def false_discovery(df: DataFrame, p: str, out: str = "q", buckets: int = 1024) -> DataFrame:
    """Benjamini-Hochberg over all rows. Null values have no q and do not count.

    Ranks and running minima are found within buckets of the values, over distinct values; what carries over from bucket to
    bucket is one row for each of at most ``buckets`` + 1 of them, so no window holds the whole table.
    """
    bucket = F.least(F.greatest(F.floor(F.col("_p") * buckets), F.lit(0)), F.lit(buckets)).cast("int")
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket)
    up = Window.partitionBy("_bucket").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_bucket").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.groupBy("_bucket").agg(F.sum("_n").alias("_sum"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_m"))
    ranked = counts.join(F.broadcast(before), "_bucket").withColumn("_rank", F.col("_before") + F.sum("_n").over(up))
    ranked = ranked.withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank"))
    least = ranked.groupBy("_bucket").agg(F.min("_raw").alias("_least"))
    after = least.select("_bucket", F.min("_least").over(later).alias("_after"))
    own = ranked.join(F.broadcast(after), "_bucket").select("_p", F.least(F.min("_raw").over(down), F.col("_after"), F.lit(1.0)).alias(out))
    return df.join(own, F.col(p) == F.col("_p"), "left").drop("_p")


def normal_scores(df: DataFrame, key: str, value: str, out: str = "normal") -> DataFrame:
    """Each value's quantile, by average rank, mapped to a standard normal."""
    place = F.try_divide(ranks.average_rank() - 1, F.col("n_all") - 1)
    shares = ranks.running(df, [key], value).select(key, value, F.least(F.greatest(place, F.lit(1e-7)), F.lit(1 - 1e-7)).alias("_share"))
    share = df.join(shares, [key, value])

    @F.pandas_udf("double")
    def inverse(x: pd.Series) -> pd.Series:
        quantile = NormalDist().inv_cdf
        return x.map(lambda v: None if v is None or v != v else quantile(v))

    return share.withColumn(out, inverse(F.col("_share"))).drop("_share")


def _t_quantile(df: float, p: float = 0.975) -> float:
    """The t quantile by bisection on the regularised incomplete beta, itself by its continued fraction."""
    def beta(x, a, b):
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        f, c, d = 1.0, 1.0, 0.0
        for i in range(400):
            m = i // 2
            num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + num * d if abs(1 + num * d) > 1e-30 else 1e-30)
            c = 1 + num / c if abs(1 + num / c) > 1e-30 else 1e-30
            f *= c * d
        return front * (f - 1) / a

    def cdf(t):
        x = df / (df + t * t)
        x = min(max(x, 1e-15), 1 - 1e-15)
        tail = beta(x, df / 2, 0.5) / 2 if x < (df / 2 + 1) / (df / 2 + 2.5) else (1 - beta(1 - x, 0.5, df / 2)) / 2
        return 1 - tail

    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return low


def mean_interval(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, standard error and the half width of the 95 % t interval."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {v: _t_quantile(v - 1) if v > 1 else None for v in set(n)}
        return n.map(known)

    s = df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("n"))
    s = s.withColumn("sem", F.col("_sd") / F.sqrt("n"))
    return s.select(key, "mean", "sem", "n", (F.col("sem") * quantile(F.col("n"))).alias("half_width"))


def keep_above_percentile(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows at or above an exact, interpolated percentile."""
    cut = df.agg(F.percentile(value, share).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).filter(F.col(value) >= F.col("_cut")).drop("_cut")
