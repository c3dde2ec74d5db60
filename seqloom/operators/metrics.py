"""Metrics per feature over long (feature, target, score) tables, by ranks and running sums.

Scores are first counted by value, and running sums go over distinct values in buckets (``ranks``), so ties are handled together and no
task holds a feature.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import ranks
from seqloom.sources import tables


def eligible(df: DataFrame, key: str = "feature", target: str = "target", above: int = 10) -> DataFrame:
    """Rows of features whose number of nonzero targets, NaN left out, is above a threshold."""
    rows = df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    counts = rows.groupBy(key).agg(F.sum((F.col(target) != 0).cast("int")).alias("_positives"))
    return rows.join(counts.filter(F.col("_positives") > above).select(key), key, "left_semi")


def positives(df: DataFrame, key: str = "feature", target: str = "target") -> DataFrame:
    """A4."""
    return df.groupBy(key).agg(F.sum((F.col(target) != 0).cast("int")).alias("positives"))


def _levels(df: DataFrame, key: str, target: str, score: str) -> DataFrame:
    """Per feature and distinct score: positives p and rows n, tp and seen from the highest score down to it, and the feature's sums."""
    rows = ranks.running(df, [key], score, F.col(target) != 0)
    down = {"tp": F.col("p_all") - F.col("p_upto") + F.col("p"), "seen": F.col("n_all") - F.col("n_upto") + F.col("n")}
    return rows.withColumns(down).withColumnsRenamed({"p_all": "positives", "n_all": "rows"})


def roc_auc(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """By the rank sum with average ranks; null where only one class is present."""
    levels = _levels(df, key, target, score)
    found = levels.groupBy(key).agg(F.sum(F.col("p") * ranks.average_rank()).alias("r"), F.max("positives").alias("positives"), F.max("rows").alias("rows"))
    pairs = F.col("positives") * (F.col("rows") - F.col("positives"))
    return found.select(key, F.when(pairs > 0, (F.col("r") - F.col("positives") * (F.col("positives") + 1) / 2) / F.nullif(pairs, F.lit(0))).alias("roc_auc"))


def average_precision(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """The mean over positives of the precision at their score; null without positives."""
    levels = _levels(df, key, target, score)
    out = levels.groupBy(key).agg(F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("s"), F.sum("p").alias("positives"))
    return out.select(key, F.when(F.col("positives") > 0, F.col("s") / F.nullif(F.col("positives"), F.lit(0))).alias("average_precision"))


def roc_points(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """False and true positive rates at each distinct score."""
    levels = _levels(df, key, target, score)
    return levels.select(
        key, F.col(score).alias("threshold"), F.try_divide(F.col("seen") - F.col("tp"), F.col("rows") - F.col("positives")).alias("fpr"), F.try_divide("tp", "positives").alias("tpr")
    )


def precision_recall_points(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """A13."""
    levels = _levels(df, key, target, score)
    return levels.select(key, F.col(score).alias("threshold"), F.try_divide("tp", "seen").alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def average_ranks(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Ranks from 1 with ties averaged."""
    return df.join(ranks.running(df, [key], value).select(key, value, ranks.average_rank().alias(out)), [key, value])


def _correlation(x: Column, y: Column) -> Column:
    """Null where one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """A8."""
    return df.groupBy(key).agg(_correlation(F.col(target).cast("double"), F.col(score)).alias("pearson"))


def spearman(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """The correlation of average ranks."""
    both = df.select(key, target, score).filter(F.col(target).isNotNull() & F.col(score).isNotNull())
    ranked = average_ranks(average_ranks(both, key, score, "_rs"), key, target, "_rt")
    return ranked.groupBy(key).agg(_correlation(F.col("_rs"), F.col("_rt")).alias("spearman"))


def r_squared(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """From sums alone, one pass."""
    y, p = F.col(target).cast("double"), F.col(score)
    sums = df.groupBy(key).agg(F.sum((y - p) * (y - p)).alias("residual"), F.var_pop(y).alias("variance"), F.count(F.lit(1)).alias("n"))
    return sums.select(key, (1 - F.try_divide(F.col("residual"), F.col("variance") * F.col("n"))).alias("r2"))


def cross_entropy(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """Logarithms are not below -100."""
    log = lambda x: F.greatest(F.ln(F.greatest(x, F.lit(1e-300))), F.lit(-100.0))
    y, p = F.col(target).cast("double"), F.col(score)
    return df.groupBy(key).agg(F.avg(-(y * log(p) + (1 - y) * log(1 - p))).alias("bce"))


def squared_error(df: DataFrame, key: str = "feature", target: str = "target", score: str = "score") -> DataFrame:
    """A15."""
    gap = F.col(target).cast("double") - F.col(score)
    return df.groupBy(key).agg(F.avg(gap * gap).alias("mse"))


def mean_batch_loss(df: DataFrame, batch: str, loss: Column) -> DataFrame:
    """The unweighted mean of the batches' means."""
    return df.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("loss"))


def accuracy(df: DataFrame, scores: str, target: str) -> DataFrame:
    """One target column of class numbers, an array of class scores; the first of equal scores counts."""
    best = F.array_position(F.col(scores), F.array_max(scores)) - 1
    return df.agg(F.avg((best == F.col(target)).cast("double")).alias("accuracy"))


def macro_average(per_feature: DataFrame, metric: str) -> DataFrame:
    """A10: the mean over features that have the metric."""
    return per_feature.agg(F.avg(F.nanvl(F.col(metric), F.lit(None).cast("double"))).alias(metric))


class Metrics:
    """A registry of metrics by name. A metric takes a long table and returns (feature, value)."""

    def __init__(self, above: int = 10):
        self.above = above
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {"roc_auc": roc_auc, "average_precision": average_precision}

    def add(self, name: str, metric: Callable[[DataFrame], DataFrame]) -> None:
        self.known[name] = metric

    def add_function(self, name: str, function: Callable[[pd.Series, pd.Series], float]) -> None:
        """Any function of one feature's targets and scores. It gets a feature's rows at once: use built-ins where rows are many."""

        def of(df: DataFrame) -> DataFrame:
            def run(part: pd.DataFrame) -> pd.DataFrame:
                got = function(part["target"], part["score"])
                return pd.DataFrame({"feature": [part["feature"].iloc[0]], name: [float(got[0] if isinstance(got, tuple) else got)]})

            return df.select("feature", "target", "score").groupBy("feature").applyInPandas(run, f"feature string, {name} double")

        self.known[name] = of

    def remove(self, name: str) -> Callable:
        return self.known.pop(name)

    def compute(self, df: DataFrame) -> DataFrame:
        """One row per feature, one column per metric; null where a feature has too few positives."""
        rows = tables.written(eligible(df, above=self.above), "eligible")
        out = df.select("feature").distinct()
        for name, metric in self.known.items():
            found = metric(rows)
            out = out.join(found.select("feature", F.col(found.columns[-1]).alias(name)), "feature", "left")
        return out


def performance_text(per_feature: DataFrame, metrics: list[str]) -> DataFrame:
    """K7: four decimals, ``NA`` for undefined."""
    text = lambda c: F.coalesce(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string("%.4f", F.col(c))), F.lit("NA")).alias(c)
    return per_feature.select("feature", *[text(m) for m in metrics])


def scores_by_feature(table: DataFrame, metric: str) -> DataFrame:
    """Feature and its score; a score that is not a number is null."""
    return table.select("feature", F.when(~F.isnan(metric), F.col(metric)).alias("score"))
