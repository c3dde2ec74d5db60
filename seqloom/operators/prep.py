"""Preparation of label tables: unions, names, orders, selections, standardisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_profiles(*profiles: DataFrame) -> DataFrame:
    """pd.concat of profiles with the same columns: UNION ALL by name."""
    return reduce(DataFrame.unionByName, profiles)


def numbered_duplicates(files: DataFrame, feature: str = "feature", order: str = "file") -> DataFrame:
    """The second and later file of a feature get ``.1``, ``.2`` after the name, in file order."""
    n = F.row_number().over(Window.partitionBy(feature).orderBy(order)) - 1
    name = F.when(n > 0, F.concat_ws(".", feature, n.cast("string"))).otherwise(F.col(feature))
    return files.withColumn("name", name)


def distinct_features(df: DataFrame, feature: str = "feature") -> DataFrame:
    """A23."""
    return df.select(feature).distinct().orderBy(feature)


def genome_order(df: DataFrame) -> DataFrame:
    """Natural order of chromosome names (digits as numbers), then start and end."""
    padded = F.regexp_replace("chrom", r"([0-9]+)", "0000000000$1")
    natural = F.regexp_replace(padded, r"0*([0-9]{10})(?![0-9])", "$1")
    return df.orderBy(natural, "start", "end")


def feature_parts(name: Column) -> dict[str, Column]:
    """Cell, target and treatment of ``cell|target|treatment``."""
    parts = F.split(name, r"\|")
    return {k: F.get(parts, F.lit(i)) for i, k in enumerate(("cell", "target", "treatment"))}


def is_factor(target: Column) -> Column:
    """Neither DNase nor a histone mark."""
    return (target != "DNase") & ~target.rlike("^H[0-9]")


def of_features(df: DataFrame, names: DataFrame, feature: str = "feature") -> DataFrame:
    """J8."""
    return df.join(names.select(feature), feature, "left_semi")


def with_metadata(files: DataFrame, metadata: DataFrame, file: str = "file") -> DataFrame:
    """Every file with the columns of its metadata row, null where it has none."""
    return files.join(metadata, file, "left")


def by_q(df: DataFrame, q: str = "q", feature: str = "feature") -> DataFrame:
    """T4: features by their q, least first; rows without one come last."""
    return df.orderBy(F.asc_nulls_last(q), feature)


def top_split(df: DataFrame, by: str, tie: str, n: int, test: int) -> DataFrame:
    """T5: the ``n`` rows of greatest ``by``; the first ``test`` of them are the test set. ``n`` is the report's size."""
    top = df.orderBy(F.desc(by), tie).limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc(by), tie))
    return top.withColumn("split", F.when(rank <= test, "test").otherwise("train"))


def standardised(df: DataFrame, value: str, train: Column, out: str = "z") -> DataFrame:
    """Z-scores by the population mean and deviation of the training rows."""
    stats = df.filter(train).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def ordered_features(df: DataFrame, wanted: list[str], feature: str = "feature") -> DataFrame:
    """P20: a subset of features in the wanted order; unknown names are skipped."""
    names = F.array(*[F.lit(w) for w in wanted])
    return df.withColumn("feature_ix", (F.array_position(names, F.col(feature)) - 1).cast("int")).filter("feature_ix >= 0")


def feature_index(names: DataFrame) -> DataFrame:
    """feature_ix for a list in order of ``line``; a short list."""
    return names.withColumn("feature_ix", F.row_number().over(Window.orderBy("line")) - 1)


def thresholds(features: list[str], given) -> list[tuple[str, float | None]]:
    """A number, a mapping with ``default``, a function of the name, or None."""
    if given is None:
        return [(f, None) for f in features]
    if callable(given):
        return [(f, float(given(f))) for f in features]
    if isinstance(given, dict):
        return [(f, float(given.get(f, given.get("default", 0.0)))) for f in features]
    return [(f, float(given) if 0 < given <= 1 else 0.0) for f in features]
