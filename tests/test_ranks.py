"""Bucketed ranks equal brute force, and no window holds a whole feature."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.operators import metrics, ranks, stats


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows = [("hot", i, rng.randrange(2), round(rng.gauss(0, 1), rng.choice([1, 6])) + 0.0) for i in range(900)]
    rows += [("few", i, i % 2, float(i % 3)) for i in range(40)] + [("one", 0, 1, 0.5), ("ties", 1, 1, 2.0), ("ties", 2, 0, 2.0)]
    rows += [("hot", 1000, 1, float("nan")), ("hot", 1001, 1, None)]
    return spark.createDataFrame(rows, "feature string, id long, target int, score double").repartition(5)


def by_feature(scored):
    out = {}
    for r in scored.filter("score is not null").collect():
        out.setdefault(r["feature"], []).append((r["score"], r["target"]))
    return {f: sorted(v, key=lambda x: (math.isnan(x[0]), x[0])) for f, v in out.items()}


@pytest.mark.parametrize("size", [7, 50, None])
def test_running_counts(spark, scored, size):
    rows = ranks.running(scored, ["feature"], "score", F.col("target") == 1, size)
    got = {(r["feature"], repr(r["score"])): r for r in rows.collect()}
    known = by_feature(scored)
    assert len(got) == sum(len({repr(s) for s, _ in v}) for v in known.values())
    for feature, values in known.items():
        n = p = 0
        for level in dict.fromkeys(repr(s) for s, _ in values):
            here = [t for s, t in values if repr(s) == level]
            n, p = n + len(here), p + sum(here)
            r = got[feature, level]
            assert (r["n"], r["p"], r["n_upto"], r["p_upto"], r["n_all"], r["p_all"]) == (len(here), sum(here), n, p, len(values), sum(t for _, t in values))
    if size == 7:
        buckets = ranks.levels(scored, ["feature"], "score", size=size).groupBy("feature", "_bucket").count()
        assert buckets.filter("feature = 'hot'").count() > 20 and buckets.agg(F.max("count")).first()[0] < 40


def test_metrics_and_statistics_do_not_depend_on_the_buckets(spark, scored, monkeypatch):
    clean = scored.filter("score is not null and not isnan(score)")
    jobs = [
        lambda: metrics.roc_auc(clean), lambda: metrics.average_precision(clean), lambda: metrics.roc_points(clean), lambda: metrics.precision_recall_points(clean),
        lambda: metrics.spearman(clean), lambda: stats.rank_sum(clean, "feature", "score", "positive"), lambda: stats.normal_scores(clean, "feature", "score"),
    ]
    clean = clean.withColumn("positive", F.col("target") == 1)
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    whole = [repr(rounded(job())) for job in jobs]
    monkeypatch.setattr(ranks, "LEVELS", 11)
    assert [repr(rounded(job())) for job in jobs] == whole


def test_no_window_by_feature_alone(spark, scored, monkeypatch):
    scored = scored.withColumn("positive", F.col("target") == 1)
    monkeypatch.setattr(ranks, "LEVELS", 11)
    for df in (metrics.roc_auc(scored), metrics.roc_points(scored), stats.normal_scores(scored, "feature", "score"), stats.rank_sum(scored, "feature", "score", "positive")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)
        assert windows and all("_bucket" in w for w in windows), plan


def test_auc_by_pairs(spark, scored):
    got = {r["feature"]: r["roc_auc"] for r in metrics.roc_auc(scored.filter("score is not null and not isnan(score)")).collect()}
    for feature, values in by_feature(scored.filter("score is not null and not isnan(score)")).items():
        a, b = [s for s, t in values if t], [s for s, t in values if not t]
        pairs = [(x > y) + (x == y) / 2 for x in a for y in b]
        assert got[feature] is None if not pairs else got[feature] == pytest.approx(sum(pairs) / len(pairs))


def test_two_step_search(spark):
    bounds = [float(i) for i in range(0, 200, 3)]
    df = spark.createDataFrame([(bounds, x / 2) for x in range(-4, 420)], "b array<double>, x double")
    assert all(r["k"] == sum(b < r["x"] for b in bounds) for r in df.select("x", ranks.below(F.col("b"), F.col("x"), 67).alias("k")).collect())
