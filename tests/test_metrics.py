import random

import pytest

from seqloom.operators import interpret, metrics, stats


def table(spark, rows):
    return spark.createDataFrame(rows, "feature string, target int, score double")


def test_auc_and_average_precision_by_definition(spark):
    rng = random.Random(1)
    rows = [("f", rng.randrange(2), rng.randrange(8) / 8) for _ in range(80)] + [("g", 1, 0.3)]
    pos, neg = [s for f, t, s in rows if f == "f" and t], [s for f, t, s in rows if f == "f" and not t]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    ap = sum(sum(x >= a for x in pos) / sum(x >= a for x in pos + neg) for a in pos) / len(pos)
    got = {r["feature"]: r["roc_auc"] for r in metrics.roc_auc(table(spark, rows)).collect()}
    assert got["f"] == pytest.approx(auc) and got["g"] is None
    got = {r["feature"]: r["average_precision"] for r in metrics.average_precision(table(spark, rows)).collect()}
    assert got["f"] == pytest.approx(ap)


def test_registry(spark):
    rows = [("f", i % 2, i / 10) for i in range(10)] + [("g", 0, 0.1)]
    m = metrics.Metrics(above=2)
    m.add_function("top", lambda y, p: float(p.max()))
    m.remove("average_precision")
    got = {r["feature"]: r["top"] for r in m.compute(table(spark, rows)).collect()}
    assert got == {"f": 0.9, "g": None}
    text = {r["feature"]: r["top"] for r in metrics.performance_text(m.compute(table(spark, rows)), ["top"]).collect()}
    assert text == {"f": "0.9000", "g": "NA"}


def test_false_discovery_by_definition(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.04]
    got = stats.false_discovery(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()
    order = sorted(p)
    want = {x: min(1, *[order[k] * 5 / (k + 1) for k in range(5) if order[k] >= x]) for x in p}
    assert all(r["q"] == pytest.approx(want[r["p"]]) for r in got)


def test_t_quantile():
    assert stats._t_quantile(9) == pytest.approx(2.262157, abs=1e-5)
    assert stats._t_quantile(1) == pytest.approx(12.7062, abs=1e-3)


def test_rescale_zero_sum_is_null(spark):
    m = spark.createDataFrame([(0, "A", 0.0), (0, "C", 0.0)], "pos int, base string, score double")
    assert {r["score"] for r in interpret.rescale(m, [], "probability").collect()} == {None}
