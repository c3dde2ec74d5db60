"""The search among constant bounds."""

from bisect import bisect_right

from pyspark.sql import functions as F

from seqloom.functions.search import interval_number


def test_the_value_stands_once_in_the_expression(spark):
    bounds = [7 * i // 2 for i in range(1, 700)]
    found = interval_number(F.col("draw_number") * 2, bounds)
    assert str(found).count("draw_number") == 1
    rows = spark.range(0, 1300).withColumnRenamed("id", "draw_number").select("draw_number", found.alias("n")).collect()
    assert [r["n"] for r in rows] == [bisect_right(bounds, 2 * r["draw_number"]) for r in rows]
    assert spark.range(1).select(interval_number(F.lit(3), []), interval_number(F.lit(3), [3])).first()[:] == (0, 1)
