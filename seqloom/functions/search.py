"""Search in short sorted lists, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_number(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``; in two steps of about sqrt(n) comparisons.

    The bounds are one constant each way, not an expression for each of them, and ``value`` is computed once, however long it is.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    heads, every = constant(bounds[::width]), constant(bounds)

    def number(v: Column) -> Column:
        upto = lambda array: F.size(F.filter(array, lambda x: x <= v))
        inside = lambda n: upto(F.slice(every, (n - 1) * width + 1, F.lit(width)))
        return F.transform(F.array(upto(heads)), lambda n: F.when(n == 0, 0).otherwise((n - 1) * width + inside(n)))[0]

    return F.transform(F.array(value), number)[0]
