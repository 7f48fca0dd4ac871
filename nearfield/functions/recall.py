"""Recall and percentile conventions of the evaluation harness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall(truth: Column, found: Column) -> Column:
    """|truth & found| / |truth|; where truth is empty, 1 if nothing was found, else 0."""
    some = F.size(F.array_intersect(truth, found)) / F.size(truth)
    return F.when(F.size(truth) > 0, some).otherwise(F.when(F.size(found) == 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def percentile_index(n: int, p: float) -> int:
    """Place of the p-quantile among n sorted latencies."""
    return min(n - 1, int(p * n))
