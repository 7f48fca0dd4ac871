"""Percentile of a column by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cuts of one narrowing step, and distinct values that are looked through one by one.
CUTS, FEW = 256, 10_000


def column_percentile(base: DataFrame, column: str, fraction: float) -> DataFrame:
    """One row, `value`: at position floor(fraction * (n - 1)) of the n sorted non-null values; 0.0 if none.

    Values are counted first; a sketch of the distinct values gives cuts, exact counts between cuts
    say where the position lies, until few distinct values are left there. NaN sorts last.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction is between 0 and 1")
    values = base.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").count()
    n = values.agg(F.sum("count")).first()[0]
    if not n:
        return base.sparkSession.createDataFrame([(0.0,)], "value double")
    place = int(fraction * (n - 1))
    values = values.where(~F.isnan("x"))
    if place >= (values.agg(F.sum("count")).first()[0] or 0):
        return base.sparkSession.createDataFrame([(float("nan"),)], "value double")
    # the answer lies between bounds of a sketch that are narrowed by exact counts, never by partition numbers
    low, high, below = None, None, 0
    while True:
        within = values if low is None else values.where(((F.col("x") > low) | F.lit(low == float("-inf"))) & (F.col("x") <= high))
        distinct, most = within.agg(F.count("*"), F.max("x")).first()
        if distinct <= FEW:
            break
        cuts = sorted(set(within.agg(F.percentile_approx("x", [i / CUTS for i in range(1, CUTS)], 10 * CUTS)).first()[0]) | {most})
        slot = F.element_at(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c >= F.col("x")), 1)
        counts = {r["slot"]: r["n"] for r in within.groupBy(slot.alias("slot")).agg(F.sum("count").alias("n")).collect()}
        floor = low if low is not None else float("-inf")
        for cut in cuts:
            if place < below + counts.get(cut, 0):
                break
            below, floor = below + counts.get(cut, 0), cut
        if (floor, cut) == (low, high):
            break
        low, high = floor, cut
    for x, count in within.orderBy("x").toLocalIterator():
        if place < below + count:
            return base.sparkSession.createDataFrame([(x,)], "value double")
        below += count
