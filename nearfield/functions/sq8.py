"""8-bit scalar quantization: one mean per dimension, one scale for all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sq8_encode(vector: Column, mean: Sequence[float], scale: float) -> Column:
    """clamp(round-half-even((x - mean) / scale), -127, 127) of each component, as array<tinyint>."""
    means = F.lit([float(m) for m in mean]).cast("array<double>")
    code = lambda x, m: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint((x.cast("double") - m) / F.lit(float(scale))))).cast("tinyint")
    return F.zip_with(vector, means, code)


def sq8_distance(codes: Column, query: Sequence[int]) -> Column:
    """Squared distance of codes in integers, as bigint; null for null codes or codes of another length."""
    literal = F.lit([int(x) for x in query]).cast("array<int>")
    terms = F.zip_with(codes, literal, lambda a, b: (a.cast("int") - b) * (a.cast("int") - b))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))
