"""Scan of 16-bit floats with exact rerank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.half import half_distance, half_encode
from ..functions.vectors import checked_query, l2_squared


def half_table(base: DataFrame, vector: str = "embedding", to: str = "halves") -> DataFrame:
    """base with its vectors as 16-bit floats: what is stored for half_top_k."""
    return base.withColumn(to, half_encode(F.col(vector)))


def half_top_k(
    stored: DataFrame, query: Sequence[float], k: int, vector: str | None = "embedding", id: str = "vec_id", where: Column | str | None = None,
    candidates: int | None = None, halves: str = "halves",
) -> DataFrame:
    """Top k of the rows that satisfy the predicate, by 16-bit floats, then by exact distance; `d2` added.

    candidates (2k and 64 at least) bounds what is reranked; without a vector column the order and
    `d2` are those of the rounded components. The predicate holds before the scan, so the result is
    short only where fewer than k rows match. Null vectors never rank; ties go by id.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    query = checked_query(query)
    rows = stored.where(where) if where is not None else stored
    rows = rows.where(F.col(halves).isNotNull()).withColumn("_h", half_distance(F.col(halves), query))
    if vector is None:
        return rows.withColumnRenamed("_h", "d2").orderBy("d2", id).limit(k)
    near = rows.orderBy("_h", id).limit(max(candidates or 0, 2 * k, 64)).drop("_h")
    return near.withColumn("d2", l2_squared(F.col(vector), query)).orderBy("d2", id).limit(k)
