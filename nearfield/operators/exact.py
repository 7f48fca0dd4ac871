"""Exact filtered top-k: the definition every other path is held to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import checked_query, l2_squared


def filtered_top_k(
    base: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", id: str = "vec_id", where: Column | str | None = None, offset: int = 0
) -> DataFrame:
    """Rows k of base after `offset`, nearest first, that satisfy the predicate; column `d2` added.

    The whole predicate holds before ranking, so no result is short. Null vectors never rank; order
    is (squared distance, id). Spark keeps each partition's best rows only, so what moves is k rows
    a partition, whatever the base's size.
    """
    if k < 1 or offset < 0:
        raise ValueError("k is at least 1 and offset at least 0")
    query = checked_query(query)
    rows = base.where(where) if where is not None else base
    rows = rows.where(F.col(vector).isNotNull()).withColumn("d2", l2_squared(F.col(vector), query))
    ranked = rows.orderBy(F.asc_nulls_last("d2"), F.asc(id)).limit(k + offset)
    return ranked.offset(offset) if offset else ranked
