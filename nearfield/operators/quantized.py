"""8-bit quantized scan with exact rerank."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sq8 import sq8_distance, sq8_encode
from ..functions.vectors import checked_query, l2_squared


@dataclass(frozen=True)
class Sq8:
    mean: tuple[float, ...]
    scale: float

    def encode(self, vector: Sequence[float]) -> list[int]:
        """As sq8_encode, for a query on the driver."""
        return [int(max(-127, min(127, round((x - m) / self.scale)))) for x, m in zip(vector, self.mean, strict=True)]


def sq8_statistics(base: DataFrame, vector: str = "embedding") -> DataFrame:
    """(pos, mean, least, most) of each dimension over non-null vectors."""
    return base.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.min(F.col("x").cast("double")).alias("least"), F.max(F.col("x").cast("double")).alias("most")
    )


def sq8_scale(statistics: DataFrame) -> Sq8:
    """Means and the one scale: the widest deviation from a mean over 127, or 1/127 if that is 0."""
    rows = sorted(statistics.collect())  # as many rows as dimensions
    if not rows:
        raise ValueError("there is no vector")
    widest = max(max(r["most"] - r["mean"], r["mean"] - r["least"]) for r in rows)
    return Sq8(tuple(r["mean"] for r in rows), (widest if widest > 0 else 1.0) / 127)


def sq8_table(base: DataFrame, sq8: Sq8, vector: str = "embedding", to: str = "codes") -> DataFrame:
    """base with its codes and their squared norm: what a snapshot stores."""
    return base.withColumn(to, sq8_encode(F.col(vector), sq8.mean, sq8.scale)).withColumn(
        "norm", F.aggregate(to, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint") * x.cast("bigint"))
    )


def quantized_top_k(
    coded: DataFrame, sq8: Sq8, query: Sequence[float], k: int, vector: str = "embedding", id: str = "vec_id", where: Column | str | None = None,
    candidates: int | None = None, codes: str = "codes",
) -> DataFrame:
    """Top k by exact distance among the rows nearest by codes that satisfy the predicate; `d2` added.

    candidates (2k and 64 at least) bounds what is reranked. The predicate holds before the scan, so the
    result is short only where fewer than k rows match.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    query = checked_query(query)
    if len(query) != len(sq8.mean):
        raise ValueError(f"different vector dimensions: {len(sq8.mean)} and {len(query)}")
    rows = coded.where(where) if where is not None else coded
    rows = rows.where(F.col(codes).isNotNull()).withColumn("_q", sq8_distance(F.col(codes), sq8.encode(query)))
    near = rows.orderBy("_q", id).limit(max(candidates or 0, 2 * k, 64)).drop("_q")
    return near.withColumn("d2", l2_squared(F.col(vector), query)).orderBy("d2", id).limit(k)


def expected_error(sq8: Sq8) -> float:
    """Root mean square distance error that rounding alone makes per vector."""
    return sq8.scale * math.sqrt(len(sq8.mean) / 12)
