"""Vectors as 16-bit floats in one binary column: half the bytes of floats to store and scan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import checked_query

#: Fixed value: the largest finite 16-bit float.
MOST = 65504.0


def half_encode(vector: Column) -> Column:
    """Components rounded to the nearest 16-bit float (ties to even), little-endian; null for null.

    Components beyond the range become the largest of their sign; null components become NaN.
    """

    def run(column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        values = column.flatten().to_numpy(zero_copy_only=False)
        data = np.clip(values, -MOST, MOST).astype("<f2")
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64) * 2])
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pc.if_else(column.is_valid(), out.cast(pa.binary()), pa.scalar(None, pa.binary()))

    return F.arrow_udf(run, "binary")(vector)


def half_distance(halves: Column, query: Sequence[float]) -> Column:
    """Squared distance of the rounded components to the query, in double; null for null, an error for unequal dimensions."""
    q = np.array(checked_query(query))

    def run(column: pa.Array) -> pa.Array:
        sizes = pc.binary_length(column.drop_null()).to_numpy()
        if (sizes != 2 * len(q)).any():
            raise ValueError(f"different vector dimensions: {sizes[sizes != 2 * len(q)][0] // 2} and {len(q)}")
        x = np.frombuffer(b"".join(column.drop_null().to_pylist()), "<f2").astype(np.float64).reshape(len(sizes), len(q))
        out = np.full(len(column), np.nan)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        out[valid] = ((x - q) ** 2).sum(1)
        return pa.array(out, pa.float64(), mask=~valid)

    return F.arrow_udf(run, "double")(halves)
