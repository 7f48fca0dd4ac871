"""Capacity pre-flight of a table before it is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import choose_columns

#: Limits of what can be indexed.
MOST_ROWS, MOST_DIM = 2**32 - 2, 2000


def capacity(df: DataFrame, vector: str | None = None, id: str = "vec_id", links: int = 16, parallelism: int = 64) -> DataFrame:
    """(metric, value, ok, note), all text: rows, limits, and size and time estimates of an index.

    One aggregate over the vector's size; sizes follow from rows, dimension and scalar columns.
    """
    spark = df.sparkSession
    vector, scalars = choose_columns(df, vector, id)
    n, nulls, dim = df.agg(F.count(F.lit(1)), F.count_if(F.col(vector).isNull()), F.max(F.size(vector))).first()
    n, dim, c = n - nulls, max(dim or 0, 0), len(scalars)
    size = n * (4 * dim + 20 * c + 9 + (2 * links + 1) * 4 + 11)
    padded = -(-dim // 16) * 16
    coded = n * (3 * padded + 4 + 12 * c + (2 * links + 1) * 4)
    seconds = 9 * (n / 1e6) * (dim / 128) * (64 / parallelism)
    flag = lambda good: "yes" if good else "no"
    rows = [
        ("rows", str(n), flag(0 < n <= MOST_ROWS), f"at most {MOST_ROWS}"),
        ("null_vectors", str(nulls), "yes", "not indexed"),
        ("dim", str(dim), flag(0 < dim <= MOST_DIM), f"at most {MOST_DIM}"),
        ("scalar_columns", str(c), "yes", "the first 32 of numbers and flags are searchable; all columns are kept"),
        ("index_bytes", str(size), "yes", "vectors, scalars and links"),
        ("coded_bytes", str(coded), "yes", "8-bit codes with rerank rows"),
        ("peak_build_bytes", str(int(2.5 * size)), "yes", "2.5 times the index"),
        ("disk_bytes", str(2 * size), "yes", "the old version stays while the new one is written"),
        ("build_seconds", f"{seconds:.3f}", "yes", "scales with rows and dimension"),
        ("visited_bytes", str(4 * n), "yes", "per search"),
    ]
    return spark.createDataFrame(rows, "metric string, value string, ok string, note string")
