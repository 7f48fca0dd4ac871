"""The evaluation table: vectors with three scalar attributes, and its variants.

Each variant is one SELECT that Spark and DuckDB both run over `embeddings`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BOOL = "CAST(vec_id % 2 AS INT) AS bool_attr"
_FLOAT = "CAST((vec_id * 7919) % 1000 AS DOUBLE) / CAST(10 AS DOUBLE)"
_PLAIN = f"vec_id, embedding, {_BOOL}, label AS int_attr, {_FLOAT} AS float_attr"

#: name -> SELECT over `embeddings`.
VARIANTS = {
    "plain": f"SELECT {_PLAIN} FROM embeddings",
    "flags": f"SELECT {_PLAIN}, vec_id % 2 = 1 AS flag FROM embeddings",
    "null_scalar": f"SELECT vec_id, embedding, {_BOOL}, label AS int_attr, CASE WHEN vec_id % 17 = 0 THEN NULL ELSE {_FLOAT} END AS float_attr FROM embeddings",
    "nan_scalar": f"SELECT vec_id, embedding, {_BOOL}, label AS int_attr, CASE WHEN vec_id % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE {_FLOAT} END AS float_attr FROM embeddings",
    "null_vector": f"SELECT vec_id, CASE WHEN vec_id % 23 = 0 THEN NULL ELSE embedding END AS embedding, {_BOOL}, label AS int_attr, {_FLOAT} AS float_attr FROM embeddings",
    "bigint": f"SELECT {_PLAIN}, vec_id + 4503599627370497 AS big FROM embeddings",
    "ties": f"SELECT {_PLAIN} FROM embeddings UNION ALL SELECT vec_id + 100000 AS vec_id, embedding, {_BOOL}, label AS int_attr, {_FLOAT} AS float_attr FROM embeddings",
}


def items(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    """A variant over {sf_dir}/embeddings.parquet."""
    # the table is passed by reference, so that no view of the session is replaced
    return spark.sql(VARIANTS[variant].replace("FROM embeddings", "FROM {embeddings}"), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
