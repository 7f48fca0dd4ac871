"""CSV with vectors as `[a,b,...]` text, and manifests of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_vector_csv(rows: DataFrame, path: str) -> None:
    """Writes rows as CSV with a header; array columns become bracketed text that reads back exactly."""
    text = [F.to_json(c).alias(c) if isinstance(rows.schema[c].dataType, T.ArrayType) else F.col(c) for c in rows.columns]
    rows.select(*text).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_vector_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """Reads CSV under a given schema; array columns are parsed from bracketed text, a bad one is an error."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema])
    raw = spark.read.schema(flat).option("header", header).option("escape", '"').option("mode", "FAILFAST").csv(path)
    parsed = lambda f: F.from_json(f.name, f.dataType, {"mode": "FAILFAST"}).alias(f.name)
    return raw.select(*(parsed(f) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in schema))


def dataset_manifest(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(column, type, rows, nulls, dim, checksum): what a data set holds; equal rows in any order give equal rows here."""
    one = []
    for f in rows.schema:
        c = F.col(f.name)
        dim = F.max(F.size(c)) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast("int")
        one.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"),
                F.count_if(c.isNull()).alias("nulls"), dim.alias("dim"), F.sum(F.xxhash64(c).cast("decimal(38,0)")).cast("string").alias("checksum"),
            )
        )
    return rows.agg(F.array(*one).alias("x")).select(F.explode("x").alias("x")).select("x.*")
