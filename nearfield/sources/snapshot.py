"""Versioned, immutable snapshots of a vector table.

A build writes a new version beside the old ones and then points CURRENT to it, so open readers
keep the version they have. A version holds its rows (vector, id, scalars) clustered by list, and
metadata; later changes of the live table are not seen.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ivf import IvfIndex, build_ivf, with_parts
from ..operators.quantized import Sq8, sq8_scale, sq8_statistics, sq8_table
from ..plans.settings import Settings

FORMAT = 1
#: Fixed value: scalar columns of these types count as searchable, the first in table order.
MOST_SCALARS = 32
_SCALARS = (T.BooleanType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
#: Rows (without their vectors) that estimate a predicate's selectivity: those of smallest id hash.
SAMPLE_ROWS = 10_000


class _Files:
    """Small files and renames through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def write(self, name: str, text: str) -> None:
        """Writes beside and renames, so that a reader sees the old text or the new one."""
        beside = f".{name.rpartition('/')[2]}.{uuid.uuid4().hex}"
        at = self.path(f"{name.rpartition('/')[0]}/{beside}" if "/" in name else beside)
        out = self.fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(at, self.path(name), options)

    def read(self, name: str) -> str | None:
        at = self.path(name)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


@dataclass(frozen=True)
class Snapshot:
    """One version, pinned. table holds the rows; ivf and sq8 are there if they were built."""

    root: str
    version: str
    meta: dict
    table: DataFrame
    ivf: IvfIndex | None
    sq8: Sq8 | None
    sample: DataFrame | None = None

    @property
    def rows(self) -> int:
        return self.meta["rows"]

    @property
    def dim(self) -> int:
        return self.meta["dim"]

    @property
    def scalars(self) -> list[str]:
        return self.meta["scalars"]

    def accessors(self) -> dict:
        """Count, dimension, columns and lists without reading data."""
        return {k: self.meta[k] for k in ("rows", "dim", "vector", "id", "scalars", "format")} | {"lists": len(self.meta.get("centroids") or ())}

    def knn(self, **options):
        """A query over this version with its strategies available."""
        from ..plans.builder import knn

        coded = (self.table, self.sq8) if self.sq8 else None
        columns = (self.meta["id"], self.meta["vector"], *self.scalars, *self.meta["others"])
        offered = knn(self.table, self.meta["id"]).returning(*columns)
        return offered.using(coded=coded, ivf=self.ivf, name=f"{self.root}@{self.version}", rows=self.rows, sample=self.sample, **options)


def choose_columns(df: DataFrame, vector: str | None, id: str) -> tuple[str, list[str]]:
    """The vector column (the first array of floats, unless named) and the scalar columns kept."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))]
    if vector is None and not arrays:
        raise ValueError("the table has no vector column")
    if vector is not None and vector not in arrays:
        raise ValueError(f"{vector} is no vector column")
    if id not in df.columns:
        raise ValueError(f"no column {id}")
    scalars = [f.name for f in df.schema if isinstance(f.dataType, _SCALARS) and f.name != id]
    return vector or arrays[0], scalars[:MOST_SCALARS]


def build_snapshot(df: DataFrame, root: str, vector: str | None = None, id: str = "vec_id", settings: Settings | None = None, cluster_by: str | None = None, ivf: bool = True, sq8: bool = True) -> int:
    """Builds the next version and makes it current; returns the number of rows indexed.

    Rows with a null vector are skipped; every column of the table is kept. No vector column, no row, or unequal dimensions are
    errors, and then nothing becomes current. cluster_by sorts rows by a scalar column, so that
    ranges of it prune row groups.
    """
    spark, settings = df.sparkSession, settings or Settings()
    vector, scalars = choose_columns(df, vector, id)
    others = [c for c in df.columns if c not in (id, vector, *scalars)]
    taken = sorted({"codes", "norm", "list_id", "list_part"} & set(df.columns))
    if taken:
        raise ValueError(f"column {taken[0]} has a name that snapshots use")
    rows = df.select(id, vector, *scalars, *others).where(F.col(vector).isNotNull())
    n, least, most = rows.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if not n:
        raise ValueError("there is no row to index")
    if least != most:
        raise ValueError(f"different vector dimensions: {least} and {most}")
    meta = {"format": FORMAT, "rows": n, "dim": most, "vector": vector, "id": id, "scalars": scalars, "others": others, "built": uuid.uuid4().hex}
    sample = rows.drop(vector).orderBy(F.xxhash64(id), id).limit(SAMPLE_ROWS).coalesce(1)
    if sq8:
        stats = sq8_scale(sq8_statistics(rows, vector))
        rows = sq8_table(rows, stats, vector)
        meta["sq8"] = {"mean": stats.mean, "scale": stats.scale}
    index = build_ivf(rows, vector, id, settings.build_lists, settings.train_rows) if ivf else None
    out = index.table if ivf else rows
    if ivf:
        meta["centroids"] = index.centroids.tolist()
    if ivf:
        out = with_parts(out, index.lists)
    if cluster_by:
        order = [*["list_part", "list_id"] * ivf, cluster_by]
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    version = f"v{uuid.uuid4().hex}"
    at = f"{root.rstrip('/')}/{version}"
    (out.write.partitionBy("list_part") if ivf else out.write).parquet(f"{at}/rows")
    sample.write.parquet(f"{at}/sample")
    files = _Files(spark, root)
    files.write(f"{version}/meta.json", json.dumps(meta))
    files.write("CURRENT", version)
    return n


def open_snapshot(spark: SparkSession, root: str, version: str | None = None) -> Snapshot:
    """The current version, or a named one; it stays readable while newer ones are built."""
    files = _Files(spark, root)
    version = version or files.read("CURRENT")
    said = files.read(f"{version}/meta.json") if version else None
    if said is None:
        raise FileNotFoundError(f"no snapshot at {root}")
    meta = json.loads(said)
    if meta["format"] != FORMAT:
        raise ValueError(f"snapshot format {meta['format']}, expected {FORMAT}")
    table = spark.read.parquet(f"{root.rstrip('/')}/{version}/rows")
    missing = {meta["id"], meta["vector"], *meta["scalars"], *meta["others"]} - set(table.columns)
    if missing:
        raise ValueError(f"the snapshot lacks {sorted(missing)[0]}")
    sq8 = Sq8(tuple(meta["sq8"]["mean"]), meta["sq8"]["scale"]) if "sq8" in meta else None
    ivf = IvfIndex(table, np.array(meta["centroids"]), meta["vector"], meta["id"]) if "centroids" in meta else None
    return Snapshot(root, version, meta, table, ivf, sq8, spark.read.parquet(f"{root.rstrip('/')}/{version}/sample"))
