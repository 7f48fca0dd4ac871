"""Partition-probing search: vectors filed under their nearest centroid, few lists read per query.

The number of probed lists is the recall knob; at all lists the answer is exact. A stored index is
partitioned by ranges of lists (list_part) and sorted by list within, so a probe set prunes
directories and row groups. A result that comes out short is widened by doubling the probes, up to
all lists, and every pass ranks anew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import checked_query
from .batch import BLOCK_BYTES, BLOCK_QUERIES, _first_k, _partial, _query_blocks
from .exact import filtered_top_k

#: Most directories of a stored index; each holds a range of lists.
MOST_PARTS = 256


@dataclass(frozen=True)
class IvfIndex:
    """table: the base's rows with list_id (stored: and list_part); centroids: one row per list, in list order."""

    table: DataFrame
    centroids: np.ndarray
    vector: str = "embedding"
    id: str = "vec_id"

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def probes(self, query: Sequence[float], n: int) -> list[int]:
        """The n lists nearest to the query, by (distance, list)."""
        d = ((self.centroids - np.array(query)) ** 2).sum(1)
        return np.lexsort((np.arange(len(d)), d))[:n].tolist()

    def part(self, list_id: int) -> int:
        return list_id * min(self.lists, MOST_PARTS) // self.lists

    def probed(self, query: Sequence[float], n: int) -> DataFrame:
        """The rows of the n lists nearest to the query."""
        lists = self.probes(query, n)
        rows = self.table.where(F.col("list_id").isin(lists))
        return rows.where(F.col("list_part").isin(sorted({self.part(x) for x in lists}))) if "list_part" in self.table.columns else rows


def with_parts(table: DataFrame, lists: int) -> DataFrame:
    """table with list_part, dealt and sorted as a stored index is."""
    part = F.floor(F.col("list_id").cast("bigint") * min(lists, MOST_PARTS) / lists).cast("int")
    return table.withColumn("list_part", part).repartitionByRange("list_part", "list_id").sortWithinPartitions("list_part", "list_id")


def train_centroids(sample: np.ndarray, lists: int, rounds: int = 15, seed: int = 17) -> np.ndarray:
    """Lloyd's iterations from seeded sample rows; an empty list keeps its centroid."""
    lists = max(1, min(lists, len(sample)))
    centroids = sample[np.sort(np.random.default_rng(seed).choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds):
        own = _assign(sample, centroids)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        full = count > 0
        centroids[full] = total[full] / count[full, None]
    return centroids


def _assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        d = (part**2).sum(1)[:, None] - 2 * part @ centroids.T + (centroids**2).sum(1)
        out[at : at + 1024] = d.argmin(1)  # the first at a tie: (distance, list)
    return out


def _sample(rows: DataFrame, vector: str, id: str, n: int, most: int) -> np.ndarray:
    """The vectors of at most `most` of n rows, those of smallest id hash.

    Only rows whose hash can be among them reach the ranking: else each partition would send its
    first `most` rows to the driver.
    """
    hashed = rows.select(F.xxhash64(id).alias("h"), F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    first = lambda some: some.orderBy("h", "i").limit(most).collect()
    share = (most + 8 * math.sqrt(most)) / n
    found = first(hashed.where(F.col("h") < int((2 * share - 1) * 2**63))) if share < 1 else []
    if len(found) < min(most, n):  # ids that repeat, or few rows
        found = first(hashed)
    return np.array([r["v"] for r in found])


def build_ivf(base: DataFrame, vector: str = "embedding", id: str = "vec_id", lists: int = 0, train_rows: int = 50_000, seed: int = 17, at: str | None = None) -> IvfIndex:
    """Files every non-null vector; centroids are fitted on at most train_rows rows, those of
    smallest id hash. lists: 0 for the square root of the row count. at: a folder to store the index
    in; without it every use files the base anew."""
    rows = base.where(F.col(vector).isNotNull())
    n = rows.count()
    if not n:
        raise ValueError("there is no vector")
    lists = lists or max(1, round(math.sqrt(n)))
    centroids = train_centroids(_sample(rows, vector, id, n, train_rows), lists, seed=seed)

    def file(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_v"))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, centroids.shape[1]))
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_v"]
            names = [n for n in batch.schema.names if n != "_v"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_assign(x, centroids).astype(np.int32))], [*names, "list_id"])

    schema = T.StructType([*rows.schema.fields, T.StructField("list_id", T.IntegerType())])
    table = rows.withColumn("_v", F.col(vector).cast("array<double>")).mapInArrow(file, schema)
    if at is None:
        return IvfIndex(table, centroids, vector, id)
    with_parts(table, len(centroids)).write.partitionBy("list_part").parquet(at)
    return IvfIndex(base.sparkSession.read.parquet(at), centroids, vector, id)


def ivf_top_k(index: IvfIndex, query: Sequence[float], k: int, probes: int, where: Column | str | None = None, ranked=None) -> tuple[DataFrame, int]:
    """Top k of the probed lists and how many lists were read in the end.

    ranked: (rows, query, k, vector, id, where) -> top k; exact ranking if not given. The k rows are
    fetched to see whether the result is short, and are the result.
    """
    ranked = ranked or filtered_top_k
    query = checked_query(query)
    if len(query) != index.centroids.shape[1]:
        raise ValueError(f"different vector dimensions: {index.centroids.shape[1]} and {len(query)}")
    n = max(1, min(probes, index.lists))
    while True:
        rows = index.table if n == index.lists else index.probed(query, n)
        found = ranked(rows, query, k, index.vector, index.id, where).drop("list_id", "list_part")
        if n == index.lists:
            return found, n
        rows = found.collect()  # k rows
        if len(rows) == k:
            return index.table.sparkSession.createDataFrame(rows, found.schema), n
        n = min(index.lists, 2 * n)


def ivf_knn_join(queries: DataFrame, index: IvfIndex, k: int, probes: int, qid: str = "qid", query_vector: str = "qvec", where: Column | str | None = None) -> DataFrame:
    """(qid, rank, id, d2) among each query's probed lists.

    A query whose lists hold fewer than k matching rows doubles its probes, up to all lists; the
    matching rows of each list are counted first. Queries go out in blocks of bounded size, and each
    partition of the index keeps its best k rows of every query that reads one of its lists, as in
    knn_join: nothing is paired row by row. A block reads only the parts that one of its queries
    probes. Query ids are distinct.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    n, dim = max(1, min(probes, index.lists)), index.centroids.shape[1]
    rows = index.table.where(where) if where is not None else index.table
    rows = rows.where(F.col(index.vector).isNotNull())
    matching = np.zeros(index.lists, np.int64)
    if n < index.lists:
        for r in rows.groupBy("list_id").count().collect():
            matching[r["list_id"]] = r["count"]
    block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * dim), 8 * BLOCK_BYTES // index.lists))
    parts = []
    for ids, q in _query_blocks(queries, qid, query_vector, block):
        if q.shape[1] != dim:
            raise ValueError(f"different vector dimensions: {dim} and {q.shape[1]}")
        own, probed = rows, None
        if n < index.lists:
            probed = _probed_by(index, q, n, k, matching)
            if "list_part" in rows.columns:
                own = rows.where(F.col("list_part").isin(sorted({index.part(x) for x in np.flatnonzero(probed.any(1)).tolist()})))
        own = own.select(F.col(index.id).cast("bigint").alias("id"), F.col(index.vector).alias("v"), "list_id")
        parts.append(own.mapInArrow(_partial(k, ids, q, False, probed), "qid bigint, id bigint, d2 double"))
    return _first_k(index.table.sparkSession, parts, k)


def _probed_by(index: IvfIndex, q: np.ndarray, n: int, k: int, matching: np.ndarray) -> np.ndarray:
    """For each list, a bit for each query that reads it: its n nearest lists by (distance, list),
    and twice as many while they hold fewer than k matching rows."""
    out = np.zeros((index.lists, -(-len(q) // 8)), np.uint8)
    step = 8 * max(1, BLOCK_BYTES // (64 * index.centroids.size))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        d = ((part[:, None, :] - index.centroids[None, :, :]) ** 2).sum(2)
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(matching[order], axis=1)
        asked = np.full(len(part), n)
        while (short := (asked < index.lists) & (held[np.arange(len(part)), asked - 1] < k)).any():
            asked[short] = np.minimum(index.lists, 2 * asked[short])
        reads = np.zeros((len(part), index.lists), bool)
        np.put_along_axis(reads, order, np.arange(index.lists) < asked[:, None], axis=1)
        bits = np.packbits(reads.T, axis=1)
        out[:, at // 8 : at // 8 + bits.shape[1]] = bits
    return out


def adaptive_probes(k: int, ef_search: int, lists: int, selectivity: float) -> int:
    """Probes by the candidate budget: fewer matching rows in a list need more lists."""
    share = 0.35 if selectivity >= 0.4 else 0.6 if selectivity >= 0.15 else 1.0
    return max(1, min(lists, math.ceil(lists * share * max(1.0, max(ef_search, k) / 100))))
