"""Nearest neighbours of many queries in one pass over the base.

Queries go out in blocks of bounded size, a block to a pass; each base partition keeps its best k
rows of every query, and only those are shuffled for the final ranking. A matrix product bounds the
distances first, and only rows that can rank are measured term by term, so order and ties are those
of the exact distance. Nothing is paired row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import checked_query

#: Most queries, and most bytes of their vectors, in one block: what each task of a pass holds.
BLOCK_QUERIES, BLOCK_BYTES = 1 << 14, 32 << 20
#: Queries and base rows that are compared at a time.
QUERIES, ROWS = 512, 4096
#: Most measured pairs, and a piece of 65,536 more, that wait to be ranked.
WAITING = 1 << 18


def _query_blocks(queries: DataFrame, qid: str, vector: str, block: int | None):
    """Query ids and vectors, block by block, as the driver fetches them."""
    ids, vectors = [], []
    for row in queries.select(F.col(qid).cast("bigint"), F.col(vector).cast("array<double>")).toLocalIterator():
        ids.append(row[0])
        vectors.append(checked_query(row[1]))
        if len(ids) == (block or max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * len(vectors[0]))))):
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def _measured(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, summed from the first component on as l2_squared does: equal to the last bit."""
    return np.add.accumulate((q - x) ** 2, axis=1)[:, -1]


class _Best:
    """The k nearest rows of each query so far, by (squared distance, id), null ids last."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool):
        self.qids, self.q, self.k, self.exclude_self = qids, q, k, exclude_self
        self.norm = np.einsum("ij,ij->i", q, q)
        self.worst = np.full(len(q), np.inf)
        self.row, self.d, self.null, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)
        self.found, self.waiting = [], 0

    def add(self, ids: np.ndarray, null: np.ndarray, x: np.ndarray, among: np.ndarray | None = None) -> None:
        """null: whose ids are null. among: places of the queries that the rows are compared with; all if not given."""
        norm = np.einsum("ij,ij->i", x, x)
        largest = np.max(norm, initial=0, where=np.isfinite(norm))
        for at in range(0, len(self.q) if among is None else len(among), QUERIES):
            own = np.arange(at, min(at + QUERIES, len(self.q))) if among is None else among[at : at + QUERIES]
            near = self.norm[own, None] + norm[None, :] - 2 * (self.q[own] @ x.T)
            odd = ~np.isfinite(near)  # out of the product's range: measured, unless the row itself is infinite and k finite ones are known
            if odd.any():
                near[odd] = np.inf
                odd &= np.isfinite(x).all(1)[None, :] | ~np.isfinite(self.worst[own, None])
            if self.exclude_self:
                itself = (self.qids[own, None] == ids[None, :]) & ~null[None, :]
                near[itself] = np.inf
                odd &= ~itself
            bound = self.worst[own]
            if len(x) > self.k:
                bound = np.fmin(bound, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
            slack = 1e-9 * (self.norm[own] + largest) + 1e-300
            i, j = np.nonzero((near <= (bound + slack)[:, None]) & (near < np.inf) | odd)
            for cut in range(0, len(i), 1 << 16):
                a, b = own[i[cut : cut + (1 << 16)]], j[cut : cut + (1 << 16)]
                self.found.append((a, _measured(self.q[a], x[b]), null[b], ids[b]))
                self.waiting += len(a)
                if self.waiting >= WAITING:
                    self.settle()
        if self.waiting >= len(self.q) * self.k:
            self.settle()

    def settle(self) -> None:
        """Ranks what has been measured."""
        row, d, null, ids = (np.concatenate(c) for c in zip((self.row, self.d, self.null, self.id), *self.found, strict=True))
        self.found, self.waiting = [], 0
        order = np.lexsort((ids, null, d, row))
        row, d, null, ids = row[order], d[order], null[order], ids[order]
        first = np.searchsorted(row, np.arange(len(self.q)))
        kept = np.arange(len(row)) - first[row] < self.k
        self.row, self.d, self.null, self.id = row[kept], d[kept], null[kept], ids[kept]
        count = np.bincount(self.row, minlength=len(self.q))
        full = np.flatnonzero(count == self.k)
        self.worst[full] = np.fmin(np.inf, self.d[np.cumsum(count)[full] - 1])


def _partial(k: int, qids: np.ndarray, q: np.ndarray, exclude_self: bool, probed: np.ndarray | None = None):
    """A mapInArrow function: the best k rows of each query in one partition, as (qid, id, d2).

    probed: for each list, a bit for each query that reads it; rows then come with their list, and
    are compared with those queries only.
    """

    def run(batches):
        best = _Best(qids, q, k, exclude_self)
        with np.errstate(all="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    column = part.column(1)
                    sizes = np.diff(column.offsets.to_numpy())
                    if (sizes != q.shape[1]).any():
                        raise ValueError(f"different vector dimensions: {sizes[sizes != q.shape[1]][0]} and {q.shape[1]}")
                    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
                    null, ids = part.column(0).is_null().to_numpy(zero_copy_only=False), part.column(0).fill_null(0).to_numpy()
                    if probed is None:
                        best.add(ids, null, x)
                        continue
                    lists = part.column(2).to_numpy()
                    order = np.argsort(lists, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
                        among = np.flatnonzero(np.unpackbits(probed[lists[own[0]]], count=len(q)))
                        if len(among):
                            best.add(ids[own], null[own], x[own], among)
            best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(qids[best.row]), pa.array(best.id, mask=best.null), pa.array(best.d)], ["qid", "id", "d2"])

    return run


def _first_k(spark: SparkSession, parts: Sequence[DataFrame], k: int) -> DataFrame:
    """(qid, rank, id, d2): the first k of what the partitions of each part have kept."""
    if not parts:
        return spark.createDataFrame([], "qid bigint, rank bigint, id bigint, d2 double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("qid").orderBy(F.asc("d2"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("qid", "rank", "id", "d2")


def knn_join(
    queries: DataFrame, base: DataFrame, k: int, qid: str = "qid", query_vector: str = "qvec", id: str = "vec_id", vector: str = "embedding",
    where: Column | str | None = None, exclude_self: bool = False, block: int | None = None,
) -> DataFrame:
    """(qid, rank, id, d2): the k nearest base rows of each query that satisfy the predicate.

    Rank is by (squared distance, id) from 1. Null base vectors never rank. Query ids are distinct;
    a null query vector or unequal dimensions are errors. exclude_self leaves out the base row of
    the query's own id, as held-out evaluation needs. block: queries of one pass over the base, by
    the vectors' size if not given.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    rows = base.where(where) if where is not None else base
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = [rows.mapInArrow(_partial(k, ids, q, exclude_self), "qid bigint, id bigint, d2 double") for ids, q in _query_blocks(queries, qid, query_vector, block)]
    return _first_k(base.sparkSession, parts, k)


def knn_join_by_class(
    queries: DataFrame, base: DataFrame, k: int, predicates: dict[str, str], class_col: str = "class", qid: str = "qid", query_vector: str = "qvec", **options
) -> DataFrame:
    """knn_join with one predicate per class of queries; the base is filtered once per class."""
    missing = [r[0] for r in queries.select(class_col).distinct().collect() if r[0] not in predicates]
    if missing:
        raise ValueError(f"no predicate for class {missing[0]!r}")
    found = None
    for name in sorted(predicates):
        part = knn_join(queries.where(F.col(class_col) == name), base, k, qid, query_vector, where=predicates[name], **options).withColumn(class_col, F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def as_vectors(rows: Sequence[tuple[int, Sequence[float]]]) -> list[tuple[int, list[float]]]:
    """Rows ready for a query DataFrame of schema `qid bigint, qvec array<double>`."""
    return [(int(i), checked_query(v)) for i, v in rows]
