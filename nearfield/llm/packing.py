"""Packing of token sequences by cutting-stock column generation.

Documents longer than a sequence are cut into whole sequences and a rest. Lengths are counted in
units of a few tokens; the histogram is bounded, whatever the number of documents. A linear
program over patterns (which lengths share a sequence) is solved by column generation: duals of
the present basis price the lengths, and an unbounded-knapsack dynamic program finds the pattern
worth most. Patterns are rounded down, what is left is packed by first fit decreasing over
counts, and the patterns' slots are dealt to the documents ranked within each length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, only, slices, staged
from .tokens import Encoder


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Counts of each size that fit into capacity and are worth most, by dynamic programming."""
    good = np.flatnonzero(worth > 1e-12)
    s, w = sizes[good], worth[good]
    order = np.argsort(s, kind="stable")
    s, w, good = s[order], w[order], good[order]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            value = best[c - s[: fits[c]]] + w[: fits[c]]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], pick[c] = value[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[good[pick[c]]] += 1
            c -= int(s[pick[c]])
    return counts, float(best[capacity])


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First fit decreasing over counts: (pattern, how often)."""
    plan, left = [], demand.copy()
    by_size = np.argsort(-sizes, kind="stable").tolist()
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in by_size:
            pattern[i] = min(int(left[i]), room // int(sizes[i]))
            room -= int(pattern[i] * sizes[i])
        some = pattern > 0
        times = int((left[some] // pattern[some]).min())
        left = left - pattern * times
        plan.append((pattern, times))
    return plan


def _greedy_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, their use, inverse): a basis that covers the demand, each pattern using up a size.

    A pattern holds only sizes not used up before, so with sizes in the order in which they end the
    basis is triangular, and its inverse comes by substitution. That is plain NumPy on purpose: a
    threaded LAPACK inversion was seen to wait for ever in a process that runs Spark's driver.
    """
    n = len(sizes)
    columns, used, rest, open_ = np.zeros((n, n)), np.zeros(n), demand.astype(float), np.ones(n, bool)
    by_size, ends = np.argsort(-sizes, kind="stable").tolist(), []
    while open_.any():
        pattern, room = np.zeros(n), capacity
        for i in by_size:
            if open_[i]:
                pattern[i] = room // int(sizes[i])
                room -= int(pattern[i] * sizes[i])
        some = np.flatnonzero(pattern)
        ended = int(some[(rest[some] / pattern[some]).argmin()])
        columns[:, ended], used[ended] = pattern, rest[ended] / pattern[ended]
        rest = np.maximum(rest - used[ended] * pattern, 0)
        open_[ended] = False
        ends.append(ended)
    low, solved = columns[np.ix_(ends, ends)], np.eye(n)
    for i in range(n):
        solved[i] -= np.einsum("j,jk->k", low[i, :i], solved[:i])
        solved[i] /= low[i, i]
    inverse = np.empty((n, n))
    inverse[np.ix_(ends, ends)] = solved
    return columns, used, inverse


@dataclass
class Plan:
    """patterns: (counts of each size, how often used); bound: no plan has fewer sequences; gap: the program's, relative."""

    patterns: list[tuple[np.ndarray, int]]
    bound: float
    gap: float


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4) -> Plan:
    """Patterns that meet the demand exactly.

    The linear program (fewest sequences that cover the demand) starts from greedy patterns. Prices
    are smoothed towards those of the best bound so far. Columns enter until the value is within a
    factor 1 + gap of a lower bound (total length over capacity, or the prices' own), within one
    sequence of it, or no column is worth more than it costs, which proves the optimum.
    """
    n = len(sizes)
    if not n:
        return Plan([], 0.0, 0.0)
    columns, used, inverse = _greedy_basis(sizes, demand, capacity)
    cost = np.ones(n)
    bound, center = float(sizes @ demand) / capacity, sizes / capacity
    while True:
        price = cost @ inverse
        value = float(cost @ used)
        if value <= max(bound * (1 + gap), bound + 1):
            break
        low = int(price.argmin())
        if price[low] < -1e-9:  # covering more than is asked for costs nothing
            enter, its_cost = np.zeros(n), 0.0
            enter[low] = -1.0
        else:
            mixed = 0.5 * center + 0.5 * price
            pattern, worth = best_pattern(sizes, mixed, capacity)
            if float(mixed @ demand) / worth > bound:
                bound, center = float(mixed @ demand) / worth, mixed / worth
            if float(price @ pattern) <= 1 + 1e-9:
                pattern, worth = best_pattern(sizes, price, capacity)
                bound = max(bound, float(price @ demand) / worth)
                if worth <= 1 + 1e-9:
                    break
            enter, its_cost = pattern.astype(np.float64), 1.0
        step = inverse @ enter
        up = step > 1e-9
        ratio = np.full(n, np.inf)
        ratio[up] = np.maximum(used[up], 0) / step[up]
        out = int(ratio.argmin())
        used -= ratio[out] * step
        used[out] = ratio[out]
        columns[:, out], cost[out] = enter, its_cost
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    real = cost > 0
    counts = columns[:, real].round().astype(np.int64)
    whole = np.floor(np.maximum(used[real], 0) + 1e-9).astype(np.int64)
    plan, left = [], demand.copy()
    for j in np.argsort(-whole, kind="stable"):
        # a pattern is used as often as it is wanted whole; where a size is covered more than asked, less
        some = counts[:, j] > 0
        times = int(min(whole[j], (left[some] // counts[some, j]).min()))
        if times:
            plan.append((counts[:, j].copy(), times))
            left -= counts[:, j] * times
    return Plan(plan + first_fit(sizes, left, capacity), bound, max(0.0, value / bound - 1))


def tokenized_pieces(docs: DataFrame, vocabulary: str, length: int, end_id: int | None, keep_ids: bool) -> DataFrame:
    """Each document's ids cut into pieces of at most `length`: (doc_id, start, length, ids_crc32, doc_tokens[, ids])."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def run(batches):
        encoder = Encoder(vocabulary)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for first, last, data, ends in slices(batch.column(1), SLICE_BYTES):
                data, at = data.tobytes(), 0
                rows, starts, sizes, crcs, totals, parts = [], [], [], [], [], []
                for row, end in zip(range(first, last), ends.tolist(), strict=True):
                    ids = np.concatenate([encoder.encode(data[at:end].decode("utf-8", "replace")).astype("<u4"), tail])
                    at = end
                    for start in range(0, len(ids), length):
                        part = ids[start : start + length].tobytes()
                        rows.append(row)
                        starts.append(start)
                        sizes.append(len(part) // 4)
                        crcs.append(zlib.crc32(part))
                        totals.append(len(ids))
                        if keep_ids:
                            parts.append(part)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(parts, pa.binary())] * keep_ids], names)

    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int | None = 1, unit: int = 4, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `length` tokens.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of each piece: its
    ids are those of its document from start on, and lie gapless in their sequence from offset.
    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit numbers; with keep_ids the
    ids themselves come in that form. Every document ends in end_id (None: in nothing; a text
    without ids then has no piece). A document no longer than a sequence is never cut.

    unit: tokens by which lengths are told apart; a piece wastes less than that.

    Null texts are empty. Null ids stay null; repeated rows are packed again: pieces are numbered
    when they are written, so equal ones have a fixed order and share no rank. An empty table gives
    an empty one.
    """
    source = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    cut = tokenized_pieces(source, vocabulary, length, end_id, keep_ids)
    pieces = staged(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    capacity = length // unit
    size = F.least(F.ceil(F.col("length") / unit), F.lit(capacity)).cast("int")
    pieces = pieces.withColumn("size", size)
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most `capacity` rows
    sizes = np.array(sorted(s for s in histogram if s < capacity), np.int64)
    plan = cutting_stock(sizes, np.array([histogram[s] for s in sizes], np.int64), capacity)
    slots = _slots(sizes, plan.patterns, capacity, histogram.get(capacity, 0))

    buckets = int(max(64, min(1 << 16, sum(histogram.values()) >> 16)))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(
        pieces.groupBy("size", "bucket").count().select("size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "ranks"
    )
    within = Window.partitionBy("size", "bucket").orderBy("piece")
    ranked = pieces.withColumn("row", F.row_number().over(within) - 1).join(base, ["size", "bucket"]).withColumn("rank", F.col("base") + F.col("row"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (0, 1))
            sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                rows = size == s
                begin, each, at, above = slots[int(s)]
                j = np.searchsorted(begin, rank[rows], "right") - 1
                k = rank[rows] - begin[j]
                sequence[rows] = at[j] + k // each[j]
                slot[rows] = above[j] + k % each[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids
    placed = ranked.select("size", "rank", *names).mapInArrow(place, f"{kinds}, sequence_id bigint, slot bigint")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    return placed.select(*names[:5], "sequence_id", offset, *names[5:])


def _slots(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]], capacity: int, full: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size, by pattern: its first rank, slots in a sequence, the first sequence, slots above.

    Ranks of a size go through the patterns in their order.
    """
    rows: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    given = np.zeros(len(sizes), np.int64)
    first = full
    for counts, times in plan:
        above = 0
        for i in np.flatnonzero(counts)[::-1].tolist():
            rows[int(sizes[i])].append((int(given[i]), int(counts[i]), first, above))
            above += int(counts[i])
        given += counts * times
        first += times
    found = {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in rows.items() if r}
    if full:
        found[capacity] = tuple(np.array([x], np.int64) for x in (0, 1, 0, 0))
    return found
