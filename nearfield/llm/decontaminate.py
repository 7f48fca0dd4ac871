"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of `window` consecutive words; a document is contaminated where all
words of a window occur in order. A window is the set of its word shingles. Containment must be
whole, so the prefix that has to be joined is one shingle: the window's rarest by its number of
occurrences in all documents. Documents are scanned for these prefix shingles only; a hit gives
the one place where the window could lie (positional bound), which must fit the document (length
bound), and the words there are then compared one by one, byte by byte.

The benchmark is the stated query set: it is taken in blocks of bounded size, which are indexed as
arrays (the texts once, windows as places in them). A block is sent to all tasks and all documents
are scanned for it, without a shuffle; what was found for earlier blocks comes with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Words, carrying, only, received, sent, staged, window_hashes, word_slices

#: ASCII other than digits and letters separates words; A-Z is lower-cased.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Items are sent to the tasks in blocks of so many bytes of text (one longer item is a block).
BLOCK_BYTES = 8 << 20
#: Windows whose bytes are compared at a time.
COMPARED = 1 << 14
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] numbers, then those of the next."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Block:
    """Distinct windows of some items as places in their words, the items that have each, and the
    windows' shingles by length."""

    def __init__(self, ids: list[str], texts: list[str], window: int, shingle: int):
        column = pa.array(texts, pa.large_string())
        self.ids, parts, at = ids, [], 0
        others = word_slices(column, Words(SEPARATORS, fold=True, seed=1))
        for (_, _, data, h, a, b, counts), other in zip(word_slices(column, Words(SEPARATORS, fold=True)), others, strict=True):
            parts.append((_FOLD[data], h, other[3], a + at, b - a, counts))
            at += len(data)
        self.data, self.h, h2, starts, size, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.starts, self.sizes = starts.astype(np.int32), size.astype(np.int32)
        base = np.cumsum(counts) - counts
        wide, many = np.minimum(window, counts), np.where(counts > 0, counts - np.minimum(window, counts) + 1, 0)
        item = np.repeat(np.arange(len(counts)), many)
        first, length = _ranges(base, many), wide[item]
        keys = np.zeros((2, len(first)), np.uint64)
        for n in np.unique(length).tolist():
            own = length == n
            keys[:, own] = window_hashes(self.h, n)[first[own]], window_hashes(h2, n)[first[own]]
        order = np.lexsort((item, keys[1], keys[0], length))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (length[order][1:] != length[order][:-1]) | (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(0)
        self.first, self.length = first[order[fresh]].astype(np.int32), length[order[fresh]].astype(np.int32)
        which = np.cumsum(fresh) - 1
        once = np.ones(len(order), bool)
        once[1:] = fresh[1:] | (item[order][1:] != item[order][:-1])
        self.items = item[order[once]].astype(np.int32)
        self.edges = np.searchsorted(which[once], np.arange(len(self.first) + 1))
        self.by_length = [(n, min(shingle, n), np.flatnonzero(self.length == n)) for n in np.unique(self.length).tolist()]
        self.shingles: dict[int, np.ndarray] = {}
        for n, k, rows in self.by_length:
            found = np.unique(self._shingles(n, k, rows))
            self.shingles[k] = np.union1d(self.shingles[k], found) if k in self.shingles else found

    def _shingles(self, n: int, k: int, rows: np.ndarray) -> np.ndarray:
        return window_hashes(self.h, k)[self.first[rows][:, None] + np.arange(n - k + 1)]

    def index(self, counts: dict[int, np.ndarray]) -> None:
        """Orders each window's shingles by rarity (ties: by hash, then place) and keeps the first.

        counts: for each shingle length, how often each of `shingles` occurs in all documents.
        """
        self.prefix = {}
        by_size: dict[int, list[np.ndarray]] = {}
        for n, k, rows in self.by_length:
            rank = np.empty(len(counts[k]), np.int64)
            rank[np.lexsort((self.shingles[k], counts[k]))] = np.arange(len(rank))
            own = self._shingles(n, k, rows)
            place = rank[np.searchsorted(self.shingles[k], own)].argmin(1)
            by_size.setdefault(k, []).append((own[np.arange(len(rows)), place], rows.astype(np.int32), place.astype(np.int32)))
        for k, parts in by_size.items():
            h, rows, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.prefix[k] = (h[order], rows[order], place[order])
        del self.shingles, self.by_length

    def occurrences(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, stops: np.ndarray, begin: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the words from begin[i] on are those of window which[i]."""
        good = np.zeros(len(begin), bool)
        length = self.length[which]
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            for at in range(0, len(rows), COMPARED):
                own = rows[at : at + COMPARED]
                here, there = begin[own][:, None] + np.arange(n), self.first[which[own]][:, None] + np.arange(n)
                size = self.sizes[there]
                like = (h[here] == self.h[there]).all(1) & (stops[here] - starts[here] == size).all(1)
                own, here, there, size = own[like], here[like], there[like], size[like]
                if len(own):
                    whole, flat = size.sum(1), size.ravel()
                    equal = _FOLD[data[_ranges(starts[here].ravel(), flat)]] == self.data[_ranges(self.starts[there].ravel().astype(np.int64), flat)]
                    good[own] = np.logical_and.reduceat(equal, np.cumsum(whole) - whole)
        return good


class _Wanted:
    """Sorted hashes behind a table of bits by a hash's low bits; most positions of a document stop there."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.low = np.uint64((1 << max(16, (16 * len(hashes)).bit_length())) - 1)
        self.table = np.zeros(int(self.low) + 1, bool)
        self.table[(hashes & self.low).astype(np.int64)] = True

    def hits(self, h: np.ndarray, k: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles of k words that are wanted and lie in one text; their place in hashes."""
        x = window_hashes(h, k)
        at = np.flatnonzero(self.table[(x & self.low).astype(np.int64)])
        place = np.searchsorted(self.hashes, x[at])
        good = (place < len(self.hashes)) & (self.hashes[np.minimum(place, len(self.hashes) - 1)] == x[at])
        at, place = at[good], place[good]
        inside = at + k <= ends[np.searchsorted(ends, at, "right")] if len(at) else np.zeros(0, bool)
        return at[inside], place[inside]


def _blocks(benchmark: DataFrame, window: int, shingle: int) -> Iterator[_Block]:
    ids, texts, size = [], [], 0
    for item, text in benchmark.toLocalIterator():
        if item is None or not text:
            continue
        if size and size + len(text) > BLOCK_BYTES:
            yield _Block(ids, texts, window, shingle)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += len(text)
    if ids:
        yield _Block(ids, texts, window, shingle)


def _counted(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle occurs in all documents."""
    shipped = sent(docs.sparkSession, shingles)
    words = Words(SEPARATORS, fold=True)

    def run(batches):
        wanted = {k: _Wanted(v) for k, v in received(shipped).items()}
        total = {k: np.zeros(len(v.hashes), np.int64) for k, v in wanted.items()}
        for batch in batches:
            for _, _, _, h, _, _, counts in word_slices(batch.column(0), words):
                ends = np.cumsum(counts)
                for k, v in wanted.items():
                    np.add.at(total[k], v.hits(h, k, ends)[1], 1)
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], ["k", "i", "n"])

    table = docs.select("text").mapInArrow(run, "k int, i bigint, n bigint").groupBy("k", "i").agg(F.sum("n").alias("n")).toArrow()
    shipped.unpersist()
    size, place, n = (table.column(i).to_numpy() for i in range(3))
    out = {k: np.zeros(len(v), np.int64) for k, v in shingles.items()}
    for k, v in out.items():
        v[place[size == k]] = n[size == k]
    return out


_FOUND = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:bigint,end:bigint>>"


def contaminated_words(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, and carried columns of docs) of each document.

    A word is hit if it lies in an occurrence of a window of `window` consecutive words of an item;
    an item of fewer words, but not none, is one window. items: the ids, as strings, of items with
    occurring windows, sorted. spans: maximal runs of hit words as structs of first word and word
    after the last.

    Null texts have no words. Items with a null id or text are no items; items that repeat an id
    count as one. Repeated documents give repeated rows. An empty benchmark hits nothing.
    """
    fields = carrying(docs, carried, ("doc_id", "n_words", "n_hit", "items", "spans"))
    source = {"doc_id": F.col(f"`{id_col}`").cast("bigint"), "text": F.col(f"`{text_col}`").cast("string")}
    source |= {"items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<first:bigint,end:bigint>>")}
    docs = docs.select(*(c.alias(n) for n, c in source.items()), *(F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carried)))
    items = only(benchmark, item_id=(item_col, "string"), text=(item_text_col, "string"))
    last = None
    for block in _blocks(items, window, shingle):
        if len(block.first):
            block.index(_counted(docs, block.shingles))
            if last is not None:
                docs = staged(_scanned(docs, last, True), "scanned").select(docs.columns)
            last = sent(docs.sparkSession, block)
    out = _scanned(docs, last, False)
    return out.select("doc_id", "n_words", "n_hit", "items", "spans", *(F.col(f"carried_{i}").alias(f.name) for i, f in enumerate(fields)))


def _scanned(docs: DataFrame, shipped, texts: bool) -> DataFrame:
    """What one block hits, added to docs: (doc_id, text if asked for, n_words, n_hit, items, spans, carried)."""
    words = Words(SEPARATORS, fold=True)

    def found(block, wanted, data, h, starts, stops, counts, ends):
        """(first word, window) of all occurrences."""
        out = [np.zeros((2, 0), np.int64)]
        for k, (hashes, which, offset) in block.prefix.items():
            unique, first = wanted[k]
            at, place = unique.hits(h, k, ends)
            size = np.diff(np.append(first, len(hashes)))[place]
            row = _ranges(first[place], size)
            begin, which = np.repeat(at, size) - offset[row], which[row]
            text = np.searchsorted(ends, np.repeat(at, size), "right")
            fits = (begin >= ends[text] - counts[text]) & (begin + block.length[which] <= ends[text])
            begin, which = begin[fits], which[fits]
            good = block.occurrences(data, h, starts, stops, begin, which)
            out.append(np.stack([begin[good], which[good]]).astype(np.int64))
        return np.concatenate(out, axis=1)

    def run(batches):
        block = received(shipped) if shipped else None
        wanted = {}
        for k, p in block.prefix.items() if block else ():
            unique, first = np.unique(p[0], return_index=True)
            wanted[k] = (_Wanted(unique), first)
        span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            old_items, old_spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for first, last, data, h, starts, stops, counts in word_slices(batch.column(1), words):
                ends = np.cumsum(counts)
                edge = np.zeros(len(h) + 1, np.int32)
                met: dict[int, set[str]] = {}
                for row in range(first, last):
                    if old_items[row]:
                        met[row - first] = set(old_items[row])
                        for own in old_spans[row]:
                            edge[ends[row - first] - counts[row - first] + own["first"]] += 1
                            edge[ends[row - first] - counts[row - first] + own["end"]] -= 1
                if block:
                    begin, which = found(block, wanted, data, h, starts, stops, counts, ends)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + block.length[which], -1)
                    pairs = np.unique(np.stack([np.searchsorted(ends, begin, "right"), which]), axis=1)
                    for row, w in pairs.T.tolist():
                        met.setdefault(row, set()).update(block.ids[i] for i in block.items[block.edges[w] : block.edges[w + 1]])
                hit = np.cumsum(edge[:-1]) > 0
                for row, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    own = hit[end - n : end] if row in met else hit[:0]
                    n_words.append(n)
                    n_hit.append(int(own.sum()))
                    items.append(sorted(met.get(row, ())))
                    change = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                    spans.append([{"first": a, "end": b} for a, b in zip(change[::2], change[1::2], strict=True)])
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + texts], *made, *batch.columns[4:]], names)

    before = [f for f in docs.schema if f.name in ("doc_id", "text")[: 1 + texts]]
    kind = T.StructType([*before, *T.StructType.fromDDL(_FOUND), *(f for f in docs.schema if f.name.startswith("carried_"))])
    names = kind.names
    return docs.mapInArrow(run, kind)
