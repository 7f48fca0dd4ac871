"""Substring dedup by level-wise doubling over word windows.

Level one hashes short windows, half as long as the target (or a quarter, ...). Only windows
repeated at one length are extended to twice that length, until the target length is reached or
no candidate is left. Below the target length a level needs one short window per target window:
the one of smallest hash inside it. Equal target windows choose equal short windows, so a target
window whose choice isn't repeated can't be repeated itself, and nothing is lost.

Below the target length windows are compared by 64-bit hashes, which can only let too many through;
at the target length by 128 bits: a second hash of other word hashes decides with the first. Texts
are copies of one another if their SHA-256 is equal.

Counts and first occurrences are grouped aggregates (combined before the shuffle); going back to
positions is a join that adaptive execution may split, so a window that a third of the documents
share loads no single task. Copies of a whole text are settled by one hash of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, dropped, only, released, same, sliding, staged, window_hashes, word_slices, words_left

#: Space and \x09-\x0D separate words, as bytes.split() has it.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def _levels(window: int, base: int) -> list[int]:
    lengths = [window]
    while lengths[0] % 2 == 0 and lengths[0] // 2 >= base:
        lengths.insert(0, lengths[0] // 2)
    return lengths


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _level(docs: DataFrame, window: int, length: int, before: int) -> DataFrame:
    """Windows of `length` words to count: (doc_id, seq, hash[], other[], pos[], again[]) of each row.

    docs: doc_id, seq, text and, if before > 0, pos: where windows of `before` words are repeated.
    At the target length `other` has each window's second hash (it is empty below), and a text's
    second and later start of one window goes to `again`, not to pos.
    """
    words = Words(SPACES, fold=False)
    others = Words(SPACES, fold=False, seed=1)
    top = np.uint64(2**64 - 1)

    def chosen(h, counts, live):
        n = len(h)
        here = window_hashes(h, length)
        if length == window:
            return np.flatnonzero(live), here
        span = window - length + 1
        least = np.where(live, sliding(here, span, True), np.uint64(0))
        return np.flatnonzero(sliding(least[::-1], span, False)[::-1] == here) if n else np.zeros(0, np.int64), here

    def alive(h, counts, positions):
        live = words_left(counts) >= window
        if positions is None:
            return live
        hashes = window_hashes(h, before)
        span = window - before + 1
        return live & (sliding(np.where(positions, hashes, top), span, True) == sliding(hashes, span, True))

    def run(batches):
        for batch in batches:
            second = word_slices(batch.column(2), others) if length == window else None
            for first, last, _, h, _, _, counts in word_slices(batch.column(2), words):
                n = last - first
                there = window_hashes(next(second)[3], length) if second else None
                base = np.cumsum(counts) - counts
                positions = None
                if before:
                    lists = batch.column(3).slice(first, n)
                    sizes = np.diff(lists.offsets.to_numpy())
                    positions = np.zeros(len(h), bool)
                    positions[np.repeat(base, sizes) + lists.flatten().to_numpy()] = True
                at, here = chosen(h, counts, alive(h, counts, positions))
                rows = np.searchsorted(base + counts, at, "right")
                value, pos = here[at].view(np.int64), (at - base[rows]).astype(np.int32)
                late, other = np.zeros(len(at), bool), value[:0]
                if second:
                    other = there[at].view(np.int64)
                    order = np.lexsort((pos, other, value, rows))
                    late[order[1:]] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (rows, value, other)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        _lists(value[~late], rows[~late], n, pa.int64()),
                        _lists(other[~late], rows[~late], n, pa.int64()) if second else _lists(other, rows[:0], n, pa.int64()),
                        _lists(pos[~late], rows[~late], n, pa.int32()),
                        _lists(pos[late], rows[late], n, pa.int32()),
                    ],
                    ["doc_id", "seq", "hash", "other", "pos", "again"],
                )

    return docs.mapInArrow(run, "doc_id bigint, seq bigint, hash array<bigint>, other array<bigint>, pos array<int>, again array<int>")


def _exploded(found: DataFrame, *columns: str) -> DataFrame:
    rows = found.select("doc_id", "seq", F.explode(F.arrays_zip(*columns, "pos")).alias("w"))
    return rows.select("doc_id", "seq", *(F.col(f"w.{c}").alias(c) for c in (*columns, "pos")))


def _joined(docs: DataFrame, marks: DataFrame, how: str, *columns: str) -> DataFrame:
    """docs with marks of the same document and text; a null id is one document."""
    on = same(docs, marks, "doc_id", "seq")
    return docs.join(marks, on, how).select(docs["doc_id"], docs["seq"], *columns)


def remove_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, base: int = 10) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every word in a window seen earlier is removed.

    Words are runs of bytes other than space and \\x09-\\x0D. A window of `window` words is removed if
    the same words start in a smaller doc_id, or earlier in the same document; windows are judged
    on the input. Kept words are joined by one space.

    Null and empty texts have no words. Rows with a null id come after all others and count as one
    document. Rows that repeat an id are judged by their own text; rows equal in id and text get
    equal results. An empty table gives an empty one.
    """
    source = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("seq"), "text")
    several = (F.col("first") != F.col("last")) | (F.col("nameless") & F.col("first").isNotNull())
    first = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("nameless")]
    ids = source.select("doc_id", "seq", F.unhex(F.sha2("text", 256)).alias("sha"))
    canon = staged(ids.groupBy("sha").agg(*first).where(several).select("sha", "first"), "copied")
    copies = staged(ids.join(canon, "sha").where("NOT (doc_id <=> first)").select("doc_id", "seq").distinct(), "copies")

    lengths = _levels(window, base)
    survivors = None
    for before, length in zip([0, *lengths], lengths, strict=False):
        if survivors is None:
            level = _level(source, window, length, 0)
        else:
            level = _level(_joined(source, survivors, "inner", "text", "pos"), window, length, before)
        found = staged(level.where(F.size("hash") + F.size("again") > 0), f"windows-{length}")
        if length < window:
            rows, key = _exploded(found, "hash"), F.xxhash64("seq", "pos")
            repeated = staged(
                rows.groupBy("hash").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a != b").select("hash"), f"repeated-{length}"
            )
            hits = rows.join(repeated, "hash", "left_semi")
        else:
            rows = _exploded(found, "hash", "other")
            repeated = staged(rows.groupBy("hash", "other").agg(*first).where(several).select("hash", "other", "first"), "first-occurrences")
            hits = rows.join(repeated, ["hash", "other"]).where("NOT (doc_id <=> first)").select("doc_id", "seq", "pos")
            hits = hits.unionByName(found.select("doc_id", "seq", F.explode("again").alias("pos")))
        kept = hits.groupBy("doc_id", "seq").agg(F.collect_set("pos").alias("pos"))  # rows that repeat id and text have one set
        if length < window:
            kept = kept.join(copies, same(kept, copies, "doc_id", "seq"), "left_anti")
        old, survivors = survivors, staged(kept, f"survivors-{length}")
        dropped(found, repeated, *([old] if old is not None else []))
        released(docs.sparkSession, 1.0)
        if survivors.isEmpty():
            break
    starts = survivors.select("doc_id", "seq", F.lit(False).alias("copy"), "pos")
    marks = staged(copies.select("doc_id", "seq", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("pos")).unionByName(starts), "marks")
    dropped(copies, survivors)
    released(docs.sparkSession, 1.0)  # the texts are dealt out once more

    def run(batches):
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            copy, pos = batch.column(2).to_pylist(), batch.column(3)
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_buffer().to_pybytes()
                split = text.split()
                n = len(split)
                gone = 0
                at = pos[row]
                if copy[row] and n >= window:
                    gone, split = n, []
                elif at.is_valid and len(at):
                    at = at.values.to_numpy()
                    edge = np.bincount(at, minlength=n + window + 1) - np.bincount(at + window, minlength=n + window + 1)
                    out = np.cumsum(edge)[:n] > 0
                    gone = int(out.sum())
                    split = [w for w, x in zip(split, out.tolist(), strict=True) if not x]
                n_words.append(n)
                n_removed.append(gone)
                texts.append(b" ".join(split).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    joined = _joined(source, marks, "left", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "pos").drop("seq")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
