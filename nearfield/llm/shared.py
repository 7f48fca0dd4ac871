"""What the operators share: stage tables, released shuffles, and vectorised word hashing."""

from __future__ import annotations

import atexit
import gc
import pickle
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import shared_dir

#: Bytes of text that one vectorised step looks at; longer texts are cut at a separator.
SLICE_BYTES = 1 << 20

_stage_paths: set[str] = set()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place for a stage table; what is left of it goes when this Python process ends."""
    if not _stage_paths:
        atexit.register(_cleaned)
    path = f"{shared_dir(spark)}/nearfield/{name}-{uuid.uuid4().hex}"
    _stage_paths.add(path)
    return path


def _deleted(jvm, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    _stage_paths.discard(path)


def _cleaned() -> None:
    jvm = SparkContext._jvm
    for path in sorted(_stage_paths):
        try:
            _deleted(jvm, path)
        except Exception:  # the JVM is gone, and with it the way to a remote store
            return


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here.

    Lost executors then cost a reread at most, and the table's size is known to the planner.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nearfield_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stage tables that no later step reads, and lets Spark delete shuffles nobody holds."""
    for table in tables:
        path = getattr(table, "_nearfield_path", None)
        if path:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            _stage_paths.discard(path)
    released(tables[0].sparkSession)


def released(spark: SparkSession, seconds: float = 0.0) -> None:
    """Spark deletes shuffle files once their plans are collected; a finished level asks for that.

    seconds: to leave the cleaner, which works beside the driver, before a step that writes much.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(seconds)


def sent(spark: SparkSession, value) -> Broadcast:
    """Broadcasts an object of a class of this package, with the class: see received()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(value: Broadcast):
    return pickle.loads(value.value)


def only(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """The named columns alone, under the operator's own names: other columns can't clash.

    Values are cast, so that a narrower id or an all-null column is accepted.
    """
    return df.select(*(F.col(f"`{source}`").cast(kind).alias(target) for target, (source, kind) in columns.items()))


def carrying(docs: DataFrame, carried: tuple[str, ...], made: tuple[str, ...]) -> list[T.StructField]:
    """The fields of docs that go through an operator as they are; none may have the name of one it makes."""
    clash = sorted(set(carried) & set(made))
    if clash:
        raise ValueError(f"columns made here can't be carried: {', '.join(clash)}")
    return [T.StructField(c, docs.schema[c].dataType) for c in carried]


def same(left: DataFrame, right: DataFrame, *columns: str):
    """Equality of the named columns, in which null equals null."""
    out = None
    for c in columns:
        one = left[c].eqNullSafe(right[c])
        out = one if out is None else out & one
    return out


# --- words -------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Splits UTF-8 bytes into words at given ASCII separators and hashes each word to 64 bits.

    fold lower-cases A-Z; other seeds give independent hashes. Everything is vectorised over a
    slice of many texts.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, separators: bytes, fold: bool, seed: int = 0):
        if seed:
            self.BASE = _mixed(np.array([seed], np.uint64))[0] | np.uint64(1)
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        code = np.arange(256, dtype=np.uint64)
        if fold:
            code[65:91] += np.uint64(32)
        self.code = _mixed(code + np.uint64(0x1234567 + (seed << 20)))
        self.power = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.power) <= n:
            x = np.full(max(n + 1, SLICE_BYTES + 1), self.BASE, np.uint64)
            x[0] = 1
            self.power = np.multiply.accumulate(x)
        return self.power

    def hashed(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data: bytes of texts one after the other, text i ending at ends[i].

        Returns each word's hash, first byte and end, and the number of words of each text.
        """
        n = len(data)
        inside = ~self.separator[data]
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        edge[0] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
        power = self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.code[data] * power[:n], out=total[1:])
        h = (total[stops] - total[starts]) * power[n - starts] * self._scale(n)
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        return _mixed(h + (stops - starts).astype(np.uint64)), starts, stops, counts

    def _scale(self, n: int) -> np.uint64:
        # power[n - start] depends on the slice's length n; this takes it out again
        return np.uint64(pow(int(self.BASE), -n, 1 << 64))


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Runs of texts of about limit bytes: (first row, row after the last, bytes, ends). Null: empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def word_slices(texts: pa.Array, words: Words):
    """As slices(), hashed: (first, last, bytes, hashes, starts, stops, words of each text).

    A text much longer than a slice is cut after separators, so memory follows the slice.
    """
    for first, last, data, ends in slices(texts, SLICE_BYTES):
        if len(data) <= 2 * SLICE_BYTES:
            yield (first, last, data, *words.hashed(data, ends))
            continue
        parts, at = [], 0
        while at < len(data):
            to = min(len(data), at + SLICE_BYTES)
            while to < len(data) and not words.separator[data[to - 1]]:
                gap = np.flatnonzero(words.separator[data[to : to + SLICE_BYTES]])
                to = to + int(gap[0]) + 1 if len(gap) else min(len(data), to + SLICE_BYTES)
            h, a, b, _ = words.hashed(data[at:to], np.array([to - at]))
            parts.append((h, a + at, b + at))
            at = to
        h, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield first, last, data, h, a, b, np.diff(np.searchsorted(a, ends), prepend=0)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; the last k-1 entries are not whole windows."""
    out = np.zeros(len(h), np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    n = len(h)
    for i in range(k):
        out[: max(0, n - i)] = out[: max(0, n - i)] * base + h[i:]
    return _mixed(out)


def words_left(counts: np.ndarray) -> np.ndarray:
    """For each word, how many words its text has from it on, itself included."""
    total = int(counts.sum())
    return np.repeat(np.cumsum(counts), counts) - np.arange(total)


def sliding(x: np.ndarray, k: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each k consecutive values, as long as x; ends see fewer values."""
    pick = np.minimum if least else np.maximum
    out, span = x.copy(), 1
    while span < k:
        step = min(span, k - span)
        out[:-step or None] = pick(out[:-step or None], out[step:]) if step < len(out) else out[:-step or None]
        span += step
    return out
