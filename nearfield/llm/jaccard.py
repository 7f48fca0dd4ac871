"""Near-duplicates by Jaccard similarity of word-shingle sets: given candidates, bands of minima, verification.

Candidates known from elsewhere, such as fingerprints, are verified first. Sets that also agree in
all minima of one of BANDS bands (of ROWS minima each, under random orders of all shingles) form a
group: a pair of similarity s is in a common group with probability 1 - (1 - s^ROWS)^BANDS, 0.995
at 0.8 and 0.9999 at 0.9. Groups that the candidates have already brought into one component are
settled; of the others every member is compared with every member of another component, on the
whole sets, in the task that holds the group, which hands on a spanning forest and never pairs.
Large groups are dealt out as pairs of slices. Equal sets are one set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import Words, _mixed, dropped, only, staged, window_hashes, word_slices
from .simhash import spanning

BANDS = 10
ROWS = 4
#: Members of a group in one slice; shingles of a text whose minima are taken at a time.
SLICE = 512
SHINGLES = 8192
#: Groups up to this size are compared pair by pair; a shingle in more members than this is counted by a matrix product.
SMALL = 24
COMMON = 24
SEPARATORS = b"\t\n\v\f\r "
_EPS = 1e-9  # a bound that rounding puts above a whole number must not drop a pair


def shingle_sets(texts: pa.Array, shingle: int, words: Words):
    """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle, of none none."""
    for _, _, _, h, _, _, counts in word_slices(texts, words):
        windows, at = window_hashes(h, shingle), 0
        for n in counts.tolist():
            if n >= shingle:
                yield np.unique(windows[at : at + n - shingle + 1])
            else:
                yield window_hashes(h[at : at + n], n)[:1] if n else np.zeros(0, np.uint64)
            at += n


class _Minima:
    def __init__(self, seed: int = 3):
        x = _mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(seed << 32))
        self.turn, self.scale = x[::2, None], x[1::2, None] | np.uint64(1)

    def bands(self, s: np.ndarray) -> np.ndarray:
        """One hash for each band of minima of the set; none of an empty set."""
        if not len(s):
            return s
        least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
        for at in range(0, len(s), SHINGLES):
            np.minimum(least, ((s[at : at + SHINGLES] ^ self.turn) * self.scale).min(1), out=least)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for minimum in least.reshape(BANDS, ROWS).T:
            out = _mixed(out ^ minimum)
        return out


def with_set_keys(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with set_key (a 64-bit hash of the text's set of shingles) and bands (see bands above) added."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("set_key", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    names = schema.names

    def run(batches):
        words, minima = Words(SEPARATORS, fold=True), _Minima()
        for batch in batches:
            keys, bands = [], []
            for s in shingle_sets(batch.column(at), shingle, words):
                keys.append(xxhash.xxh64_intdigest(s.tobytes()))
                bands.append(minima.bands(s).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(keys, np.uint64).view(np.int64)), lists], names)

    return docs.mapInArrow(run, schema)


def _sets(keyed: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(key, bytes): the sets of the given keys, as bytes of their sorted hashes; a stage table."""

    def run(batches):
        words, seen = Words(SEPARATORS, fold=True), set()
        for batch in batches:
            out, ids = [], []
            for key, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), shingle, words), strict=True):
                if key not in seen:
                    seen.add(key)
                    ids.append(key)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["key", "bytes"])

    # written first: while they are few, their known size spares the texts a shuffle
    wanted = staged(keys.select(F.col("key").alias("set_key")).distinct(), "wanted")
    asked = keyed.join(wanted, "set_key", "left_semi")
    found = only(asked, key=("set_key", "bigint"), text=("text", "string")).mapInArrow(run, "key bigint, bytes binary")
    sets = staged(found.dropDuplicates(["key"]), "sets")
    dropped(wanted)
    return sets


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    if min(len(x), len(y)) < threshold * max(len(x), len(y)) - _EPS:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both) - _EPS


def _verified(pairs: DataFrame, keyed: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of threshold or more."""
    sets = _sets(keyed, pairs.select(F.col("a").alias("key")).union(pairs.select("b")), shingle)

    def run(batches):
        for batch in batches:
            near = [
                _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            kept = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    one = sets.select(F.col("key").alias("a"), F.col("bytes").alias("x"))
    other = sets.select(F.col("key").alias("b"), F.col("bytes").alias("y"))
    found = staged(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "near")
    dropped(sets)
    return found


def group_links(sets: list[np.ndarray], label: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between sets of different labels with a similarity of threshold or more, as a spanning forest."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n <= SMALL:
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if label[i] != label[j] and _alike(sets[i], sets[j], threshold)]
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        return spanning(i, j, n)
    row, (_, code, count) = np.repeat(np.arange(n), size), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32)
    common = np.flatnonzero(count > COMMON)
    place = np.full(len(count), -1)
    place[common] = np.arange(len(common))
    for at in range(0, len(common), 2048):
        has = np.zeros((n, min(2048, len(common) - at)), np.float32)
        own = (place[code] >= at) & (place[code] < at + 2048)
        has[row[own], place[code[own]] - at] = 1
        both += has @ has.T
    own = np.flatnonzero((count[code] > 1) & (count[code] <= COMMON))
    own = own[np.argsort(code[own], kind="stable")]
    code, row = code[own], row[own]
    for step in range(1, COMMON):  # the step-th next member that has the same rare shingle
        if step >= len(code):
            break
        on = code[step:] == code[:-step]
        np.add.at(both, (row[:-step][on], row[step:][on]), 1)
        np.add.at(both, (row[step:][on], row[:-step][on]), 1)
    alike = (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-4) & (label[:, None] != label[None, :])
    return spanning(*np.nonzero(np.triu(alike, 1)), n)


def _group_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) inside groups. members: hash, part, key, label, bytes."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            for own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own[:2] != at:
                    yield from links(held)
                    at, held = own[:2], []
                held.append(own[2:])
        yield from links(held)

    def links(held):
        if len(held) > 1:
            key, label, data = zip(*held, strict=True)
            i, j = group_links([np.frombuffer(x, np.uint64) for x in data], np.array(label), threshold)
            if len(i):
                key = np.array(key)
                yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j])], ["a", "b"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("hash", "part", "key", "label", "bytes").repartition(parts, "hash", "part")
    return rows.sortWithinPartitions("hash", "part").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(keyed: DataFrame, candidates: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(node, component) of set keys over links of similarity threshold or more; keys without links are left out.

    keyed: with_set_keys() of texts, a stage table. candidates: pairs (a, b) of set keys to try first.
    Words are compared with A-Z lower-cased, shingles and sets by 64-bit hashes; sets without a
    shingle link with nothing but are equal among themselves.
    """
    tried = staged(candidates.select("a", "b").where("a != b").distinct(), "candidates")
    near = _verified(tried, keyed, shingle, threshold)
    labels = staged(connected_components(near), "labels")
    each = keyed.where(F.size("bands") > 0).groupBy(F.col("set_key").alias("key")).agg(F.first("bands").alias("bands"))
    each = each.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("label"), F.explode("bands").alias("hash"))
    postings = staged(each, "postings")
    groups = postings.groupBy("hash").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("hash", "n")
    members = staged(postings.join(staged(groups, "groups"), "hash"), "members")
    sets = _sets(keyed, members, shingle)
    cuts = F.ceil(F.col("n") / SLICE).cast("int")
    own, other = F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    dealt = members.withColumn("cuts", cuts).withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("hash", "key", "label", (F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")).alias("part"))
    more = staged(_group_links(dealt.join(sets, "key"), threshold), "group-links")
    found = staged(connected_components(near.unionByName(more)), "components")
    dropped(tried, near, labels, postings, members, sets, more)
    return found
