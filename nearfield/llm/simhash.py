"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Fingerprints at most `errors` bits apart agree whole in at least `blocks - errors` of `blocks`
bit blocks. One trie per choice of agreeing blocks therefore has every linked pair below one
node of its upper part; tasks take these nodes and walk down the rest of the trie with pairs of
nodes, adding up differing bits and dropping a pair once it is over the budget. Each task hands
on a spanning forest of the links it found, never all pairs. Equal fingerprints are one leaf.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import dropped, only, slices, staged

#: A trie node with more leaves than this is walked as pairs of slices, in several tasks.
NODE_LEAVES = 1024


def _fingerprint(text: bytes, shingle: int, seed: int) -> int:
    words = text.lower().split()  # for bytes: A-Z only, and separators are space and \x09-\x0D
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    k = min(shingle, n)
    counts, total = np.zeros(64, np.int64), n - k + 1
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for at in range(0, total, 1 << 16):
        to = min(total, at + (1 << 16))
        hashed = np.fromiter(
            (xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), stops[at + k - 1 : to + k - 1].tolist(), strict=True)),
            np.uint64,
            to - at,
        )
        by_byte = hashed.astype("<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[8 * i : 8 * i + 8] += np.bincount(by_byte[:, i], minlength=256) @ bits
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint bigint) of each row's whole text.

    A-Z is lower-cased; words lie between space and \\x09-\\x0D; shingles of `shingle` words, repeats
    included, joined by a space, are hashed by XXH64. A text of fewer words is one shingle; a null
    or empty text has fingerprint 0. A null id stays null. Repeated ids give repeated rows.
    """

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for first, last, data, ends in slices(batch.column(1)):
                data, at = data.tobytes(), 0
                for row, end in zip(range(first, last), ends.tolist(), strict=True):
                    out[row] = _fingerprint(data[at:end], shingle, seed)
                    at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "fingerprint"])

    return only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string")).mapInArrow(run, "doc_id bigint, fingerprint bigint")


def _compact(x: np.ndarray, masks: list[tuple[int, int]]) -> np.ndarray:
    """The bits of the given (low, width) fields, put together."""
    out = np.zeros(len(x), np.uint64)
    for low, width in masks:
        out = (out << np.uint64(width)) | ((x >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def trie_self_join(group: np.ndarray, value: np.ndarray, width: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of rows in one group whose values differ in at most `errors` of `width` bits.

    Rows are sorted by group and value; a trie node is a range of rows. Pairs of nodes go down
    together; a pair whose paths differ in more bits than the budget is dropped with all below it.
    """
    n = len(value)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lo = edge.astype(np.int32)
    hi = np.append(edge[1:], n).astype(np.int32)
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    nodes = (lo, hi, lo, hi, np.zeros(len(lo), np.int8))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(width - 1, -1, -1):
        lo1, hi1, lo2, hi2, diff = nodes
        if not len(lo1):
            break
        zeros = np.zeros(n + 1, np.int32)
        np.cumsum(((value >> np.uint64(bit)) & np.uint64(1)) == 0, out=zeros[1:])
        mid1, mid2 = lo1 + zeros[hi1] - zeros[lo1], lo2 + zeros[hi2] - zeros[lo2]
        same = lo1 == lo2
        apart = ~same
        parts = [
            (lo1, mid1, lo2, mid2, diff),
            (mid1, hi1, mid2, hi2, diff),
            (lo1, mid1, mid2, hi2, diff + np.int8(1)),
            tuple(x[apart] for x in (mid1, hi1, lo2, mid2, diff + np.int8(1))),
        ]
        lo1, hi1, lo2, hi2, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (hi1 > lo1) & (hi2 > lo2) & (diff <= errors) & ((lo1 != lo2) | (hi1 - lo1 > 1))
        lo1, hi1, lo2, hi2, diff = (x[keep] for x in (lo1, hi1, lo2, hi2, diff))
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        i, j = lo1[leaf], lo2[leaf]
        below = np.uint64((1 << bit) - 1)
        good = diff[leaf] + np.bitwise_count((value[i] ^ value[j]) & below) <= errors
        found.append((i[good], j[good]))
        nodes = tuple(x[~leaf] for x in (lo1, hi1, lo2, hi2, diff))
    lo1, hi1, lo2, hi2, _ = nodes  # equal values: one run of rows, linked through its first
    for a, b, c, d in zip(lo1, hi1, lo2, hi2, strict=True):
        found.append((np.full(b - a - 1, a), np.arange(a + 1, b)) if a == c else (np.full(d - c, a), np.arange(c, d)))
        if a != c:
            found.append((np.arange(a, b), np.full(b - a, c)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]).astype(np.int64), np.concatenate([x for _, x in found]).astype(np.int64)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of (row, smallest row reachable) with the same components as the links i-j of n rows."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _fields(blocks: int) -> list[tuple[int, int]]:
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def blocks_for(leaves: int, errors: int) -> int:
    """The fewest blocks whose keys spread so many fingerprints to a few hundred a node: fewer copies of each."""
    blocks = errors + 2
    while blocks < 2 * errors + 4 and leaves >> sum(sorted(w for _, w in _fields(blocks))[: blocks - errors]) > 256:
        blocks += 1
    return blocks


def fingerprint_links(leaves: DataFrame, errors: int = 4, blocks: int = 6) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most `errors` bits apart, as spanning forests.

    leaves: one bigint column `fingerprint`, distinct. blocks - errors blocks must agree, so more
    blocks make longer keys and smaller tasks at more copies: 6 have 15 copies and keys of 21 bits,
    8 have 70 and 32 bits; any choice is exact (see blocks_for).
    """
    fields = _fields(blocks)
    tries = list(combinations(range(blocks), blocks - errors))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(((1 << w) - 1) << low for low, w in (fields[b] for b in t))) for t in tries]
    rest = [[fields[b] for b in range(blocks) if b not in t] for t in tries]
    nodes = leaves.select(
        "fingerprint",
        F.explode(F.array(*(F.struct(F.lit(t).alias("trie"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")).alias("node")) for t, m in enumerate(masks)))).alias("x"),
    ).select("x.trie", "x.node", "fingerprint")
    large = staged(nodes.groupBy("trie", "node").count().where(F.col("count") > NODE_LEAVES), "large-nodes")
    one = F.lit(0)
    if large.isEmpty():
        nodes = nodes.withColumn("part", one)
    else:
        parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / NODE_LEAVES).cast("int")
        own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
        nodes = (
            nodes.join(large, ["trie", "node"], "left")
            .withColumn("parts", parts)
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(one, F.col("parts") - 1)))
            .select("trie", "node", "fingerprint", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("part"))
        )

    def join(trie, node, part, value):
        out = []
        for t in np.unique(trie):
            own = np.flatnonzero(trie == t)
            low = _compact(value[own].view(np.uint64), rest[t])
            order = np.lexsort((low, part[own], node[own]))
            own, low = own[order], low[order]
            fresh = (node[own][1:] != node[own][:-1]) | (part[own][1:] != part[own][:-1])
            group = np.concatenate([[0], np.cumsum(fresh)])
            i, j = trie_self_join(group, low, sum(w for _, w in rest[t]), errors)
            rows, roots = spanning(i, j, len(own))
            out.append(np.stack([value[own[rows]], value[own[roots]]]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def run(batches):
        """Groups are contiguous; whole groups are joined once their squared sizes add up."""
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns]))
            rows = np.concatenate(held, axis=1)
            edge = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
            at = int(edge[-1]) if len(edge) else 0
            if at:
                yield from joined(rows[:, :at])
            held = [rows[:, at:]]
        if held:
            yield from joined(np.concatenate(held, axis=1))

    def joined(rows):
        edge = np.concatenate([[0], np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1, [rows.shape[1]]])
        sizes = np.diff(edge)
        work = np.cumsum(np.where(sizes > 1, sizes.astype(np.int64) ** 2, 0))
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + (1 << 21), "right")))
            take = np.repeat(sizes[first:last] > 1, sizes[first:last])
            trie, node, part, value = rows[:, edge[first] : edge[last]][:, take]
            if len(value):
                links = join(trie, node, part, value)
                if links.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])
            first = last

    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        nodes.select(F.col("trie").cast("bigint"), "node", F.col("part").cast("bigint"), "fingerprint")
        .repartition(parts, "trie", "node", "part")
        .sortWithinPartitions("trie", "node", "part")
        .mapInArrow(run, "a bigint, b bigint")
    )


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, errors: int = 4, blocks: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint bigint, component_id, kept): groups of documents linked by fingerprints.

    component_id is the smallest doc_id reachable over links of at most `errors` bits; kept marks
    that document. blocks: of the tries' keys, chosen by the number of fingerprints if not given.

    Null and empty texts have fingerprint 0 and form one group. Rows with a null id
    are passed on with a null component of their own unless their group has ids. An empty table
    gives an empty one; repeated ids give repeated rows.
    """
    marks = staged(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    leaves = staged(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "leaves")
    links = fingerprint_links(leaves.select("fingerprint"), errors, blocks or blocks_for(leaves.count(), errors))
    linked = staged(connected_components(links), "linked")
    roots = (
        linked.join(leaves, linked.node == leaves.fingerprint)
        .groupBy("component")
        .agg(F.min("least").alias("root"))
    )
    groups = staged(linked.join(roots, "component").select(F.col("node").alias("fingerprint"), "root"), "groups")
    reps = staged(
        leaves.join(groups, "fingerprint", "left").select("fingerprint", F.coalesce("root", "least").alias("component_id")), "reps"
    )
    dropped(linked, groups, leaves)
    return marks.join(reps, "fingerprint").select(
        "doc_id", "fingerprint", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
