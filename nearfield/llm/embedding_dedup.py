"""Embedding near-duplicates by sorted projection passes.

Each pass gives every vector a code of concatenated random hashes (on which side of a threshold a
random projection lies), sorts the vectors lexicographically by code, and compares each with a
bounded window of its neighbours in that order; verified links of all passes are united. The sort
is dealt out by ranges of codes, and the first codes of a range are also sent to the range before
it, so that windows reach over range edges whatever the number of partitions is.

Two things keep recall up as tables grow and where they are dense. A hash's threshold is the median
of the sampled vectors with the same code so far, so hot regions are spread as evenly as thin ones.
And the number of passes is measured on the table: sampled vectors with a partner planted at the
threshold's cosine are hashed until the stated share of pairs has met in a window, over all and in
each region. A table of no more than two windows is compared whole. Passes run a few at a time, and
their shuffles are deleted before the next, so disk doesn't grow with the number of passes.

Equal vectors are one vector with a weight from the start. Links inside the clusters found are then
counted exactly: vectors within half the threshold's angle of the cluster's first vector are all
linked with one another, by the triangle inequality; every other vector is compared with its whole
cluster, block by block.
"""

from __future__ import annotations

import math
from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import dropped, only, received, released, sent, staged
from .simhash import spanning

#: Vectors that are compared with one another at a time.
BLOCK = 512
#: Vectors of a cluster that one task compares with as many others.
CHUNK = 4096
#: Bytes of vectors that thresholds are fitted on, and planted pairs that decide the number of passes.
SAMPLE_BYTES = 32 << 20
PROBES = 4_000
#: A threshold is fitted where at least so many sampled vectors share a code; deeper ones are the whole sample's.
FITTED = 8
#: Bits of a code below the node of about `window` vectors: they order the vectors of one node.
FINE_BITS = 16
#: Nodes of a range, as levels; the first node of a range is carried to the range before.
RANGE_LEVELS = 3
#: Passes whose shuffles are on disk at one time.
PASSES_AT_ONCE = 3
#: Regions, as levels of the first pass, that each have to reach the recall but for REGION_SLACK.
REGION_LEVELS = 4
REGION_SLACK = 0.02
_PAIRS = "a bigint, b bigint"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision from a binary column of float32 or float64 vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows, out = column.to_pylist(), np.empty((len(column), dim))
    single = np.fromiter((len(r) == 4 * dim for r in rows), bool, len(rows))
    for kind, which in ((np.float32, single), (np.float64, ~single)):
        if which.any():
            out[which] = np.frombuffer(b"".join(r for r, w in zip(rows, which.tolist(), strict=True) if w), kind).reshape(-1, dim)
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def _packed(v: list | None) -> bytes | None:
    """The vector as float32 where that is exact, else as float64; None if it can't link."""
    x = np.array(v if v and None not in v else [], np.float64)
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return ((single if (single == x).all() else x) + 0.0).tobytes()


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, key, bytes); bytes is null for vectors that can't link: null, not finite, zero."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(v) if v else 0 for v in rows], pa.int32()), pa.array([_packed(v) for v in rows], pa.binary())], ["vec_id", "dim", "bytes"]
            )

    found = vectors.mapInArrow(run, "vec_id bigint, dim int, bytes binary")
    return found.select("vec_id", "dim", F.unhex(F.sha2("bytes", 256)).alias("key"), "bytes")


def _planes(p: int, dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, p, dim]).standard_normal((dim, bits))


def _fitted(x: np.ndarray, planes: np.ndarray) -> list[np.ndarray]:
    """Each level's thresholds: one for each node where enough sampled rows x share a node, else one for all."""
    node, levels = np.zeros(len(x), np.int64), []
    for level, y in enumerate((x @ planes).T):
        if len(x) >> level >= FITTED:
            order = np.lexsort((y, node))
            edge = np.searchsorted(node[order], np.arange((1 << level) + 1))
            middle = np.minimum((edge[:-1] + edge[1:] - 1) // 2, len(x) - 1)
            cut = np.where(np.diff(edge) > 0, y[order][middle], np.median(y))
        else:
            cut = np.array([np.median(y)])
        levels.append(cut)
        node = 2 * node + (y > (cut[node] if len(cut) > 1 else cut[0]))
    return levels


def _codes(x: np.ndarray, planes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The concatenated hashes of each row, the first one the highest bit."""
    node = np.zeros(len(x), np.int64)
    for y, cut in zip((x @ planes).T, levels, strict=True):
        node = 2 * node + (y > (cut[node] if len(cut) > 1 else cut[0]))
    return node


def fitted_passes(x: np.ndarray, rows: int, threshold: float, recall: float, window: int, seed: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(planes, thresholds) of as many passes as let planted pairs meet with the given recall.

    x: sampled unit vectors of a table of `rows` vectors. Each probe is a sampled vector, its
    partner one at the threshold's cosine in a random direction. They meet if their codes share a
    node of about `window` vectors, or if the sample puts them less than a window apart, with a
    margin of two of its own steps.
    """
    dim = x.shape[1]
    depth = max(0, math.ceil(math.log2(rows / window)))
    rng = np.random.default_rng([seed, dim])
    q = x[rng.choice(len(x), min(PROBES, len(x)), replace=False)]
    side = rng.standard_normal(q.shape)
    side -= np.einsum("ij,ij->i", side, q)[:, None] * q
    side /= np.maximum(np.sqrt(np.einsum("ij,ij->i", side, side)), 1e-300)[:, None]
    partner = threshold * q + math.sqrt(max(0.0, 1 - threshold**2)) * side
    passes, met, region, step = [], np.zeros(len(q), bool), None, rows / len(x)
    while True:
        planes = _planes(len(passes), dim, depth + FINE_BITS, seed)
        passes.append((planes, _fitted(x, planes)))
        a, b, known = (_codes(v, *passes[-1]) for v in (q, partner, x))
        known.sort()
        apart = np.abs(np.searchsorted(known, a) - np.searchsorted(known, b))
        region = a >> FINE_BITS + max(0, depth - REGION_LEVELS) if region is None else region
        met |= (a >> FINE_BITS == b >> FINE_BITS) | ((apart + 2) * step <= window)
        if met.mean() >= recall and (np.bincount(region, met) >= (recall - REGION_SLACK) * np.bincount(region)).all():
            return passes


def _forests(reps: DataFrame, threshold: float, recall: float, window: int, seed: int) -> dict[int, list]:
    """Passes of each dimension that has more than two windows of vectors."""
    counts = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().where(F.col("count") > 2 * window).collect()}
    out = {}
    for dim, n in sorted(counts.items()):
        most = max(2 * PROBES, SAMPLE_BYTES // (8 * dim))
        own = reps.where(F.col("dim") == dim).select("vec_id", "bytes")
        near = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // most))) == 0)
        sample = near.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
        out[dim] = fitted_passes(_matrix(sample.column(1), dim), n, threshold, recall, window, seed)
    return out


def _forest(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids as a spanning forest."""
    ids, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    half = len(at) // 2
    a, b = spanning(at[:half], at[half:], len(ids))
    return ids[a], ids[b]


def _linking(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of a block's links (rows x columns) as keep its components: each column's first, then what joins others."""
    n, columns = len(hits), np.flatnonzero(hits.any(0))
    rows, label = hits[:, columns].argmax(0) if len(columns) else columns, np.arange(sum(hits.shape))
    node, root = spanning(rows, n + columns, len(label))
    label[node] = root
    more, others = np.nonzero(hits & (label[:n, None] != label[None, n:]))
    return np.concatenate([rows, more]), np.concatenate([columns, others])


def _pass_links(reps: DataFrame, passes: dict[int, list], first: int, threshold: float, window: int) -> DataFrame:
    """Links that PASSES_AT_ONCE passes from `first` on find, as spanning forests; pass 0 has all dimensions."""
    known = sent(reps.sparkSession, {d: (len(p[0][1]) - FINE_BITS, p[first : first + PASSES_AT_ONCE]) for d, p in passes.items()})
    small = first == 0

    def hashed(batches):
        fitted = received(known)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in fitted:  # one range, compared whole
                    if small:
                        yield rows(own, 0, np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows, np.int64))
                    continue
                depth, own_passes = fitted[dim]
                x = _matrix(own.column(2), dim)
                for p, tree in enumerate(own_passes):
                    code = _codes(x, *tree)
                    node = code >> FINE_BITS
                    span = node >> RANGE_LEVELS if depth > RANGE_LEVELS else np.zeros(len(node), np.int64)
                    yield rows(own, p, span, code)
                    carried = np.flatnonzero((node % (1 << RANGE_LEVELS) == 0) & (span > 0))
                    if len(carried):
                        yield rows(own.take(pa.array(carried)), p, span[carried] - 1, code[carried])

    def rows(own, p, span, code):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(code), p, np.int32)), own.column(1), pa.array(span), pa.array(code), own.column(0), own.column(2)],
            ["run", "dim", "span", "code", "vec_id", "bytes"],
        )

    def compared(batches):
        """Blocks of each range in order, each compared with itself and the blocks a window back."""
        many = set(received(known))
        at, held, left, right = None, deque(), [], []
        rest: list[pa.RecordBatch] = []

        def block():
            dim = at[1]
            table = pa.Table.from_batches(rest).combine_chunks()
            ids, x = table.column(4).to_numpy(), _matrix(table.column(5), dim)
            rest.clear()
            held.append((ids, x))
            for old_ids, old in held:
                i, j = _linking((old @ x.T >= threshold) & (old_ids[:, None] != ids[None, :]))
                left.append(old_ids[i])
                right.append(ids[j])
            if dim in many and len(held) > -(-window // BLOCK):
                held.popleft()

        def links():
            a, b = _forest(left, right)
            left.clear()
            right.clear()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:], strict=False):
                if b > a and at != (own := tuple(key[:, a].tolist())):
                    if rest:
                        block()
                    held.clear()
                    at = own
                while a < b:
                    to = min(b, a + BLOCK - sum(r.num_rows for r in rest))
                    rest.append(batch.slice(a, to - a))
                    a = to
                    if sum(r.num_rows for r in rest) == BLOCK:
                        block()
                    if sum(map(len, left)) > 1 << 21:  # a forest says as much
                        yield from links()
        if rest:
            block()
        if left:
            yield from links()

    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["run", "dim", "span"]
    coded = reps.select("vec_id", "dim", "bytes").mapInArrow(hashed, "run int, dim int, span bigint, code bigint, vec_id bigint, bytes binary")
    return coded.repartition(parts, *order).sortWithinPartitions(*order, "code", "vec_id").mapInArrow(compared, _PAIRS)


def projection_links(reps: DataFrame, threshold: float, recall: float, window: int, seed: int) -> DataFrame:
    """Links (a, b) with cosine >= threshold that the passes find, as spanning forests.

    reps: vec_id, dim, bytes, a stage table.
    """
    passes = _forests(reps, threshold, recall, window, seed)
    found = []
    for first in range(0, max([1, *map(len, passes.values())]), PASSES_AT_ONCE):
        found.append(staged(_pass_links(reps, passes, first, threshold, window), "links"))
        released(reps.sparkSession)
    return reduce(DataFrame.unionByName, found)


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, n) of each member: the weight of cluster members linked with it, itself not counted.

    members: component, vec_id, dim, bytes, weight; in clusters of more than one.
    """
    near = 0.5 * math.acos(min(1.0, threshold)) * (1 - 1e-9)
    roots = staged(members.where("vec_id = component").select("component", F.col("bytes").alias("root")), "roots")

    def cored(batches):
        for batch in batches:
            core = np.zeros(batch.num_rows, bool)
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                own = batch.take(pa.array(rows))
                cosine = np.einsum("ij,ij->i", _matrix(own.column(3), int(dim)), _matrix(own.column(5), int(dim)))
                core[rows] = np.arccos(np.clip(cosine, -1, 1)) <= near
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(core)], ["component", "vec_id", "dim", "bytes", "weight", "core"])

    kind = "component bigint, vec_id bigint, dim int, bytes binary, weight bigint, core boolean"
    marked = staged(members.join(roots, "component").select("component", "vec_id", "dim", "bytes", "weight", "root").mapInArrow(cored, kind), "cored")
    sums = staged(
        marked.groupBy("component").agg(
            F.sum(F.when(F.col("core"), F.col("weight")).otherwise(0)).alias("core_weight"),
            F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("others"),
            F.count("*").alias("size"),
        ),
        "clusters",
    )
    joined = marked.join(sums, "component")
    base = joined.select("vec_id", F.when(F.col("core"), F.col("core_weight") - F.col("weight")).otherwise(0).alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / CHUNK)).cast("bigint")
    open_ = joined.where("others > 0").select(
        "component", "vec_id", "dim", "bytes", "weight", "core",
        blocks(F.col("others")).alias("nq"), blocks(F.col("size")).alias("nm"), F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("h"),
    )
    queries = open_.where("NOT core").select(
        "component", (F.col("h") % F.col("nq")).alias("q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nm") - 1)).alias("m"),
        F.lit(True).alias("asks"), "vec_id", "dim", "bytes", "weight", "core",
    )
    targets = open_.select(
        "component", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nq") - 1)).alias("q"), (F.col("h") % F.col("nm")).alias("m"),
        F.lit(False).alias("asks"), "vec_id", "dim", "bytes", "weight", "core",
    )

    def compared(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            key = np.stack([table.column(i).to_numpy() for i in range(3)])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            whole = int(edge[-1]) if len(edge) else 0
            yield from _groups(table, [0, *edge.tolist()])
            held = table.slice(whole)
        if held is not None and held.num_rows:
            yield from _groups(held, [0, held.num_rows])

    def _groups(table, edges):
        for a, b in zip(edges, edges[1:], strict=False):
            part = table.slice(a, b - a).combine_chunks()
            asks, ids, dims, core = (part.column(i).to_numpy() for i in (3, 4, 5, 8))
            weight = part.column(7).to_numpy()
            n = np.zeros(b - a, np.int64)
            for dim in np.unique(dims):
                q, m = np.flatnonzero(asks & (dims == dim)), np.flatnonzero(~asks & (dims == dim))
                if not len(q) or not len(m):
                    continue
                x, y = (_matrix(part.column(6).combine_chunks().take(pa.array(r)), int(dim)) for r in (q, m))
                for i in range(0, len(q), BLOCK):
                    own = q[i : i + BLOCK]
                    near = (x[i : i + BLOCK] @ y.T >= threshold) & (ids[own][:, None] != ids[m][None, :])
                    n[own] += near @ weight[m]
                    n[m] += np.where(core[m], weight[own] @ near, 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["vec_id", "n"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = queries.unionByName(targets).repartition(parts, "component", "q", "m").sortWithinPartitions("component", "q", "m").mapInArrow(compared, "vec_id bigint, n bigint")
    return base.unionByName(found).groupBy("vec_id").agg(F.sum("n").alias("n"))


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.95, window: int = 2048, seed: int = 7
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector, by cosine in double precision.

    n_links counts other ids linked directly; component_id is the smallest vec_id reachable by
    links; kept marks it. Passes are added until a pair at the threshold is compared with a
    probability of `recall`, as measured on the table; up to twice `window` vectors of a dimension
    are compared whole. Links inside a cluster found are all counted.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    nor do rows with a null id (component null, not kept). Only vectors of equal dimension link.
    Rows equal in id and vector count once. An empty table gives an empty one.
    """
    source = only(vectors, vec_id=(id_col, "bigint"), embedding=(vector_col, "array<double>"))
    checked = staged(_usable(source), "vectors")
    can = F.col("bytes").isNotNull() & F.col("vec_id").isNotNull()
    usable = checked.where(can)
    copies = staged(usable.groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight")), "copies")
    reps = usable.join(copies.select("rep", F.col("key").alias("k"), "weight"), (F.col("vec_id") == F.col("rep")) & (F.col("key") == F.col("k")))
    reps = staged(reps.select("vec_id", "dim", "bytes", "weight").dropDuplicates(["vec_id", "dim", "bytes"]), "distinct")
    linked = staged(connected_components(projection_links(reps, threshold, recall, window, seed)), "linked")
    members = reps.join(linked, F.col("vec_id") == F.col("node")).select("component", "vec_id", "dim", "bytes", "weight")
    counted = _counted(members, threshold)
    clusters = linked.select(F.col("node").alias("rep"), "component").join(counted.select(F.col("vec_id").alias("rep"), "n"), "rep")
    info = staged(
        copies.join(clusters, "rep", "left").select(
            "dim", "key", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
        ),
        "clustered",
    )
    own = usable.join(info, ["dim", "key"]).select("vec_id", "n_links", "component_id")
    dropped(linked, reps, copies)
    alone = checked.where(~can).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
