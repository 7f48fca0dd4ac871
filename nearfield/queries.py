"""Registered queries of the search engine and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import (
    build_ivf,
    calibrate,
    column_percentile,
    confirm,
    duplicate_ids,
    half_table,
    half_top_k,
    ivf_knn_join,
    knn_join,
    knn_join_by_class,
    predicate_violations,
    recall_by_class,
    sq8_statistics,
    truth,
)
from .operators.quantized import sq8_scale, sq8_table
from .plans import Router, Settings, knn
from .sources import VARIANTS, build_snapshot, capacity, items, open_snapshot
from .sources.csv_vectors import dataset_manifest, read_vector_csv, write_vector_csv
from .streaming import REQUEST_SCHEMA, serve
from .workspace import scratch

Query = Callable[[SparkSession, str], DataFrame]

#: The query vector of single searches, the six classes of predicates.
QUERY_ID = 3
CLASSES = {
    "Equality_bool": "bool_attr = 1",
    "Equality_int": "int_attr = 0",
    "Inclusion": "int_attr IN (0, 1, 2)",
    "Logic": "int_attr = 0 AND float_attr >= 0 AND float_attr < 50",
    "Range_10": "float_attr >= 0 AND float_attr < 10",
    "Range_50": "float_attr >= 0 AND float_attr < 50",
}

#: name -> (variant of items, predicate)
SINGLE = {
    "knn_eq_bool": ("plain", CLASSES["Equality_bool"]),
    "knn_eq_int": ("plain", CLASSES["Equality_int"]),
    "knn_in": ("plain", CLASSES["Inclusion"]),
    "knn_range10": ("plain", CLASSES["Range_10"]),
    "knn_range50": ("plain", CLASSES["Range_50"]),
    "knn_logic": ("plain", CLASSES["Logic"]),
    "knn_or": ("plain", "int_attr = 4 OR float_attr < 5"),
    "knn_not": ("null_scalar", "NOT (float_attr < 50)"),
    "knn_not_and": ("null_scalar", "NOT (float_attr < 50 AND int_attr = 1)"),
    "knn_ne": ("null_scalar", "float_attr <> 25"),
    "knn_in_dup": ("plain", "int_attr IN (0, 1, 1, 0)"),
    "knn_in_null": ("plain", "int_attr IN (0, NULL, 2)"),
    "knn_not_in": ("plain", "int_attr NOT IN (0, 1)"),
    "knn_bool_col": ("flags", "flag"),
    "knn_reversed": ("plain", "50 > float_attr AND 2 <= int_attr"),
    "knn_residual_mod": ("plain", "(int_attr % 3) = 0"),
    "knn_null_constant": ("plain", "int_attr = CAST(NULL AS INT)"),
    "knn_empty": ("plain", "int_attr = 99"),
    "knn_nofilter": ("plain", None),
    "knn_nested": ("null_scalar", "(int_attr < 3 OR NOT (bool_attr = 1)) AND (float_attr BETWEEN 10 AND 60 OR float_attr IS NULL)"),
    "knn_null_scalar": ("null_scalar", "float_attr < 50"),
    "knn_nan_scalar": ("nan_scalar", "float_attr > 90"),
    "knn_bigint": ("bigint", "big < 4503599627370700 AND big >= 4503599627370497"),
    "knn_null_vector": ("null_vector", "int_attr IN (0, 1, 2)"),
    "knn_ties": ("ties", "int_attr IN (0, 1, 2)"),
}



def _query(spark: SparkSession, sf_dir: str, id: int = QUERY_ID) -> list[float]:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == id).first()["embedding"]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0")
    names = F.array(*(F.lit(c) for c in sorted(CLASSES)))
    return rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.get(names, ((F.col("vec_id") / 100).cast("int") % 6)).alias("class"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("vec_id", F.round("d", 6).alias("d"))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("vec_id"), F.round(F.sqrt("d2"), 6).alias("d"))


def _single(name: str, spark: SparkSession, sf_dir: str, offset: int = 0) -> DataFrame:
    variant, where = SINGLE[name]
    search = knn(items(spark, sf_dir, variant)).order_by_l2("embedding", _query(spark, sf_dir)).limit(10).offset(offset)
    return _rounded((search.where(where) if where else search).result())


def knn_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single("knn_in", spark, sf_dir, offset=5)


def knn_wide_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top k over vectors joined with part; the wide columns come after, for k rows."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    base = items(spark, sf_dir).select("vec_id", "embedding").join(part.select(F.col("p_partkey").alias("vec_id"), "p_retailprice", "p_size"), "vec_id")
    found = knn(base).where("p_retailprice < 1500 AND p_size IN (1, 2, 3, 5, 8, 13, 21, 34)").order_by_l2("embedding", _query(spark, sf_dir)).limit(10).result()
    return _rounded(found).join(part.select(F.col("p_partkey").alias("vec_id"), "p_name"), "vec_id").select("vec_id", "d", "p_name")


def knn_live_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search whose rows must still be in the live table; here rows of label 1 have left it."""
    base = items(spark, sf_dir)
    search = knn(base).using(live=base.where("int_attr <> 1")).where("int_attr IN (0, 1, 2)").order_by_l2("embedding", _query(spark, sf_dir)).limit(10)
    return _rounded(search.result())


def knn_query_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query vector comes as a one-row DataFrame."""
    q = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 17").select("embedding")
    return _rounded(knn(items(spark, sf_dir)).where("(int_attr % 3) = 0").order_by_l2("embedding", q).limit(10).result())


def knn_join_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(knn_join(_asked(spark, sf_dir), items(spark, sf_dir), 10))


def knn_join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(knn_join(_asked(spark, sf_dir), items(spark, sf_dir), 10, where=CLASSES["Inclusion"]))


def knn_join_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries don't find themselves."""
    return _ranked(knn_join(_asked(spark, sf_dir), items(spark, sf_dir), 10, exclude_self=True))


def knn_join_per_query_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(knn_join_by_class(_asked(spark, sf_dir), items(spark, sf_dir), 10, CLASSES))


def truth_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(truth(_asked(spark, sf_dir), items(spark, sf_dir), 10))


def _post_filtered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth by class, and what filtering an unfiltered top ten afterwards leaves of it."""
    asked, base = _asked(spark, sf_dir), items(spark, sf_dir)
    gt = knn_join_by_class(asked, base, 10, CLASSES)
    cases = " ".join(f"WHEN class = '{c}' THEN {p}" for c, p in CLASSES.items())
    found = truth(asked, base, 10).join(asked.select("qid", "class"), "qid").join(base.withColumnRenamed("vec_id", "id").drop("embedding"), "id")
    return gt, found.where(f"CASE {cases} END").select("qid", "id")


def recall_by_class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, found = _post_filtered(spark, sf_dir)
    return recall_by_class(gt, found, _asked(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


def predicate_violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the unfiltered results break the Logic predicate."""
    base = items(spark, sf_dir)
    return predicate_violations(truth(_asked(spark, sf_dir), base, 10), base, CLASSES["Logic"])


def duplicate_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_ids(truth(_asked(spark, sf_dir), items(spark, sf_dir), 10))


def col_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = items(spark, sf_dir, "null_scalar")
    found = None
    for f in (0.0, 0.1, 0.5, 0.9, 1.0):
        one = column_percentile(base, "float_attr", f).select(F.lit(f).alias("fraction"), "value")
        found = one if found is None else found.unionByName(one)
    return found


def sq8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = sq8_statistics(items(spark, sf_dir, "null_vector"))
    scale = sq8_scale(stats).scale
    return stats.select("pos", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), F.lit(round(scale, 8)).alias("scale"))


def capacity_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capacity(items(spark, sf_dir, "null_vector"))
    return found.where("metric IN ('rows', 'null_vectors', 'dim', 'scalar_columns', 'index_bytes', 'coded_bytes', 'disk_bytes', 'visited_bytes')").select("metric", "value")


def _snapshot(spark: SparkSession, sf_dir: str, variant: str = "plain", **options):
    root = scratch(spark, "snapshot")
    n = build_snapshot(items(spark, sf_dir, variant), root, **options)
    return n, open_snapshot(spark, root)


def snapshot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, snap = _snapshot(spark, sf_dir)
    return snap.table.agg(F.count("*").alias("stored"), F.countDistinct("vec_id").alias("ids"), F.lit(n).cast("bigint").alias("built"))


def snapshot_null_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with null vectors are not indexed; scalars keep their types and values."""
    _, snap = _snapshot(spark, sf_dir, "null_vector", ivf=False)
    return snap.table.select("vec_id", "bool_attr", "int_attr", "float_attr")


def knn_snapshot_sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded search of a snapshot with the usual rerank budget."""
    _, snap = _snapshot(spark, sf_dir, ivf=False)
    return _rounded(snap.knn().where(CLASSES["Inclusion"]).order_by_l2("embedding", _query(spark, sf_dir)).limit(10).strategy("sq8").result())


def knn_ivf_sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded search of all lists of a snapshot, reranked: what knn_snapshot_sq8 has, by way of the lists."""
    _, snap = _snapshot(spark, sf_dir)
    search = snap.knn(router=Router(Settings(ef_search=64))).where(CLASSES["Inclusion"]).order_by_l2("embedding", _query(spark, sf_dir)).limit(10)
    return _rounded(search.strategy("ivf_sq8", snap.ivf.lists).result())


def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot's metadata tells, and what its rows have."""
    _, snap = _snapshot(spark, sf_dir, "null_vector")
    said = snap.accessors()
    found = snap.table.agg(F.count("*").alias("stored"), F.max(F.size(said["vector"])).alias("stored_dim"))
    return found.select(F.lit(said["rows"]).cast("bigint").alias("rows"), F.lit(said["dim"]).alias("dim"), F.lit(len(said["scalars"])).alias("scalars"), "stored", "stored_dim")


def knn_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is written as CSV, read back, and searched."""
    at, base = scratch(spark, "csv"), items(spark, sf_dir)
    write_vector_csv(base, at)
    return _rounded(knn(read_vector_csv(spark, at, base.schema)).where("int_attr IN (0, 1, 2)").order_by_l2("embedding", _query(spark, sf_dir)).limit(10).result())


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(items(spark, sf_dir, "null_vector")).select("column", "rows", "nulls", "dim")


def knn_ivf_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_ivf(items(spark, sf_dir), at=scratch(spark, "ivf"))
    return _ranked(ivf_knn_join(_asked(spark, sf_dir), index, 10, index.lists, where=CLASSES["Inclusion"]))


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As few lists, by eighths, as give every class a recall of 0.9 against truth; all if need be.

    Probes are calibrated on one half of at most 200 of the queries and hold only if the other half confirms them.
    """
    base, asked, where = items(spark, sf_dir), _asked(spark, sf_dir), CLASSES["Inclusion"]
    index = build_ivf(base, at=scratch(spark, "ivf"))
    sample = asked.orderBy(F.xxhash64("qid"), "qid").limit(200)
    odd = F.floor(F.col("qid") / 100) % 2 == 1
    chosen, other = sample.where(~odd), sample.where(odd)
    gt, unseen = (truth(x, base, 10, where=where) for x in (chosen, other))
    probes = index.lists
    for eighths in range(4, 8):
        n = max(1, index.lists * eighths // 8)
        search = lambda n, of=chosen: ivf_knn_join(of, index, 10, n, where=where)
        if calibrate(search, (n,), gt, chosen)[0]["eligible"] and confirm(lambda: search(n, other), unseen, other)["confirmed"]:
            probes = n
            break
    return _ranked(ivf_knn_join(asked, index, 10, probes, where=where))


def knn_sq8_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query through the coded scan with a rerank of the usual budget."""
    from .operators import quantized_top_k

    base = items(spark, sf_dir)
    sq8 = sq8_scale(sq8_statistics(base))
    coded = sq8_table(base, sq8)
    return quantized_top_k(coded, sq8, _query(spark, sf_dir), 10, where=CLASSES["Inclusion"]).select("vec_id", F.round(F.sqrt("d2"), 6).alias("d"))


def knn_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked by 16-bit floats alone."""
    stored = half_table(items(spark, sf_dir, "null_vector"))
    return half_top_k(stored, _query(spark, sf_dir), 10, vector=None, where=CLASSES["Inclusion"]).select("vec_id", F.round(F.sqrt("d2"), 6).alias("d"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router's observations after one measured search of each class."""
    router, base = Router(), items(spark, sf_dir)
    for sel, where in ((0.5, CLASSES["Equality_bool"]), (0.1, CLASSES["Equality_int"]), (0.05, CLASSES["Logic"])):
        knn(base).using(router=router, name="items").estimated(sel).where(where).order_by_l2("embedding", _query(spark, sf_dir)).limit(10).measured()
    return router.feedback.table(spark)


def stream_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set as a stream of requests from files, answered by micro-batches, one predicate per class."""
    asked, to = scratch(spark, "requests"), scratch(spark, "answers")
    requests = _asked(spark, sf_dir).select("qid", "class", F.lit(10).alias("k"), F.col("qvec").cast("array<double>").alias("qvec"))
    requests.repartition(2).write.parquet(asked)
    stream = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).parquet(asked)
    serve(stream, lambda: items(spark, sf_dir), CLASSES, to, scratch(spark, "progress")).awaitTermination()
    return _ranked(spark.read.parquet(to))


_EXTRA: dict[str, Query] = {
    "knn_offset": knn_offset, "knn_wide_join": knn_wide_join, "knn_live_table": knn_live_table, "knn_query_frame": knn_query_frame,
    "knn_join_batch": knn_join_batch, "knn_join_filtered": knn_join_filtered, "knn_join_heldout": knn_join_heldout,
    "knn_join_per_query_pred": knn_join_per_query_pred, "truth_topk": truth_topk, "recall_by_class": recall_by_class_query,
    "predicate_violations": predicate_violations_query, "duplicate_ids": duplicate_ids_query, "col_percentile": col_percentile, "sq8_stats": sq8_stats,
    "capacity_basic": capacity_basic, "snapshot_count": snapshot_count, "snapshot_null_skip": snapshot_null_skip, "knn_snapshot_sq8": knn_snapshot_sq8,
    "knn_csv": knn_csv, "manifest": manifest, "knn_ivf_exhaustive": knn_ivf_exhaustive, "knn_ivf": knn_ivf, "knn_sq8_rerank": knn_sq8_rerank,
    "feedback": feedback, "stream_knn": stream_knn, "knn_ivf_sq8": knn_ivf_sq8, "knn_half": knn_half, "accessors": accessors,
}


def queries() -> dict[str, Query]:
    return {name: partial(_single, name) for name in SINGLE} | _EXTRA


# --- the same in DuckDB's SQL ------------------------------------------------------------------

_D = "list_distance(i.embedding::DOUBLE[], q.qv::DOUBLE[])"


def _knn_sql(variant: str, where: str | None, tail: str = "LIMIT 10", query: int = QUERY_ID, extra: str = "") -> str:
    kept = " AND ".join(f"({x})" for x in ("i.embedding IS NOT NULL", where, extra) if x)
    return (
        f"WITH items AS ({VARIANTS[variant]}) SELECT i.vec_id, round({_D}, 6) AS d FROM items i "
        f"CROSS JOIN (SELECT embedding AS qv FROM embeddings WHERE vec_id = {query}) q WHERE {kept} ORDER BY {_D}, i.vec_id {tail}"
    )


_ASKED = (
    "asked AS (SELECT vec_id AS qid, embedding AS qv, ["
    + ", ".join(f"'{c}'" for c in sorted(CLASSES))
    + "][(CAST(floor(vec_id / 100) AS BIGINT) % 6) + 1] AS class FROM embeddings WHERE vec_id % 100 = 0)"
)
_BY_CLASS = "CASE " + " ".join(f"WHEN q.class = '{c}' THEN {p}" for c, p in CLASSES.items()) + " END"


def _join_sql(where: str = "true", name: str = "found") -> str:
    return (
        f"{name} AS (SELECT q.qid, q.class, i.vec_id, {_D} AS dist, row_number() OVER (PARTITION BY q.qid ORDER BY {_D}, i.vec_id) AS rank "
        f"FROM asked q CROSS JOIN items i WHERE {where})"
    )


def _batch_sql(where: str = "true") -> str:
    return f"WITH items AS ({VARIANTS['plain']}), {_ASKED}, {_join_sql(where)} SELECT qid, CAST(rank AS BIGINT) AS rank, vec_id, round(dist, 6) AS d FROM found WHERE rank <= 10"


#: Codes, their distances, the 64 nearest by codes that match, and the ten nearest of those.
_SQ8 = (
    f"WITH items AS ({VARIANTS['plain']}), e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM items "
    "WHERE embedding IS NOT NULL), s AS (SELECT pos, avg(x) AS mean, max(x) AS most, min(x) AS least FROM e GROUP BY pos), "
    "w AS (SELECT max(greatest(most - mean, mean - least)) AS wide FROM s), z AS (SELECT CASE WHEN wide > 0 THEN wide ELSE 1 END / 127 AS scale FROM w), "
    "c AS (SELECT vec_id, pos, greatest(-127, least(127, round_even((x - mean) / scale, 0))) AS code FROM e JOIN s USING (pos) CROSS JOIN z), "
    f"far AS (SELECT a.vec_id, sum((a.code - b.code) * (a.code - b.code)) AS dq FROM c a JOIN c b ON a.pos = b.pos AND b.vec_id = {QUERY_ID} GROUP BY a.vec_id), "
    f"near AS (SELECT vec_id FROM far JOIN items USING (vec_id) WHERE {CLASSES['Inclusion']} ORDER BY dq, vec_id LIMIT 64) "
    f"SELECT i.vec_id, round({_D}, 6) AS d FROM near JOIN items i USING (vec_id) CROSS JOIN (SELECT embedding AS qv FROM embeddings WHERE vec_id = {QUERY_ID}) q "
    f"ORDER BY {_D}, i.vec_id LIMIT 10"
)


#: Components rounded to eleven bits of precision, in steps of 2^-24 at least.
_HALF = (
    f"WITH items AS ({VARIANTS['null_vector']}), r AS (SELECT * REPLACE (list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0 "
    "ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END) AS embedding) FROM items) "
    f"SELECT i.vec_id, round({_D}, 6) AS d FROM r i CROSS JOIN (SELECT embedding AS qv FROM embeddings WHERE vec_id = {QUERY_ID}) q "
    f"WHERE i.embedding IS NOT NULL AND {CLASSES['Inclusion']} ORDER BY {_D}, i.vec_id LIMIT 10"
)


def oracle_sql() -> dict[str, str]:
    plain = VARIANTS["plain"]
    out = {name: _knn_sql(variant, where) for name, (variant, where) in SINGLE.items()}
    inclusion = CLASSES["Inclusion"]
    out |= {
        "knn_offset": _knn_sql("plain", inclusion, "LIMIT 10 OFFSET 5"),
        "knn_live_table": _knn_sql("plain", inclusion, extra="int_attr <> 1"),
        "knn_query_frame": _knn_sql("plain", "(int_attr % 3) = 0", query=17),
        "knn_snapshot_sq8": _SQ8,
        "knn_sq8_rerank": _SQ8,
        "knn_ivf_sq8": _SQ8,
        "knn_half": _HALF,
        "accessors": (
            f"WITH items AS ({VARIANTS['null_vector']}) SELECT count(*) AS rows, max(len(embedding))::INT AS dim, 3 AS scalars, count(*) AS stored, "
            "max(len(embedding))::INT AS stored_dim FROM items WHERE embedding IS NOT NULL"
        ),
        "knn_csv": _knn_sql("plain", inclusion),
        "knn_wide_join": (
            f"WITH items AS ({plain}) SELECT i.vec_id, round({_D}, 6) AS d, p.p_name FROM items i JOIN part p ON p.p_partkey = i.vec_id "
            f"CROSS JOIN (SELECT embedding AS qv FROM embeddings WHERE vec_id = {QUERY_ID}) q "
            f"WHERE p.p_retailprice < 1500 AND p.p_size IN (1, 2, 3, 5, 8, 13, 21, 34) ORDER BY {_D}, i.vec_id LIMIT 10"
        ),
        "knn_join_batch": _batch_sql(),
        "truth_topk": _batch_sql(),
        "knn_join_filtered": _batch_sql(inclusion),
        "knn_join_heldout": _batch_sql("i.vec_id <> q.qid"),
        "knn_join_per_query_pred": _batch_sql(_BY_CLASS),
        "stream_knn": _batch_sql(_BY_CLASS),
        "knn_ivf_exhaustive": _batch_sql(inclusion),
        "recall_by_class": (
            f"WITH items AS ({plain}), {_ASKED}, {_join_sql(_BY_CLASS, 'gt')}, {_join_sql(name='every')}, "
            f"kept AS (SELECT q.qid, q.vec_id FROM every q JOIN items i USING (vec_id) WHERE q.rank <= 10 AND ({_BY_CLASS})), "
            "one AS (SELECT a.qid, a.class, (SELECT count(*) FROM gt WHERE gt.qid = a.qid AND gt.rank <= 10) AS n, "
            "(SELECT count(*) FROM gt JOIN kept USING (qid, vec_id) WHERE gt.qid = a.qid AND gt.rank <= 10) AS hit, "
            "(SELECT count(*) FROM kept WHERE kept.qid = a.qid) AS found FROM asked a) "
            "SELECT class, count(*) AS queries, round(avg(CASE WHEN n > 0 THEN hit / n WHEN found = 0 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM one GROUP BY class"
        ),
        "predicate_violations": (
            f"WITH items AS ({plain}), {_ASKED}, {_join_sql()} SELECT count(*) AS violations FROM found JOIN items USING (vec_id) "
            f"WHERE rank <= 10 AND ({CLASSES['Logic']}) IS NOT TRUE"
        ),
        "duplicate_ids": f"WITH items AS ({plain}), {_ASKED}, {_join_sql()} SELECT CAST(count(*) - count(DISTINCT (qid, vec_id)) AS BIGINT) AS duplicates FROM found WHERE rank <= 10",
        "col_percentile": (
            f"WITH items AS ({VARIANTS['null_scalar']}), v AS (SELECT float_attr AS x, row_number() OVER (ORDER BY float_attr) - 1 AS place, count(*) OVER () AS n "
            "FROM items WHERE float_attr IS NOT NULL), f AS (SELECT unnest([0.0, 0.1, 0.5, 0.9, 1.0]::DOUBLE[]) AS fraction) "
            "SELECT fraction, x AS value FROM f JOIN v ON place = CAST(floor(fraction * (n - 1)) AS BIGINT)"
        ),
        "sq8_stats": (
            f"WITH items AS ({VARIANTS['null_vector']}), e AS (SELECT unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos FROM items "
            "WHERE embedding IS NOT NULL), s AS (SELECT pos, avg(x) AS mean, min(x) AS least, max(x) AS most FROM e GROUP BY pos) "
            "SELECT pos, round(mean, 6) AS mean, round(least, 6) AS least, round(most, 6) AS most, "
            "round((SELECT max(greatest(most - mean, mean - least)) FROM s) / 127, 8) AS scale FROM s"
        ),
        "capacity_basic": (
            f"WITH items AS ({VARIANTS['null_vector']}), s AS (SELECT count(embedding) AS n, count(*) - count(embedding) AS nulls, max(len(embedding)) AS dim FROM items), "
            "t AS (SELECT n, nulls, dim, n * (4 * dim + 20 * 3 + 9 + 33 * 4 + 11) AS size, n * (3 * (((dim + 15) // 16) * 16) + 4 + 12 * 3 + 33 * 4) AS coded FROM s) "
            "SELECT unnest(['rows', 'null_vectors', 'dim', 'scalar_columns', 'index_bytes', 'coded_bytes', 'disk_bytes', 'visited_bytes']) AS metric, "
            "unnest([n, nulls, dim, 3, size, coded, 2 * size, 4 * n]::BIGINT[]::VARCHAR[]) AS value FROM t"
        ),
        "snapshot_count": "SELECT count(*) AS stored, count(DISTINCT vec_id) AS ids, count(*) AS built FROM embeddings WHERE embedding IS NOT NULL",
        "snapshot_null_skip": f"WITH items AS ({VARIANTS['null_vector']}) SELECT vec_id, bool_attr, int_attr, float_attr FROM items WHERE embedding IS NOT NULL",
        "manifest": (
            f"WITH items AS ({VARIANTS['null_vector']}) SELECT unnest(['vec_id', 'embedding', 'bool_attr', 'int_attr', 'float_attr']) AS \"column\", count(*) AS rows, "
            "unnest([0, count(*) - count(embedding), 0, 0, 0]) AS nulls, unnest([NULL, max(len(embedding)), NULL, NULL, NULL]::INT[]) AS dim FROM items"
        ),
    }
    return out
