"""The search engine against DuckDB, and its invariants."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import queries as core
from nearfield.functions import l2, percentile_index, recall, sq8_distance, sq8_encode
from nearfield.operators import (
    audit, build_ivf, calibrate, column_percentile, confirm, half_table, half_top_k, ivf_knn_join, ivf_top_k, knn_join, knn_join_by_class, quantized_top_k, recall_by_class, sq8_statistics,
)
from nearfield.operators import batch
from nearfield.operators.ivf import _sample, with_parts
from nearfield.operators.quantized import sq8_scale, sq8_table
from nearfield.plans import Router, Settings, knn
from nearfield.plans.router import Run, Shape, bucket
from nearfield.sources import build_snapshot, capacity, items, open_snapshot, read_vector_csv, write_vector_csv
from nearfield.streaming import REQUEST_SCHEMA, answer_batch, serve

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    return sorted(tuple("null" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = core.queries()[name](spark, SF)
    want = duck.sql(core.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert canon(got) == canon(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_registered_without_sql_run(spark):
    for name in set(core.queries()) - set(core.oracle_sql()):
        assert core.queries()[name](spark, SF).count() > 0


def small(spark, rows, schema="vec_id bigint, embedding array<float>, x int"):
    return spark.createDataFrame(rows, schema)


def test_null_vectors_and_ties(spark):
    base = small(spark, [(3, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (4, [0.0, 0.0], None)])
    rows = knn(base).order_by_l2("embedding", [0.0, 0.0]).limit(10).result().collect()
    assert [r["vec_id"] for r in rows] == [4, 1, 3]
    rows = knn(base).where("x = 1").order_by_l2("embedding", [0.0, 0.0]).limit(1).offset(1).result().collect()
    assert [r["vec_id"] for r in rows] == [3]
    assert knn(base.where("false")).order_by_l2("embedding", [0.0, 0.0]).limit(1).result().count() == 0


def test_refused_queries(spark):
    base = small(spark, [(1, [1.0, 0.0], 1)])
    for bad in (None, [], [1.0, None], [math.nan, 1.0], [math.inf, 0.0]):
        with pytest.raises(ValueError):
            knn(base).order_by_l2("embedding", bad)
    with pytest.raises(ValueError):
        knn(base).order_by_l2("x", [1.0])
    with pytest.raises(ValueError):
        knn(base).order_by_l2("embedding", [1.0, 1.0], descending=True)
    with pytest.raises(ValueError):
        knn(base).order_by_l2("embedding", [1.0, 1.0]).order_by_l2("embedding", [1.0, 1.0])
    with pytest.raises(ValueError):
        knn(base).order_by_l2("embedding", [1.0, 1.0]).limit(0)
    with pytest.raises(ValueError):
        knn(base).limit(1).result()
    with pytest.raises(Exception, match="different vector dimensions"):
        knn(base).order_by_l2("embedding", [1.0, 2.0, 3.0]).limit(1).result().collect()
    with pytest.raises(Exception, match="different vector dimensions"):
        knn_join(spark.createDataFrame([(1, [1.0])], "qid bigint, qvec array<double>"), base, 1).collect()


def test_long_and_column_distances_agree(spark):
    rng = np.random.default_rng(0)
    v, q = rng.standard_normal(300), rng.standard_normal(300)
    df = spark.createDataFrame([(v.tolist(), q.tolist())], "v array<double>, q array<double>")
    a, b = df.select(l2(F.col("v"), q.tolist()), l2(F.col("v"), F.col("q"))).first()
    assert a == pytest.approx(np.linalg.norm(v - q)) and a == b


def test_top_k_stays_in_the_scan_stage(spark):
    info = knn(items(spark, SF)).where("int_attr IN (0, 1, 1)").order_by_l2("embedding", core._query(spark, SF)).limit(10).explain_info()
    assert info["strategy"] == "exact" and info["top_k_in_scan_stage"]
    assert any("label" in x for x in info["pushed_filters"])


def brute(base, q, k):
    rows = [(sum((a - b) ** 2 for a, b in zip(v, q, strict=True)), i) for i, v in base if v is not None]
    return [i for _, i in sorted(rows)[:k]]


def test_join_blocks_and_exclusion(spark):
    rng = np.random.default_rng(1)
    base = [(i, rng.standard_normal(4).tolist()) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(base, "vec_id bigint, embedding array<double>").repartition(5)
    asked = spark.createDataFrame(base[:30], "qid bigint, qvec array<double>")
    got = {}
    for r in knn_join(asked, df, 5, block=7).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for q, v in base[:30]:
        assert [i for _, i in sorted(got[q])] == brute(base, v, 5)
    alone = {(r["qid"], r["id"]) for r in knn_join(asked, df, 5, exclude_self=True).collect()}
    assert not any(a == b for a, b in alone) and len(alone) == 150
    assert knn_join(asked.where("false"), df, 5).count() == 0
    with pytest.raises(ValueError):
        knn_join_by_class(asked.withColumn("class", F.lit("none")), df, 5, {"some": "true"})


def test_recall_definition(spark):
    rows = [([1, 2], [1, 3]), ([], []), ([], [1]), ([1], [])]
    df = spark.createDataFrame(rows, "gt array<int>, ids array<int>")
    assert [r[0] for r in df.select(recall(F.col("gt"), F.col("ids"))).collect()] == [0.5, 1.0, 0.0, 0.0]
    assert [percentile_index(10, p) for p in (0.0, 0.5, 0.95, 0.99, 1.0)] == [0, 5, 9, 9, 9]


def test_percentile_positions(spark):
    df = spark.createDataFrame([(float(i),) for i in range(12)] + [(None,), (3.0,)], "x double")
    value = lambda f: column_percentile(df, "x", f).first()[0]
    ordered = sorted([*map(float, range(12)), 3.0])
    assert [value(f) for f in (0, 0.5, 0.9, 1)] == [ordered[int(f * 12)] for f in (0, 0.5, 0.9, 1)]
    assert column_percentile(df.where("x IS NULL"), "x", 0.5).first()[0] == 0.0
    with pytest.raises(ValueError):
        column_percentile(df, "x", 1.5)


def held_out(spark, n=60):
    """Perturbed rows, none of them indexed."""
    rng = np.random.default_rng(5)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(n).collect()
    out = []
    for i, r in enumerate(rows):
        noise = rng.standard_normal(len(r["embedding"]))
        v = np.array(r["embedding"]) + 0.8 * noise / np.linalg.norm(noise)
        out.append((i, (v / np.linalg.norm(v)).tolist(), sorted(core.CLASSES)[i % 6]))
    return spark.createDataFrame(out, "qid bigint, qvec array<double>, class string")


def test_ivf_invariants(spark):
    base, asked = items(spark, SF), held_out(spark)
    index = build_ivf(base)
    index = type(index)(index.table.cache(), index.centroids)
    gt = knn_join(asked, base, 10).cache()
    seen = []
    for probes in (2, index.lists // 2, index.lists):
        found = ivf_knn_join(asked, index, 10, probes).cache()
        rows = [(r["qid"], r["id"]) for r in found.collect()]
        assert len(rows) == len(set(rows))
        seen.append(recall_by_class(gt, found, asked).agg(F.min("recall")).first()[0])
    assert seen == sorted(seen) and seen[-1] == 1.0
    where = core.CLASSES["Logic"]
    q = asked.first()["qvec"]
    rows, read = ivf_top_k(index, q, 10, 1, where)
    rows = rows.collect()
    assert len(rows) == 10 and read > 1 and all(r["int_attr"] == 0 and 0 <= r["float_attr"] < 50 for r in rows)
    rows, read = ivf_top_k(index, q, 10, 1, "int_attr = 99")
    assert rows.count() == 0 and read == index.lists


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_registered_ivf_reaches_its_recall(spark, sf):
    want = {(r["qid"], r["vec_id"]) for r in core.queries()["knn_ivf_exhaustive"](spark, sf).collect()}
    got = {(r["qid"], r["vec_id"]) for r in core.queries()["knn_ivf"](spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_short_ivf_results_widen(spark):
    index = build_ivf(items(spark, SF))
    asked = held_out(spark, 12)
    rows = ivf_knn_join(asked, index, 10, 1, where=core.CLASSES["Logic"]).groupBy("qid").count().collect()
    assert len(rows) == 12 and {r["count"] for r in rows} == {10}
    assert ivf_knn_join(asked, index, 10, 1, where="int_attr = 99").count() == 0


def probed_brute(index, base, q, k, n):
    """Row by row over the n nearest lists, doubled while they hold fewer than k rows; infinite distances, then NaN, then null ids last."""
    while True:
        lists = set(index.probes(q, n))
        rows = [r for r in base if r["list_id"] in lists]
        if len(rows) >= k or n == index.lists:
            break
        n = min(index.lists, 2 * n)
    far = []
    for r in rows:
        d = 0.0
        for a, b in zip(r["embedding"], q, strict=True):
            d += (a - b) * (a - b)
        far.append((math.isnan(d), d if d == d else 0.0, r["vec_id"] is None, r["vec_id"] or 0))
    return [(i + 1, None if null else id, None if nan else d) for i, (nan, d, null, id) in enumerate(sorted(far)[:k])]


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
@pytest.mark.parametrize("stored", [False, True])
def test_ivf_join_ranks_what_its_lists_hold_and_pairs_no_rows(spark, tmp_path, stored, share, monkeypatch):
    """Copies, null ids, infinite and NaN components and numbers whose squares are out of range, with blocks of seven queries."""
    monkeypatch.setattr(batch, "QUERIES", 5)
    monkeypatch.setattr("nearfield.operators.ivf.BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    base = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    base += [(1000 + i, base[i][1]) for i in range(0, 300, 9)] + [(None, base[0][1]), (None, base[7][1])]
    base += [(2000, [math.inf] + [0.0] * 5), (2001, [math.nan] + [0.0] * 5), (2002, [1e200] * 6), (2003, [-1e200] * 6)]
    df = spark.createDataFrame(base, "vec_id bigint, embedding array<double>").repartition(5)
    index = build_ivf(df.where("vec_id < 2000 OR vec_id IS NULL"), lists=12)
    everything = build_ivf(df, lists=1)
    for index, n in ((index, max(1, round(12 * share))), (everything, 1)):
        if stored:
            at = f"{tmp_path}/{index.lists}"
            with_parts(index.table, index.lists).write.partitionBy("list_part").parquet(at)
            index = type(index)(spark.read.parquet(at), index.centroids)
        rows = index.table.collect()
        for some, k in ((base[:30] + [(5000, [1e200] * 6)], 4), (base[40:43], 400)):
            asked = spark.createDataFrame([(i, v) for i, v in some], "qid bigint, qvec array<double>")
            found = ivf_knn_join(asked, index, k, n)
            assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
            got = {}
            for r in found.orderBy("qid", "rank").collect():
                got.setdefault(r["qid"], []).append((r["rank"], r["id"], None if math.isnan(r["d2"]) else r["d2"]))
            assert got == {i: probed_brute(index, rows, v, k, n) for i, v in some}


def test_ivf_sample_is_of_the_smallest_hashes(spark):
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    want = [r[0] for r in df.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id").limit(100).collect()]
    assert _sample(df, "embedding", "vec_id", 5000, 100)[:, 0].tolist() == want
    same = df.withColumn("vec_id", F.lit(3).cast("bigint"))
    assert len(_sample(same, "embedding", "vec_id", 5000, 100)) == 100
    assert len(_sample(df, "embedding", "vec_id", 5000, 9000)) == 5000


def test_calibration_freezes_an_eligible_knob(spark):
    base, asked = items(spark, SF), held_out(spark, 24)
    index = build_ivf(base)
    index = type(index)(index.table.cache(), index.centroids)
    gt = knn_join(asked, base, 10).cache()
    found = calibrate(lambda n: ivf_knn_join(asked, index, 10, n), (1, index.lists), gt, asked)
    assert [x["eligible"] for x in found] == [False, True] and found[1]["chosen"]
    unseen = held_out(spark, 48).where("qid >= 24")
    right = knn_join(unseen, base, 10)
    assert confirm(lambda: ivf_knn_join(unseen, index, 10, index.lists), right, unseen)["confirmed"]
    assert not confirm(lambda: ivf_knn_join(unseen, index, 10, 1), right, unseen)["confirmed"]
    assert not confirm(lambda: right, right, unseen.limit(0))["confirmed"]


def test_sq8(spark):
    base = items(spark, SF)
    sq8 = sq8_scale(sq8_statistics(base))
    x = np.array([r["embedding"] for r in base.orderBy("vec_id").collect()], np.float64)
    mean = x.mean(0)
    scale = max((x.max(0) - mean).max(), (mean - x.min(0)).max()) / 127
    assert np.allclose(sq8.mean, mean) and sq8.scale == pytest.approx(scale)
    codes = np.clip(np.rint((x - np.array(sq8.mean)) / sq8.scale), -127, 127).astype(int)
    coded = sq8_table(base, sq8).cache()
    got = coded.orderBy("vec_id").collect()
    assert [r["codes"] for r in got] == codes.tolist() and [r["norm"] for r in got] == (codes**2).sum(1).tolist()
    q = codes[7].tolist()
    d = [r[0] for r in coded.orderBy("vec_id").select(sq8_distance(F.col("codes"), q)).collect()]
    assert d == ((codes - codes[7]) ** 2).sum(1).tolist()
    hits = total = 0
    for r in held_out(spark, 12).collect():
        exact = {x["vec_id"] for x in knn(base).where(core.CLASSES[r["class"]]).order_by_l2("embedding", r["qvec"]).limit(10).result().collect()}
        near = [x["vec_id"] for x in quantized_top_k(coded, sq8, r["qvec"], 10, where=core.CLASSES[r["class"]]).collect()]
        assert len(near) == len(set(near)) == len(exact)
        hits, total = hits + len(exact & set(near)), total + len(exact)
    assert hits / total >= 0.95
    flat = sq8_scale(sq8_statistics(small(spark, [(1, [2.0], 1)])))
    assert flat.scale == pytest.approx(1 / 127)
    assert spark.createDataFrame([([0.5],)], "v array<double>").select(sq8_encode(F.col("v"), [0.0], 1.0)).first()[0] == [0]


def test_halves(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(7).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, [1e-7, -6e-8, 3e-5, 65519.0, 1e30, -1e30, 0.0]), (301, rows[4][1]), (302, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    stored = half_table(df).cache()
    x = np.array([v for _, v in rows[:-1]], np.float32)
    halves = np.clip(x, -65504, 65504).astype(np.float16)
    got = {r[0]: r[1] for r in stored.select("vec_id", "halves").collect()}
    assert got.pop(302) is None and [bytes(got[i]) for i in range(302)] == [h.tobytes() for h in halves]
    q = rows[4][1]
    d = ((halves.astype(np.float64) - np.array(q)) ** 2).sum(1)
    order = sorted(range(302), key=lambda i: (d[i], i))
    near = half_top_k(stored, q, 9, vector=None, where="vec_id <> 4").collect()
    assert [r["vec_id"] for r in near] == [i for i in order if i != 4][:9] and [r["d2"] for r in near] == [d[i] for i in order if i != 4][:9]
    exact = [r["vec_id"] for r in knn(df).order_by_l2("embedding", q).limit(9).result().collect()]
    assert [r["vec_id"] for r in half_top_k(stored, q, 9).collect()] == exact and exact[:2] == [4, 301]
    assert half_top_k(stored.where("vec_id = 302"), q, 9).count() == half_top_k(stored.limit(0), q, 9).count() == 0
    assert "TakeOrderedAndProject" in half_top_k(stored, q, 9)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="different vector dimensions"):
        half_top_k(stored, q[:5], 9).collect()


def test_settings_and_session(spark):
    for bad in ({"ef_search": 9}, {"batch_max": 0}, {"force_strategy": "hnsw"}, {"precision": "fp8"}, {"train_rows": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    spark.conf.set("nearfield.ef_search", "200")
    try:
        assert Settings.of(spark).ef_search == 200 and Settings.of(spark).with_(ef_search=50).ef_search == 50
    finally:
        spark.conf.unset("nearfield.ef_search")


def test_router_prices_and_corrections():
    assert [bucket(s) for s in (1.0, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.0001)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
    every, small, large = ("exact", "sq8", "ivf", "ivf_sq8"), Shape(1000, 64, 10), Shape(1e10, 64, 10, 0.5, 1, 10**5, 10**4)
    r = Router()
    assert r.choose("t", every, small) == "exact" and r.choose("t", every, large) == "ivf_sq8"
    assert Router(Settings(precision="full")).choose("t", every, large) == "ivf"
    assert Router(Settings(enable=False)).choose("t", every, large) == "exact"
    assert Router(Settings(force_strategy="sq8")).choose("t", ("exact",), small) == "exact"
    assert r.price("t", "exact", large, 4) == pytest.approx(4 * r.price("t", "exact", large))
    f = r.feedback
    f.record("t", "sq8", "exact", Run(0.5, 10, 10, 1))
    assert not f.seen
    before = r.price("t", "exact", small)
    for _ in range(60):
        f.record("t", "exact", "exact", Run(1.0, 100, 800, 1))
    assert 5 * before < r.price("t", "exact", small) < 8 * before
    near, far = (f.correction("t", "exact", s) for s in (0.9, 0.001))
    assert near > far > 1 and f.correction("u", "exact", 1.0) == 1


def test_auto_routing_uses_the_snapshots_own_figures(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    build_snapshot(items(spark, SF).withColumn("note", F.lit("text")), root)
    snap = open_snapshot(spark, root)
    search = snap.knn().where("int_attr = 0").order_by_l2("embedding", core._query(spark, SF)).limit(5)
    info = search.explain_info()
    share = snap.table.where("int_attr = 0").count() / snap.rows
    assert info["rows"] == snap.rows and abs(info["selectivity"] - share) < 0.01 and set(info["prices_ms"]) == {"exact", "sq8", "ivf", "ivf_sq8"}
    assert search.result().first()["note"] == "text" and search.counters() == {"rows": snap.rows, "matches": round(share * snap.rows), "live_skips": 0}
    assert knn(items(spark, SF)).order_by_l2("embedding", core._query(spark, SF)).limit(5).strategy("ivf_sq8").explain_info()["fallback"]
    plan = snap.ivf.probed(core._query(spark, SF), 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_part" in plan.replace("PartitionFilters: [isnotnull(list_part", "PartitionFilters: [list_part") and "list_id" in plan.split("PushedFilters:")[1]
    rows, _ = search.strategy("auto").measured()
    assert len(rows) == 5 and sum(len(v) for v in search.router.feedback.seen.values()) == 1


def test_snapshot_versions(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    with pytest.raises(FileNotFoundError):
        open_snapshot(spark, root)
    base = items(spark, SF, "null_vector")
    assert build_snapshot(base, root, cluster_by="float_attr") == base.where("embedding IS NOT NULL").count()
    old = open_snapshot(spark, root)
    assert old.dim == 64 and old.scalars == ["bool_attr", "int_attr", "float_attr"] and old.accessors()["lists"] == old.ivf.lists
    n = build_snapshot(base.limit(100).union(base.where("vec_id = 200")), root)
    assert open_snapshot(spark, root).rows == n and old.table.count() == old.rows
    q = core._query(spark, SF)
    exact = [r["vec_id"] for r in knn(base).where("int_attr < 3").order_by_l2("embedding", q).limit(5).result().collect()]
    search = old.knn().where("int_attr < 3").order_by_l2("embedding", q).limit(5)
    for strategy, probes in (("exact", None), ("sq8", None), ("ivf", old.ivf.lists), ("ivf_sq8", None)):
        rows = search.strategy(strategy, probes).result().collect()
        assert [r["vec_id"] for r in rows] == exact and all(r["int_attr"] < 3 for r in rows)
    meta = next(tmp_path.glob(f"snap/{old.version}/meta.json"))
    meta.write_text(json.dumps(json.loads(meta.read_text()) | {"format": 0}))
    for crc in meta.parent.glob(".meta.json*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="format"):
        open_snapshot(spark, root, old.version)
    current = open_snapshot(spark, root).version
    for bad in (base.where("embedding IS NULL"), base.drop("embedding"), small(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)])):
        with pytest.raises(ValueError):
            build_snapshot(bad, root)
    assert open_snapshot(spark, root).version == current


def test_capacity_flags(spark):
    rows = {r["metric"]: r for r in capacity(small(spark, [], "vec_id bigint, embedding array<float>")).collect()}
    assert rows["rows"]["ok"] == "no" and rows["dim"]["ok"] == "no"
    wide = spark.createDataFrame([(1, [0.0] * 2001)], "vec_id bigint, embedding array<float>")
    assert {r["metric"]: r["ok"] for r in capacity(wide).collect()}["dim"] == "no"


def test_csv_round_trip(spark, tmp_path):
    base = items(spark, SF, "null_vector")
    write_vector_csv(base, f"file://{tmp_path}/csv")
    back = read_vector_csv(spark, f"file://{tmp_path}/csv", base.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, base.collect()))
    (tmp_path / "bad.csv").write_text('vec_id,embedding\n1,"[1,x]"\n')
    with pytest.raises(Exception):
        read_vector_csv(spark, f"file://{tmp_path}/bad.csv", "vec_id bigint, embedding array<float>").collect()


def test_streamed_requests_equal_the_batch(spark, tmp_path):
    asked = core._asked(spark, SF).select("qid", "class", F.lit(3).alias("k"), F.col("qvec").cast("array<double>").alias("qvec"))
    bad = spark.createDataFrame([(900, "Logic", 3, None), (901, "Logic", 3, [1.0]), (902, "Logic", 0, [0.0] * 64), (903, "none", 3, [0.0] * 64)], REQUEST_SCHEMA)
    rows = asked.union(bad)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(REQUEST_SCHEMA).parquet(f"{tmp_path}/in")
    base = items(spark, SF)
    query = serve(stream, lambda: base, core.CLASSES, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("qid", "rank", "id", "error")
    want = answer_batch(rows, base, core.CLASSES).select("qid", "rank", "id", "error")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    errors = {r["qid"]: r["error"] for r in want.where("error IS NOT NULL").collect()}
    assert errors == {900: "null query vector", 901: "different vector dimensions", 902: "k is at least 1", 903: "unknown class"}


def test_audit_finds_what_is_wrong():
    def event(r, **x):
        return {"workload": "w", "round": r, "queries": 10, "seconds": 1.0 + r, "errors": 0, "ids": {1: [1, 2]}, "recall": 0.95} | x

    good = [event(r) for r in range(3)]
    summary = {"w": {"qps": 5.0, "recall": 0.95}}
    assert audit(good, summary) == []
    assert audit(good, {"w": {"qps": 9.0, "recall": 0.95}})
    assert audit(good, {"w": {"qps": 5.0, "recall": 0.99}})
    assert audit(good[:2], summary)
    assert audit([*good[:2], event(2, errors=1)], summary)
    assert audit([*good[:2], event(2, ids={1: [1, 1]})], summary)
    assert audit([*good[:2], event(2, seconds=9.0)], summary) == []


def test_percentile_narrows_many_values(spark, monkeypatch):
    from nearfield.operators import percentile

    monkeypatch.setattr(percentile, "FEW", 5)
    monkeypatch.setattr(percentile, "CUTS", 4)
    rng = np.random.default_rng(3)
    x = [*rng.normal(0, 100, 300).round(1).tolist(), *[7.0] * 200, float("inf"), float("-inf"), float("nan"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(5)
    order = [*sorted(v for v in x[:-1] if v == v), float("nan"), float("nan")]
    for f in (0.0, 0.1, 0.5, 0.77, 0.99, 1.0):
        assert repr(column_percentile(df, "x", f).first()[0]) == repr(order[int(f * (len(order) - 1))])
