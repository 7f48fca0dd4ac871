"""Evaluation: exact truth, recall, invariants, calibration, throughput, audit."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recall import percentile_index, recall
from .batch import knn_join


def truth(queries: DataFrame, base: DataFrame, k: int = 10, **options) -> DataFrame:
    """Exact (qid, rank, id, d2): no index, order (distance, id)."""
    return knn_join(queries, base, k, **options)


def recall_by_class(truth: DataFrame, found: DataFrame, queries: DataFrame, class_col: str = "class") -> DataFrame:
    """(class, queries, recall): mean recall of each class of queries; both sides hold (qid, id)."""
    lists = lambda df, name: df.groupBy("qid").agg(F.collect_set("id").alias(name))  # noqa: E731  k ids a query
    empty = F.array().cast("array<bigint>")
    rows = queries.select("qid", class_col).join(lists(truth, "gt"), "qid", "left").join(lists(found, "ids"), "qid", "left")
    one = recall(F.coalesce("gt", empty), F.coalesce("ids", empty))
    return rows.groupBy(class_col).agg(F.count("*").alias("queries"), F.avg(one).alias("recall"))


def predicate_violations(found: DataFrame, base: DataFrame, where: str, id: str = "vec_id") -> DataFrame:
    """One row, `violations`: results whose base row doesn't satisfy the predicate."""
    bad = base.where(f"({where}) IS NOT TRUE").select(F.col(id).alias("id"))
    return found.join(bad, "id", "left_semi").agg(F.count("*").alias("violations"))


def duplicate_ids(found: DataFrame) -> DataFrame:
    """One row, `duplicates`: results beyond the first of one query and id."""
    return found.groupBy("qid", "id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def calibrate(run: Callable[[int], DataFrame], knobs: Iterable[int], truth: DataFrame, queries: DataFrame, floor: float = 0.9, class_col: str = "class") -> list[dict]:
    """Runs each knob and measures it; `eligible` where every class reaches the recall floor, and
    `chosen` on the fastest of those."""
    out = []
    for knob in knobs:
        began = time.perf_counter()
        found = run(knob)
        rows = [(r["qid"], r["id"]) for r in found.select("qid", "id").collect()]  # k rows a query
        seconds = time.perf_counter() - began
        back = queries.sparkSession.createDataFrame(rows, "qid bigint, id bigint")
        by_class = {r[class_col]: r["recall"] for r in recall_by_class(truth, back, queries, class_col).collect()}
        out.append({"knob": knob, "seconds": seconds, "recall": by_class, "eligible": min(by_class.values(), default=0.0) >= floor, "chosen": False})
    good = [x for x in out if x["eligible"]]
    if good:
        min(good, key=lambda x: x["seconds"])["chosen"] = True
    return out


def confirm(run: Callable[[], DataFrame], truth: DataFrame, queries: DataFrame, floor: float = 0.9, class_col: str = "class") -> dict:
    """Holds a calibrated knob, now frozen, to queries it wasn't chosen on: recall by class, and
    whether every class reaches the floor. No query confirms nothing."""
    by_class = {r[class_col]: r["recall"] for r in recall_by_class(truth, run(), queries, class_col).collect()}
    return {"recall": by_class, "confirmed": min(by_class.values(), default=0.0) >= floor}


def throughput(run: Callable[[], DataFrame], queries: int, rounds: int = 3, warm: int = 1) -> dict:
    """Queries a second over whole batches (no-op sink): median of rounds, and times by percentile."""
    times = []
    for i in range(warm + rounds):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if i >= warm:
            times.append(time.perf_counter() - began)
    times.sort()
    return {"queries": queries, "rounds": rounds, "qps": queries / median(times), **{f"p{int(p * 100)}_s": times[percentile_index(len(times), p)] for p in (0.5, 0.95, 0.99)}}


def audit(events: list[dict], summary: dict, rounds: int = 3, tolerance: float = 1e-9) -> list[str]:
    """What is wrong with a measured summary: missing rounds, errors, duplicates, or numbers that
    don't follow from the events. events: {workload, round, queries, seconds, errors, ids: {qid: [id]}, recall}."""
    wrong = []
    by = {}
    for e in events:
        by.setdefault(e["workload"], []).append(e)
    for name, row in summary.items():
        own = by.get(name, [])
        if sorted(e["round"] for e in own) != list(range(rounds)):
            wrong.append(f"{name}: rounds are missing or repeated")
            continue
        if any(e["errors"] for e in own):
            wrong.append(f"{name}: queries failed")
        if any(len(set(ids)) != len(ids) for e in own for ids in e["ids"].values()):
            wrong.append(f"{name}: a result holds an id twice")
        if abs(median(e["queries"] / e["seconds"] for e in own) - row["qps"]) > tolerance * row["qps"]:
            wrong.append(f"{name}: its rate isn't the median of its rounds")
        if any(abs(e["recall"] - row["recall"]) > 1e-9 for e in own):
            wrong.append(f"{name}: its recall differs from its rounds'")
    return wrong
