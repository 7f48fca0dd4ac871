"""Search requests as a stream: each micro-batch is grouped by plan and answered as a batch join.

What concurrent clients gain from being served together, a micro-batch gains from one pass over the
base for all its requests of a class. A batch is answered from one snapshot version, and its
answers are written under its number, so a repeated batch replaces its own answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.batch import knn_join
from ..plans.settings import Settings

REQUEST_SCHEMA = "qid bigint, class string, k int, qvec array<double>"


def answer_batch(requests: DataFrame, base: DataFrame, predicates: dict[str, str], settings: Settings | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, rank, id, d2, error) of one batch of requests; a bad request gets a row with its error.

    Requests are distinct by qid. Groups are (class, k), each one pass over the base per
    batch_max requests.
    """
    settings = settings or Settings()
    dim = base.where(F.col(vector).isNotNull()).select(F.size(vector)).limit(1).collect()
    dim = dim[0][0] if dim else 0
    known = F.col("class").isin(list(predicates))
    error = (
        F.when(F.col("qvec").isNull() | F.exists("qvec", lambda x: x.isNull()), "null query vector")
        .when(F.lit(dim > 0) & (F.size("qvec") != dim), "different vector dimensions")
        .when(F.col("k").isNull() | (F.col("k") < 1), "k is at least 1")
        .when(~F.coalesce(known, F.lit(False)), "unknown class")
    )
    marked = requests.withColumn("error", error)
    bad = marked.where("error IS NOT NULL").select("qid", F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("d2"), "error")
    good = marked.where("error IS NULL")
    out = bad
    for name, k in sorted((r["class"], r["k"]) for r in good.select("class", "k").distinct().collect()):
        group = good.where((F.col("class") == name) & (F.col("k") == k))
        part = knn_join(group, base, k, id=id, vector=vector, where=predicates[name], block=settings.batch_max)
        out = out.unionByName(part.withColumn("error", F.lit(None).cast("string")))
    return out


def serve(requests: DataFrame, snapshot: Callable[[], DataFrame], predicates: dict[str, str], to: str, checkpoint: str, settings: Settings | None = None, **trigger) -> StreamingQuery:
    """Answers a stream of requests into Parquet under `to`/batch=N; trigger as in writeStream.trigger.

    snapshot: gives the base for each batch, so a new version is picked up between batches.
    """

    def each(batch: DataFrame, number: int) -> None:
        base = snapshot()
        held = batch.persist()
        try:
            answer_batch(held, base, predicates, settings).write.mode("overwrite").parquet(f"{to}/batch={number}")
        finally:
            held.unpersist()

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
