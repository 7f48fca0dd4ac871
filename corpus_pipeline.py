"""Corpus pipeline over `documents`: toxicity, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.decontaminate import contaminated_words
from nearfield.llm.jaccard import jaccard_components, with_set_keys
from nearfield.llm.line_dedup import remove_boilerplate_lines
from nearfield.llm.packing import pack
from nearfield.llm.queries import vocabulary
from nearfield.llm.shared import dropped, stage_path, staged
from nearfield.llm.simhash import simhash_groups
from nearfield.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the field finds toxic go; it is fitted on the labels of folds 1 to 4.

    Each row is judged by its own text: rows with a null id too, and rows that repeat an id alike
    only if their texts are.
    """
    field = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs.select(F.col("doc_id").alias("id"), *COLUMNS[1:]), field, id_col="id", carried=("id", *COLUMNS[1:]))
    return scored.where("score < 0.5").select(F.col("id").alias("doc_id"), *COLUMNS[1:])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go, except where each is first; n_chars follows the text.

    Every row stays, with a null text if it had one.
    """
    kept = remove_boilerplate_lines(docs.withColumn("had_text", F.col("text").isNotNull()), carried=("lang", "source", "n_chars", "had_text"))
    changed = F.col("n_removed") > 0
    return kept.select(
        "doc_id", F.when(F.col("had_text"), F.col("kept_text")).alias("text"), "lang", "source",
        F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest id, any id before null.

    Near-duplicates have a Jaccard similarity of 0.8 or more over their sets of five-word shingles.
    The operator's fingerprints of five-word shingles give the first candidates; each is verified on
    the sets. Pairs of 0.8 differ in more bits than a join of 64-bit fingerprints can bear, so a
    prefix-filtered join of the sets adds the links that fingerprints leave out. A group is all that
    links reach. Texts without a word, null ones too, are one group. Repeated rows are
    near-duplicates of each other.
    """
    keyed = staged(with_set_keys(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id())), "keyed")
    near = simhash_groups(keyed, id_col="set_key", shingle=5)
    linked = jaccard_components(keyed, candidates=near.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    own = keyed.select("row", "doc_id", "set_key").join(linked.withColumnRenamed("node", "set_key"), "set_key", "left")
    own = staged(own.select("row", "doc_id", F.coalesce("component", "set_key").alias("component")), "grouped")
    first = own.groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.row").alias("kept"))
    gone = staged(own.join(first, "component").where("row != kept").select("row"), "duplicates")
    dropped(own)
    return keyed.join(gone, "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a 10-word window of a benchmark item go, each judged by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated_words(docs.select(F.col("doc_id").alias("id"), *COLUMNS[1:]), benchmark, id_col="id", carried=("id", *COLUMNS[1:]))
    return found.where("n_hit = 0").select(F.col("id").alias("doc_id"), *COLUMNS[1:])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences of at most 2048 tokens; a null text is empty."""
    return pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express a fitted field, a tokenizer or column generation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = stage_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
