"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations alone.

Lines seen on one site only are set aside by a minimum and maximum of the site's hash. For the
others a HyperLogLog sketch of sites is built per line hash; partial sketches merge in the
aggregation. Where the estimate is near the threshold, sites are counted exactly. So the decision
is exact as long as a sketch is off by less than the guard band, several standard errors wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, staged


def boilerplate_lines(lines: DataFrame, sites: int, lg_k: int = 12, guard: float = 0.1) -> DataFrame:
    """(hash, first, n_sites) of line hashes seen on at least `sites` distinct sites.

    lines: doc_id, line_no, hash, site (all but line_no bigint). first is the line's first place as
    a struct of doc_id and line_no, a null id before any other. n_sites is exact near the threshold and estimated elsewhere.
    """
    several = staged(
        lines.groupBy("hash").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a != b").select("hash"), "several-sites"
    )
    sketches = staged(
        lines.join(several, "hash", "left_semi")
        .groupBy("hash")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("n_sites"), F.min(F.struct("doc_id", "line_no")).alias("first")),
        "site-sketches",
    )
    low, high = sites * (1 - guard) - 1, sites * (1 + guard) + 1
    near = sketches.where(F.col("n_sites").between(low, high)).select("hash")
    exact = lines.join(near, "hash", "left_semi").groupBy("hash").agg(F.countDistinct("site").alias("exact"))
    found = (
        sketches.where(F.col("n_sites") >= low)
        .join(exact, "hash", "left")
        .select("hash", "first", F.coalesce("exact", "n_sites").alias("n_sites"))
        .where(F.col("n_sites") >= sites)
    )
    out = staged(found, "boilerplate")
    dropped(several, sketches)
    return out


def remove_boilerplate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    sites: int = 6,
    least_chars: int = 20,
    lg_k: int = 12,
    guard: float = 0.1,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text, and carried columns of docs): lines that many sites share are removed.

    Lines are cut at \\n and compared without spaces, tabs and \\r at their ends. A line of at least
    `least_chars` characters on at least `sites` distinct sites stays only where it is first
    (smallest doc_id, then line), so no text leaves the corpus whole.

    A null text has no lines and keeps an empty text; a null site is the site of empty name; rows
    with a null id come first and count as one document. Rows that repeat an id are judged by their
    own lines; rows equal in id, text and site get equal results. An empty table gives an empty one.
    """
    own = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{site_col}`").cast("string").alias("site"),
        *(F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carried)),
    )
    own = own.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("site", F.lit(""))).alias("seq"),
        F.xxhash64(F.coalesce("site", F.lit(""))).alias("site"),
        F.when(F.length("text") > 0, F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>")).alias("lines"),
        *(f"carried_{i}" for i in range(len(carried))),
    )
    line = F.btrim("line", F.lit(" \t\r"))
    lines = staged(
        own.select("doc_id", "seq", "site", F.posexplode("lines").alias("line_no", "line"))
        .where(F.length(line) >= least_chars)
        .select("doc_id", "seq", "site", "line_no", F.xxhash64(line).alias("hash")),
        "lines",
    )
    shared = boilerplate_lines(lines, sites, lg_k, guard)
    gone = staged(
        lines.join(shared.select("hash", "first"), "hash")
        .where(~F.col("first.doc_id").eqNullSafe(F.col("doc_id")) | (F.col("first.line_no") != F.col("line_no")))
        .groupBy("doc_id", "seq")
        .agg(F.collect_set("line_no").alias("gone")),
        "gone-lines",
    )
    dropped(lines, shared)
    every = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(every, "gone"), lambda i: F.element_at("lines", i + 1))
    # texts are dealt by document at every size; a broadcast of `gone` would grow with the corpus
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("seq").alias("gone_seq"), "gone").hint("merge")
    return own.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("seq") == F.col("gone_seq")), "left").select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("kept_text"),
        *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carried)),
    )
