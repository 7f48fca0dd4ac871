"""The registered queries of this subpackage: thin uses of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated_words
from .embedding_dedup import near_duplicate_vectors
from .html_text import extract_pages
from .line_dedup import remove_boilerplate_lines
from .packing import pack
from .simhash import simhash_groups
from .substring_dedup import remove_repeated_substrings
from .token_counts import token_counts
from .toxicity import fit_toxicity, fold, score_toxicity
from .url_filter import judge_urls, site_rule

#: The URL rules of op8.
URL_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents; a token over a line's end goes where it starts."""
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary(), rule="start")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines of 20 characters or more that six sites or more share."""
    kept = remove_boilerplate_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    packed = pack(_table(spark, sf_dir, "documents"), vocabulary(), length=2048, end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of folds 1 to 4."""
    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans")
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    text = extract_pages(_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words of 20-word windows that start earlier as well."""
    kept = remove_repeated_substrings(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; what no rule fits is allowed."""
    return judge_urls(_table(spark, sf_dir, "pages"), [site_rule(*r) for r in URL_RULES])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents over 4-word shingles, linked at 4 or fewer differing bits."""
    groups = simhash_groups(_table(spark, sf_dir, "documents"), shingle=4, errors=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in 10-word windows of benchmark items."""
    found = contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts, op2_line_dedup, op3_packing, op4_toxicity, op5_html_text,
        op6_substring_dedup, op7_embedding_dedup, op8_url_filter, op9_simhash, op10_decontamination,
    )
    return {f.__name__: f for f in every}


_OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, i - 1 AS line_no, parts[i] AS line, trim(parts[i], E' \t\r') AS norm
  FROM (SELECT doc_id, source, string_split(text, E'\n') AS parts, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS i
        FROM documents WHERE length(text) > 0)
), marked AS (
  SELECT norm, min((doc_id, line_no)) AS first FROM lines WHERE length(norm) >= 20
  GROUP BY norm HAVING count(DISTINCT site) >= 6
), judged AS (
  SELECT l.doc_id, l.line_no, l.line, m.norm IS NOT NULL AND (l.doc_id, l.line_no) <> m.first AS gone
  FROM lines l LEFT JOIN marked m ON l.norm = m.norm
)
SELECT d.doc_id, count(j.line_no) AS n_lines, coalesce(sum(j.gone::BIGINT), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(j.line, E'\n' ORDER BY j.line_no) FILTER (NOT j.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""

_OP8_SQL = """
WITH rules(host, path, text, verdict) AS (VALUES
  ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'allow'),
  ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')
), cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split
), fits AS (
  SELECT u.page_id, arg_max(r.text, length(r.text)) AS rule, arg_max(r.verdict, length(r.text)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f USING (page_id)
"""


_OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (
  SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM words
), marked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM windows WHERE len(win) = 20
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM marked WHERE again),
judged AS (SELECT a.doc_id, a.word, a.p, g.p IS NOT NULL AS gone FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p)
SELECT d.doc_id, count(j.p) AS n_words, coalesce(sum(j.gone::BIGINT), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.p) FILTER (NOT j.gone), '')) AS kept_sha256
FROM d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""

# a table of at most two windows of vectors is compared whole; the fixtures' are
_OP7_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(k.least, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(k.least, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN counts c ON c.a = v.vec_id LEFT JOIN components k ON k.a = v.vec_id
"""

_OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), items AS (
  SELECT DISTINCT item, w[s : s + least(10, len(w)) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
ahead AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS win FROM words),
sizes AS (SELECT DISTINCT len(win) AS m FROM items),
starts AS (SELECT a.doc_id, a.p, s.m, a.win[1 : s.m] AS win FROM ahead a JOIN sizes s ON len(a.win) >= s.m),
found AS (SELECT t.doc_id, t.p, t.m, i.item FROM starts t JOIN items i ON t.win = i.win),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) FROM found) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(met.n, 0) AS n_items, sha256(coalesce(met.items, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": _OP2_SQL, "op6_substring_dedup": _OP6_SQL, "op7_embedding_dedup": _OP7_SQL, "op8_url_filter": _OP8_SQL,
        "op10_decontamination": _OP10_SQL,
    }
