"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowstream.llm.common import documents
from rowstream.llm.decontam import contamination
from rowstream.llm.langid import identify_documents
from rowstream.llm.mixing import mix_sources
from rowstream.llm.neardup import near_duplicates
from rowstream.llm.order_minhash import fingerprint_documents
from rowstream.llm.passages import repeated_passages
from rowstream.llm.pii import pseudonymise, session_key
from rowstream.llm.quality import fit, rating, score
from rowstream.llm.tokens import count_tokens
from rowstream.llm.urlfilter import judge_urls

#: The rules that op6 applies: host, path, verdict.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


#: Documents are selected by the chance of the highest grade.
LEAST_TAIL = 0.5


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, rating(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score(docs, model).select("doc_id", "expected_grade", "tail_prob")
    return scored.withColumn("selected", F.col("tail_prob") >= LEAST_TAIL)


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), rule="start")


def op3_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(documents(spark, sf_dir))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4, percent=80)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("host", "path", "verdict")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule, strict=True)]) for rule in URL_RULES])
    rules = spark.range(1).select(F.inline(rows))
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("text_hash")


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark), counts=True)


def op9_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_token_attribution": op2_token_attribution,
    "op3_language_filters": op3_language_filters,
    "op4_order_minhash": op4_order_minhash,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_url_rules": op6_url_rules,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_chained_passages": op9_chained_passages,
    "op10_qgram_decontamination": op10_qgram_decontamination,
}

_OP6_SQL = """
WITH u AS (
  SELECT page_id,
    translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                      ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT u.page_id, coalesce(u.host, '') AS host, coalesce(u.path, '') AS path,
  (SELECT max_by(h || p, length(h || p)) FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS rule,
  coalesce((SELECT max_by(v, length(h || p)) FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)), 'allow') AS verdict
FROM u
"""

_OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i+3], ' '))) AS g
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r(a, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON l.a = r.c),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY 1),
k AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(gs)) AS class_id
  FROM (SELECT doc_id, list(g) AS gs FROM s GROUP BY doc_id))
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept, coalesce(k.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op5_near_duplicates": _OP5_SQL,
    "op6_url_rules": _OP6_SQL,
}
