"""Queries that judge documents by models learned from them, and urls by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_text, read
from .language import fit_languages, identify_language
from .quality import fit_quality, score_quality
from .url_filter import judge_urls


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules and by its aliases."""
    rows = judge_urls(read(spark, sf_dir, "pages"))
    return rows.select("page_id", *(F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs, held_out = read(spark, sf_dir, "documents"), crc_text("doc_id") % 5 == 0
    model = fit_quality(docs, read(spark, sf_dir, "labels"), ~held_out)
    rows = score_quality(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs, held_out = read(spark, sf_dir, "documents"), F.coalesce(crc_text("doc_id") % 4 == 2, F.lit(False))
    rows = identify_language(docs.select("doc_id", "text"), fit_languages(docs, ~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_cosine").alias("score"))


QUERIES = {"op2_url_filter": op2_url_filter, "op4_quality": op4_quality, "op7_language_id": op7_language_id}

_ATTRIBUTE = r"""trim(trim(regexp_extract(t, '(?is)\b{0}\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), '"'''))"""
_HOST = "translate(regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
_RULE = """CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END"""
_VERDICT = "CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END"
_A = {n: _ATTRIBUTE.replace("{0}", n) for n in ("rel", "href", "http-equiv", "property", "content")}
OP2_SQL = rf"""
WITH RECURSIVE tags AS (
  SELECT url AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM pages WHERE url LIKE '%://%'
), links AS (
  SELECT a, replace(b, '&amp;', '&') AS b FROM (
    SELECT a, CASE WHEN list_contains(regexp_split_to_array(lower({_A["rel"]}), '\s+'), 'canonical') THEN {_A["href"]}
      WHEN lower({_A["http-equiv"]}) = 'refresh' THEN trim(regexp_extract({_A["content"]}, '(?i)url\s*=\s*[''"]?([^''"]+)', 1))
      WHEN lower({_A["property"]}) = 'og:url' THEN {_A["content"]} END AS b FROM tags
  ) WHERE b LIKE '%://%'
), urls AS (
  SELECT url, url AS node, {_RULE} AS rule FROM (
    SELECT url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path
    FROM (SELECT url FROM pages WHERE url LIKE '%://%' UNION SELECT a FROM links UNION SELECT b FROM links))
), edges AS (
  SELECT DISTINCT x.node AS a, y.node AS b FROM links l JOIN urls x ON x.url = l.a JOIN urls y ON y.url = l.b
), reach(a, b) AS (
  SELECT DISTINCT node, node FROM urls
  UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON r.b = e.a
), said AS (
  SELECT r.a AS node, min({_VERDICT}) AS verdict FROM reach r JOIN urls u ON u.node = r.b GROUP BY r.a
), p AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN {_HOST.format("url")} ELSE '' END AS host, CASE WHEN url LIKE '%://%' THEN {_PATH.format("url")} ELSE '' END AS path FROM pages
), j AS (SELECT *, {_RULE} AS rule FROM p)
SELECT page_id, host, path, rule, coalesce({_VERDICT}, said.verdict, 'allow') AS verdict
FROM j LEFT JOIN (SELECT DISTINCT url, node FROM urls) u ON u.url = j.url LEFT JOIN said ON said.node = u.node
"""
ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL}
