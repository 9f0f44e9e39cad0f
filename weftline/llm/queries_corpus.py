"""Queries over ``documents``: packing, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir
from .jaccard_join import jaccard_classes
from .mixing import mix_sources
from .packing import pack_documents
from .substring_dedup import remove_repeats
from .token_files import read_token_files, write_token_files


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    packed = pack_documents(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages."""
    rows = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the classes that near-copies link."""
    rows = jaccard_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_size").alias("n_shingles"), F.col("_component").alias("component_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    rows = mix_sources(read(spark, sf_dir, "documents"), columns=["doc_id"])
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back from them."""
    folder = shared_dir(spark)
    write_token_files(read(spark, sf_dir, "documents"), folder).agg(F.sum("ids"), F.sum("docs")).collect()
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s
), l AS (
  SELECT *, cap / w AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce(w * (max(CASE WHEN level <= ratio THEN level END) OVER ()), cap)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)) * 32 + ((d.size << 5) >> (length(bin(d.size)) - 1)), d.h % 256, d.size, d.h, d.doc_id) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, ('0x' || substr(md5('0:0|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r
)
SELECT doc_id, size, source_size, target, least((floor(pos * rate + u) - floor((pos - 1) * rate + u))::BIGINT, 2) * size AS taken FROM u
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s AS start, list_slice(w, s, s + 19) AS g FROM d, unnest(range(1, greatest(len(w) - 18, 1))) t(s)
), dup AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY g ORDER BY doc_id, start) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM dup, unnest(range(start, start + 20)) t(p)
), kept AS (
  SELECT d.doc_id, len(w) AS n_words, t.p, w[t.p] AS word
  FROM d LEFT JOIN unnest(range(1, len(w) + 1)) t(p) ON true
)
SELECT k.doc_id, any_value(n_words)::BIGINT AS n_words, count(g.p)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY k.p), '')) AS kept_sha256
FROM kept k LEFT JOIN gone g ON k.doc_id = g.doc_id AND k.p = g.p
GROUP BY k.doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, s, s + 4) END, ' ')) AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(s) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY a
"""

QUERIES = {"op1_packing": op1_packing, "op5_jaccard_join": op5_jaccard_join, "op3_substring_dedup": op3_substring_dedup, "op6_mixing": op6_mixing, "op10_token_files": op10_token_files}
ORACLES = {"op5_jaccard_join": OP5_SQL, "op3_substring_dedup": OP3_SQL, "op6_mixing": OP6_SQL}
