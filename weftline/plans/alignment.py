"""Queries over blocks, columns and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as W
from .. import sources as S
from ..operators import blocks as B
from ..operators import columns as C
from ..operators import intervals as I
from ..operators import mappings as M
from ..sources import shared_folder
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with SQL for the same rows."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _texts(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", F.array_join(F.transform("components", lambda c: c["text"]), "|").alias("text"))


def _full(spark: SparkSession, d: str) -> DataFrame:
    return X.blocks(spark, d).where(F.size("components") == 3)


@query(f"WITH {X.ITEMS_SQL} SELECT l_orderkey, l_linenumber, chrom, greatest(0, start - 150) AS start, \"end\" + 70 AS \"end\" FROM items")
def bed_extend(spark: SparkSession, d: str) -> DataFrame:
    return I.extend(X.item_intervals(spark, d), 150, 70)


_CHROMS = "SELECT 'chr' || s_suppkey AS chrom, CASE WHEN s_nationkey % 2 = 0 THEN 'hg17' ELSE 'mm5' END AS build, floor(abs(s_acctbal) * 1000)::BIGINT AS size FROM supplier"


@query(f"WITH c AS ({_CHROMS}) SELECT chrom, k * 250000 AS start, least((k + 1) * 250000, size) AS \"end\" FROM c, unnest(range(0, (size + 249999) // 250000)) t(k) WHERE build = 'hg17'")
def genome_windows(spark: SparkSession, d: str) -> DataFrame:
    build = F.when(F.col("s_nationkey") % 2 == 0, "hg17").otherwise("mm5")
    chroms = X.table(spark, d, "supplier").select(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string")).alias("chrom"), build.alias("build"), F.floor(F.abs("s_acctbal") * 1000).alias("size"))
    return I.genome_windows(chroms, "hg17", 250_000)


@query(f"WITH {X.BLOCKS_SQL} SELECT block_id, string_agg(translate(text, '#=X@', '-***'), '|' ORDER BY ci) AS text FROM comp GROUP BY block_id")
def translate_chars(spark: SparkSession, d: str) -> DataFrame:
    return _texts(B.translate_chars(X.blocks(spark, d)))


@query(f"""WITH {X.BLOCKS_SQL} SELECT block_id, split_part(src, '.', 2) AS chrom, CASE WHEN strand = '-' THEN src_size - start - size ELSE start END AS start,
  CASE WHEN strand = '-' THEN src_size - start ELSE start + size END AS "end" FROM comp WHERE ci = 0""")
def print_intervals(spark: SparkSession, d: str) -> DataFrame:
    return B.block_intervals(X.blocks(spark, d))


@query(f"WITH {X.BLOCKS_SQL} SELECT block_id, string_agg(src, ',' ORDER BY ci) AS sources FROM comp WHERE sp IN ('panTro1', 'mm5') GROUP BY block_id HAVING count(*) > 1")
def limit_to_species(spark: SparkSession, d: str) -> DataFrame:
    kept = B.limit_to_species(X.blocks(spark, d), ["panTro1", "mm5"])
    return kept.select("block_id", F.array_join(F.transform("components", lambda c: c["src"]), ",").alias("sources"))


@query(f"WITH {X.BLOCKS_SQL} SELECT block_id FROM cols WHERE length(col) - length(replace(col, '*', '')) <= 0 GROUP BY block_id HAVING count(*) >= 27")
def filter_max_wc(spark: SparkSession, d: str) -> DataFrame:
    return B.filter_max_wildcards(X.blocks(spark, d), 27, 0).select("block_id")


@query(f"""WITH {X.BLOCKS_SQL}, r AS (SELECT block_id, sp, length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) / 32.0 >= 0.75 AS ok FROM comp)
SELECT block_id FROM r GROUP BY block_id HAVING bool_or(ok AND sp IN ('hg17', 'panTro1')) AND bool_or(ok AND sp = 'mm5')""")
def filter_missing_data(spark: SparkSession, d: str) -> DataFrame:
    return B.filter_missing_data(X.blocks(spark, d), [["hg17", "panTro1"], ["mm5"]], min_length=32, min_real=0.75).select("block_id")


_REQUIRED = f"""WITH {X.BLOCKS_SQL}, r AS (
  SELECT o.block_id, s.i AS ci, coalesce(c.src, 'mm5.fake') AS src, coalesce(c.start, 0) AS start, coalesce(c.strand, '?') AS strand, coalesce(c.text, repeat('*', 32)) AS text
  FROM (SELECT DISTINCT block_id FROM comp) o CROSS JOIN (VALUES (0), (1), (2)) s(i) LEFT JOIN comp c ON c.block_id = o.block_id AND c.ci = s.i
), keep AS (
  SELECT block_id, x.i FROM r, range(1, 33) x(i) GROUP BY block_id, x.i HAVING bool_or(substr(text, x.i, 1) NOT IN ('-', '#', '*', '=', 'X', '@'))
), cut AS (
  SELECT r.block_id, ci, any_value(src) AS src, any_value(start) AS start, any_value(strand) AS strand, string_agg(substr(text, keep.i, 1), '' ORDER BY keep.i) AS text
  FROM r JOIN keep ON r.block_id = keep.block_id GROUP BY r.block_id, ci
)"""


@query(_REQUIRED + """, p AS (
  SELECT a.block_id, a.src AS s0, a.strand AS d0, a.start AS b0, a.text AS t0, b.src AS s1, b.strand AS d1, b.start AS b1, b.text AS t1, c.src AS s2, c.strand AS d2, c.start AS b2, c.text AS t2
  FROM cut a JOIN cut b ON a.block_id = b.block_id AND b.ci = 1 JOIN cut c ON a.block_id = c.block_id AND c.ci = 2 WHERE a.ci = 0
), l AS (
  SELECT *, CASE WHEN lag(s0) OVER w = s0 AND lag(d0) OVER w = d0 AND lag(b0) OVER w + 32 = b0 AND lag(s1) OVER w = s1 AND lag(d1) OVER w = d1 AND lag(b1) OVER w + 32 = b1
    AND lag(s2) OVER w = s2 AND (s2 LIKE '%.fake' OR (lag(d2) OVER w = d2 AND lag(b2) OVER w + 32 = b2)) THEN 0 ELSE 1 END AS new
  FROM p WINDOW w AS (ORDER BY block_id)
), g AS (SELECT *, sum(new) OVER (ORDER BY block_id) AS run FROM l)
SELECT min(block_id) AS block_id, count(*)::INTEGER AS n_blocks, string_agg(t0, '' ORDER BY block_id) || '|' || string_agg(t1, '' ORDER BY block_id) || '|' || string_agg(t2, '' ORDER BY block_id) AS text
FROM g GROUP BY run""")
def require_species_fuse(spark: SparkSession, d: str) -> DataFrame:
    fused = B.fuse_adjacent(B.require_species(X.blocks(spark, d), ["hg17", "panTro1", "mm5*"]))
    return fused.select("block_id", "n_blocks", F.array_join(F.transform("components", lambda c: c["text"]), "|").alias("text"))


@query(f"""WITH {X.BLOCKS_SQL}, {X.MASKS_SQL}, ch AS (
  SELECT block_id, x.i, substr(text, x.i, 1) AS c, split_part(src, '.', 2) AS chrom, strand, start,
    count(*) FILTER (WHERE substr(text, x.i, 1) <> '-') OVER (PARTITION BY block_id ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM comp, range(1, 33) x(i) WHERE ci = 0
), st AS (
  SELECT ch.*, CASE WHEN c = '-' THEN NULL ELSE (EXISTS (SELECT 1 FROM masks m WHERE m.chrom = ch.chrom
    AND m.start <= CASE WHEN strand = '-' THEN 20000000 - 1 - (ch.start + before) ELSE ch.start + before END
    AND m."end" > CASE WHEN strand = '-' THEN 20000000 - 1 - (ch.start + before) ELSE ch.start + before END))::INTEGER END AS s
  FROM ch
), mk AS (
  SELECT block_id, i, coalesce(s, first_value(s IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    last_value(s IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS m FROM st
), t AS (
  SELECT c.block_id, ci, string_agg(CASE WHEN m = 1 THEN 'X' ELSE substr(text, mk.i, 1) END, '' ORDER BY mk.i) AS text FROM comp c JOIN mk ON c.block_id = mk.block_id GROUP BY c.block_id, ci
)
SELECT block_id, string_agg(text, '|' ORDER BY ci) AS text FROM t GROUP BY block_id""")
def mask_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _texts(B.mask_blocks(X.blocks(spark, d), X.masks(spark, d)))


_SS_SQL = f"""WITH {X.BLOCKS_SQL}, ss AS (
  SELECT string_agg(coalesce(substr(c.text, x.i, 1), '*'), '' ORDER BY s.i) AS key
  FROM (SELECT DISTINCT block_id FROM comp) o CROSS JOIN (VALUES (0), (1), (2)) s(i) CROSS JOIN range(1, 33) x(i)
  LEFT JOIN comp c ON c.block_id = o.block_id AND c.ci = s.i GROUP BY o.block_id, x.i
), n AS (SELECT key, count(*) AS count FROM ss GROUP BY key)"""


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return C.sufficient_statistics(X.blocks(spark, d), X.SPECIES)


@query(_SS_SQL + " SELECT (row_number() OVER (ORDER BY key) - 1)::INTEGER AS i, key, count FROM n")
def sufficient_stats(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d).select("i", "key", "count")


@query(_SS_SQL + f""", m AS (SELECT key, (count % 25)::VARCHAR AS symbol FROM n WHERE count % 3 <> 0)
SELECT block_id, string_agg(coalesce(symbol, '-1'), ' ' ORDER BY cols.i) AS symbols FROM cols LEFT JOIN m ON m.key = cols.col GROUP BY block_id""")
def columns_to_ints(spark: SparkSession, d: str) -> DataFrame:
    mapping = _statistics(spark, d).where("count % 3 <> 0").select("key", (F.col("count") % 25).cast("string").alias("symbol"))
    return B.to_symbols(X.blocks(spark, d), mapping)


@query(f"""WITH {X.BLOCKS_SQL}, a(c, n) AS (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3), ('-', 4), ('*', 5)), space AS (
  SELECT x.c || y.c || z.c AS key, (x.n * 36 + y.n * 6 + z.n)::BIGINT AS key_ord FROM a x, a y, a z
), n AS (SELECT col, count(*) AS count FROM cols WHERE length(col) = 3 GROUP BY col)
SELECT key, key_ord, coalesce(count, 0) AS count FROM space LEFT JOIN n ON col = key WHERE key <> '---' AND length(key) - length(replace(key, '*', '')) <= 1""")
def col_counts_dense(spark: SparkSession, d: str) -> DataFrame:
    return C.dense_column_counts(_full(spark, d), 3, wildcards=1)


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(upper(text), 'CG')) / length(text)::DOUBLE, 9) END AS density FROM documents")
def cpg_density(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", F.round(W.density(F.col("text"), "CG"), 9).alias("density"))


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(upper(text), '[CG]')) / length(text)::DOUBLE, 9) END AS density FROM documents")
def gc_density(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", F.round(W.density(F.col("text"), "[CG]"), 9).alias("density"))


@query("""WITH s AS (SELECT doc_id AS row_idx, upper(substr(text, 138, least(length(text), 137 + length(text) // 2) - 137)) AS seq FROM documents WHERE length(text) > 137)
SELECT row_idx, round(len(regexp_extract_all(seq, '[CG]')) / length(seq)::DOUBLE, 9) AS density FROM s WHERE length(seq) > 0""")
def interval_gc_density(spark: SparkSession, d: str) -> DataFrame:
    docs, tile = X.table(spark, d, "documents"), 1000
    n = F.length("text")
    tiles = docs.where(n > 0).select(F.concat(F.lit("doc"), "doc_id").alias("chrom"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / tile))).alias("tile_no"))
    tiles = tiles.select("chrom", "tile_no", F.substring("text", (F.col("tile_no") * tile + 1).cast("int"), F.lit(tile)).alias("seq"))
    asks = docs.where(n > 137).select(F.col("doc_id").alias("row_idx"), F.concat(F.lit("doc"), "doc_id").alias("chrom"), F.lit(137).cast("long").alias("start"), F.least(n, F.lit(137) + F.floor(n / 2)).cast("long").alias("end"))
    return I.fetch_sequences(asks, tiles, tile).where("seq is not null").select("row_idx", F.round(W.density(F.col("seq"), "[CG]"), 9).alias("density"))


@query(f"WITH {X.BLOCKS_SQL} SELECT block_id, round(len(regexp_extract_all(upper(text), 'CG')) / 32.0::DOUBLE, 9) AS density FROM comp WHERE ci = 0")
def block_cpg_density(spark: SparkSession, d: str) -> DataFrame:
    return B.block_cpg_density(X.blocks(spark, d)).select("block_id", F.round("density", 9).alias("density"))


@query("SELECT o_orderkey AS block_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def get_by_class(spark: SparkSession, d: str) -> DataFrame:
    classes = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), F.col("o_orderpriority").alias("label"))
    return B.by_class(X.blocks(spark, d), classes, "1-URGENT", key="block_id").select("block_id")


@query("SELECT p_partkey::VARCHAR AS key, (p_size % 7)::VARCHAR AS symbol FROM part")
def compose_mapping(spark: SparkSession, d: str) -> DataFrame:
    part = X.table(spark, d, "part")
    first = part.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("string").alias("symbol"))
    second = part.select(F.col("p_size").cast("string").alias("key"), (F.col("p_size") % 7).cast("string").alias("symbol")).distinct()
    return M.compose(first, second)


@query(_SS_SQL + """, m AS (SELECT key, (count % 10)::VARCHAR AS symbol, length(key) - length(replace(key, '*', '')) AS wild FROM n WHERE replace(key, '*', '-') IN (SELECT key FROM n))
SELECT a.key, CASE WHEN a.wild > 1 THEN '-1' WHEN a.wild > 0 THEN b.symbol ELSE a.symbol END AS symbol FROM m a LEFT JOIN m b ON b.key = replace(a.key, '*', '-')""")
def convert_missing(spark: SparkSession, d: str) -> DataFrame:
    counts = _statistics(spark, d)
    there = counts.select(F.col("key").alias("_k"))
    mapping = counts.join(there, F.replace("key", F.lit("*"), F.lit("-")) == F.col("_k"), "left_semi").select("key", (F.col("count") % 10).cast("string").alias("symbol"))
    return M.convert_missing(mapping, 1, replace=True)


@query("SELECT s_name AS key, (s_nationkey % 5)::VARCHAR AS symbol FROM supplier")
def mapping_from_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = X.table(spark, d, "supplier").select((F.col("s_suppkey")).alias("k"), F.col("s_name").alias("key"), (F.col("s_nationkey") % 5).alias("c"))
    rows = B.dense_order(s, "k").withColumn("row_idx", F.col("_place") - 1)
    return M.from_assignments(rows.select("row_idx", "key"), rows.select("row_idx", F.col("c").alias("symbol")))


@query("WITH r AS (SELECT max(p_size) + 1 AS n FROM part) SELECT i AS row, (i % n) || ' ' || (i // n % n) || ' ' || (i // (n * n)) AS word FROM r, unnest(range(0, (n * n * n)::BIGINT)) t(i)")
def ordered_words(spark: SparkSession, d: str) -> DataFrame:
    radix = X.table(spark, d, "part").agg(F.max("p_size") + 1).first()[0]
    return M.ordered_words(spark, radix)


@query(_SS_SQL + " SELECT (count % 12)::VARCHAR AS symbol, string_agg(key, ' ' ORDER BY key) AS keys FROM n GROUP BY 1")
def symbol_members(spark: SparkSession, d: str) -> DataFrame:
    return M.symbol_members(_statistics(spark, d).select("key", (F.col("count") % 12).cast("string").alias("symbol")))


_MERGE = """{name} AS (
  SELECT {keys}chrom, min(start) AS start, max("end") AS "end" FROM (
    SELECT *, sum(new) OVER (PARTITION BY {keys}chrom ORDER BY start, "end") AS run FROM (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {keys}chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
      FROM {source} WHERE start < "end")) GROUP BY {keys}chrom, run
)"""


@query(f"WITH {X.ITEMS_SQL}, {_MERGE.format(name='merged', keys='', source='items')} SELECT chrom, start, \"end\" FROM merged")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_overlaps(X.item_intervals(spark, d)).select("chrom", "start", "end")


@query(f"""WITH {X.INTERVALS_SQL}, {X.PARTS_SQL}, {_MERGE.format(name='merged', keys='ord, ', source='parts')}, hit AS (
  SELECT iv.row_idx, m.ord, sum(least(iv."end", m."end") - greatest(iv.start, m.start)) AS bases FROM iv JOIN merged m ON iv.chrom = m.chrom AND iv.start < m."end" AND m.start < iv."end" GROUP BY ALL
), best AS (SELECT row_idx, min(ord) AS ord, arg_min(bases, ord) AS bases FROM hit GROUP BY row_idx)
SELECT iv.*, CASE WHEN ord IS NULL THEN 'OTHER' ELSE 'part' || ord END AS name, CASE WHEN ord IS NULL THEN '-1' ELSE (ord * 10)::VARCHAR END AS score,
  printf('%.4f', CASE WHEN ord IS NULL THEN 1.0::DOUBLE ELSE bases::DOUBLE / (iv."end" - iv.start) END) AS frac_overlap FROM iv LEFT JOIN best USING (row_idx)""")
def partition_overlap(spark: SparkSession, d: str) -> DataFrame:
    return I.first_partition(X.intervals(spark, d), X.partitions(spark, d))


@query(f"""WITH {X.BLOCKS_SQL}, asks AS (
  SELECT c_custkey AS row_idx, 'chr' || (c_custkey % 22 + 1) AS chrom, c_custkey * 311 % 480000 AS start, c_custkey * 311 % 480000 + 256 AS "end" FROM customer
), hit AS (
  SELECT a.row_idx, c.start, c.text, lag(c.start + 32) OVER (PARTITION BY a.row_idx ORDER BY c.start) AS last
  FROM asks a JOIN comp c ON c.ci = 0 AND c.strand = '+' AND split_part(c.src, '.', 2) = a.chrom AND a.start < c.start + 32 AND c.start < a."end"
), t AS (
  SELECT row_idx, count(*)::INTEGER AS n_blocks, string_agg(CASE WHEN last IS NULL OR last = start THEN '' ELSE '----------' END || text, '' ORDER BY start) AS text FROM hit GROUP BY row_idx
)
SELECT a.row_idx, coalesce(n_blocks, 0) AS n_blocks, text FROM asks a LEFT JOIN t USING (row_idx)""")
def fuse_for_intervals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    asks = X.table(spark, d, "customer").select(k.alias("row_idx"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chrom"), (k * 311 % 480_000).alias("start"), (k * 311 % 480_000 + 256).alias("end"))
    c = F.get("components", F.lit(0))
    pieces = X.blocks(spark, d).where(c["strand"] == "+").select(W.chrom_of(c["src"]).alias("chrom"), c["start"].alias("start"), (c["start"] + c["size"]).alias("end"), c["text"].alias("text"))
    return I.fuse_for_intervals(asks, pieces)


@query(f"""WITH {X.BLOCKS_SQL}, asks AS (
  SELECT c_custkey AS row_idx, 'hg17.chr' || (c_custkey % 22 + 1) AS chrom, c_custkey * 311 % 480000 AS start, c_custkey * 311 % 480000 + 96 AS "end" FROM customer
), three AS (
  SELECT block_id, any_value(src) FILTER (WHERE ci = 0) AS src, any_value(start) AS start, string_agg(strand, '' ORDER BY ci) AS strands, list(text ORDER BY ci) AS texts FROM comp GROUP BY block_id HAVING count(*) = 3
), hit AS (
  SELECT a.row_idx, t.*, CASE WHEN lag(t.start + 32) OVER w = t.start AND lag(strands) OVER w = strands THEN 0 ELSE 1 END AS new
  FROM asks a JOIN three t ON t.src = a.chrom AND a.start < t.start + 32 AND t.start < a."end" WINDOW w AS (PARTITION BY a.row_idx ORDER BY t.start)
), runs AS (
  SELECT row_idx, run, min(start) AS start, any_value(strands) AS strands, any_value(src) AS src, string_agg(texts[1], '' ORDER BY start) AS t0, string_agg(texts[2], '' ORDER BY start) AS t1, string_agg(texts[3], '' ORDER BY start) AS t2, count(*) AS n
  FROM (SELECT *, sum(new) OVER (PARTITION BY row_idx ORDER BY start) AS run FROM hit) GROUP BY row_idx, run
), one AS (
  SELECT row_idx, count(*) AS runs, any_value(src) AS src, any_value(start) AS start, any_value(strands) AS strands, sum(n) AS n,
    string_agg(t0, '----------' ORDER BY start) AS t0, string_agg(t1, '----------' ORDER BY start) AS t1, string_agg(t2, '----------' ORDER BY start) AS t2 FROM runs GROUP BY row_idx
), c AS (
  SELECT a.row_idx, s.i, CASE WHEN runs = 1 THEN replace(src, 'hg17', s.sp) ELSE s.sp || '.fake' END AS src, CASE WHEN runs = 1 THEN one.start ELSE 0 END AS start, runs, n,
    CASE WHEN runs = 1 THEN substr(strands, s.i + 1, 1) ELSE '?' END AS strand, coalesce(CASE s.i WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END, '') AS text
  FROM asks a CROSS JOIN (VALUES (0, 'hg17'), (1, 'panTro1'), (2, 'mm5')) s(i, sp) LEFT JOIN one USING (row_idx)
)
SELECT row_idx, src, start, CASE WHEN runs = 1 THEN (32 * n)::BIGINT ELSE length(replace(text, '-', '')) END AS size, strand, text FROM c""")
def blocks_for_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all species, on either strand, for each interval; made up ones where there are none."""
    k = F.col("c_custkey")
    asks = X.table(spark, d, "customer").select(k.alias("row_idx"), F.concat(F.lit("hg17.chr"), (k % 22 + 1).cast("string")).alias("chrom"), (k * 311 % 480_000).alias("start"), (k * 311 % 480_000 + 96).alias("end"))
    return I.blocks_for_intervals(asks, _full(spark, d), X.SPECIES).select("row_idx", F.inline("components")).drop("src_size")


@query(f"""WITH {X.BLOCKS_SQL}, {X.INTERVALS_SQL} SELECT split_part(src, '.', 2) AS chrom, CASE WHEN strand = '-' THEN src_size - start - size ELSE start END AS start,
  CASE WHEN strand = '-' THEN src_size - start ELSE start + size END AS "end" FROM comp WHERE ci = 0 UNION ALL SELECT chrom, start, "end" FROM iv""")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return B.block_intervals(X.blocks(spark, d)).drop("block_id").unionByName(X.intervals(spark, d).drop("row_idx"))


@query(f"WITH {X.BLOCKS_SQL} SELECT src, start, size, strand, src_size, text FROM comp")
def maf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    S.write_maf(X.blocks(spark, d), folder)
    return S.read_maf(spark, folder).select(F.inline("components"))


@query(f"WITH {X.BLOCKS_SQL} SELECT split_part(src, '.', 2) AS chrom, src, start, text FROM comp WHERE ci = 0")
def maf_split_by_src(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    S.write_maf(X.blocks(spark, d), folder, by_source=True)
    c = F.get("components", F.lit(0))
    back = S.read_maf(spark, f"{folder}/*")
    return back.select(W.chrom_of(c["src"]).alias("chrom"), c["src"].alias("src"), c["start"].alias("start"), c["text"].alias("text"))


@query(f"WITH {X.INTERVALS_SQL} SELECT chrom, start, \"end\", 'o' || row_idx AS label, '+' AS strand FROM iv")
def interval_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    S.write_lines(X.intervals(spark, d).withColumn("label", F.concat(F.lit("o"), F.col("row_idx").cast("string"))), folder, ["chrom", "start", "end", "label"], sep="\t", compression="bzip2")
    return S.read_intervals(spark, folder).drop("row_idx")


@query(f"WITH {X.BLOCKS_SQL} SELECT 'b' || block_id AS header, text AS seq FROM comp WHERE ci = 1")
def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    c = F.get("components", F.lit(1))
    rows = X.blocks(spark, d).select(F.concat(F.lit(">b"), F.col("block_id").cast("string"), F.lit("\n"), F.substring(c["text"], F.lit(1), F.lit(20)), F.lit("\n"), F.substring(c["text"], F.lit(21), F.lit(12))).alias("value"))
    rows.write.text(folder)
    return S.read_fasta(spark, folder).select("header", "seq")


@query(f"""WITH {X.BLOCKS_SQL} SELECT block_id, string_agg(CASE substr(text, x.i, 1) WHEN 'A' THEN '0' WHEN 'C' THEN '1' WHEN 'G' THEN '2' WHEN 'T' THEN '3' WHEN '-' THEN '4' WHEN '*' THEN '5' ELSE '-1' END, ' ' ORDER BY x.i) AS symbols
FROM comp, range(1, 33) x(i) WHERE ci = 0 GROUP BY block_id""")
def fa_to_ints(spark: SparkSession, d: str) -> DataFrame:
    rows = X.blocks(spark, d).select("block_id", F.get("components", F.lit(0))["text"].alias("seq"))
    return B.sequence_symbols(rows).select("block_id", F.array_join(F.transform("symbols", lambda x: x.cast("string")), " ").alias("symbols"))
