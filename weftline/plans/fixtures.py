"""The given tables seen as blocks, intervals, sequences, points and feature tables, in Spark and, as
opening clauses of queries, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPECIES = ["hg17", "panTro1", "mm5"]
SRC_SIZE = 20_000_000
_HEX, _CHARS = "0123456789abcdef", "ACGTACGTACGT-*#="


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of two or three components for each order."""
    k = F.col("o_orderkey")
    parts = [
        F.struct(
            F.concat(F.lit(f"{s}.chr"), (F.floor(k / 4) % 22 + 1).cast("string")).alias("src"),
            (k * 32).alias("start"),
            F.lit(32).cast("long").alias("size"),
            F.when((k + i) % 7 == 0, "-").otherwise("+").alias("strand"),
            F.lit(SRC_SIZE).cast("long").alias("src_size"),
            F.translate(F.md5(F.concat(k.cast("string"), F.lit(f"-{s}")).cast("binary")), _HEX, _CHARS).alias("text"),
        )
        for i, s in enumerate(SPECIES)
    ]
    every, two = F.array(*parts), F.array(*parts[:2])
    return table(spark, sf_dir, "orders").select(k.alias("block_id"), F.when(k % 3 == 0, two).otherwise(every).alias("components"))


def scored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that overlap, up to four at a base, with a score; a component's size is the number of its bases."""
    k = F.col("block_id")
    size = lambda c: F.length(F.replace(c["text"], F.lit("-"), F.lit(""))).cast("long")
    parts = F.transform("components", lambda c: c.withField("start", F.col("block_id") * 8).withField("size", size(c)))
    return blocks(spark, sf_dir).select("block_id", (k % 7).cast("double").alias("score"), parts.alias("components"))


def asked_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of 120 bases for each customer, on either strand."""
    k = F.col("c_custkey")
    strand = F.when(k % 2 == 0, "-").otherwise("+")
    return table(spark, sf_dir, "customer").select(k.alias("row_idx"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chrom"), (k * 53 % 100_000).alias("start"), (k * 53 % 100_000 + 120).alias("end"), strand.alias("strand"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval for each order."""
    k = F.col("o_orderkey")
    start = k * 7919 % 5_000_000
    return table(spark, sf_dir, "orders").select(k.alias("row_idx"), F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("o_custkey") % 400 + 50).alias("end"))


def item_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval for each line item."""
    start = F.col("l_partkey") * 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.floor("l_quantity") * 10).alias("end"))


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ordered partitions of parts' intervals."""
    k, n = F.col("p_partkey"), (F.col("p_size") % 4)
    start = k * 104_729 % 5_000_000
    return table(spark, sf_dir, "part").select(n.alias("ord"), F.concat(F.lit("part"), n.cast("string")).alias("name"), (n * 10).cast("string").alias("score"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("p_size") * 20 + 100).alias("end"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two masked intervals for each part, near either end of the chromosomes."""
    k, n = F.col("p_partkey"), F.col("p_size") + 40
    at = F.explode(F.array(k * 1237 % 480_000, F.lit(SRC_SIZE - 480_000) + k * 991 % 480_000))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chrom"), at.alias("start"), n.alias("n"))
    return rows.select("chrom", "start", (F.col("start") + F.col("n")).alias("end"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(label, p, class)`` of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("label"), F.col("embedding").cast("array<double>").alias("p"), F.col("label").alias("class"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types in order of time, as numbers."""
    e = table(spark, sf_dir, "events")
    types = e.select("event_type").distinct().withColumn("code", F.dense_rank().over(_order("event_type")) - 1)  # a row for each type
    lists = e.join(F.broadcast(types), "event_type").groupBy(F.col("user_id").alias("seq_id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "code"))).alias("_e"))
    return lists.select("seq_id", F.transform("_e", lambda x: x["code"]).alias("ints"))


def _order(column: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy(column)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a feature table with gaps."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", F.expr("nullif(l_discount, 0.05D)").alias("l_discount"), F.expr("nullif(l_tax, 0.02D)").alias("l_tax")
    )


BLOCKS_SQL = """comp AS (
  SELECT o_orderkey AS block_id, i AS ci, sp, sp || '.chr' || ((o_orderkey // 4) % 22 + 1) AS src, o_orderkey * 32 AS start, 32::BIGINT AS size,
    CASE WHEN (o_orderkey + i) % 7 = 0 THEN '-' ELSE '+' END AS strand, 20000000::BIGINT AS src_size,
    translate(md5(o_orderkey || '-' || sp), '0123456789abcdef', 'ACGTACGTACGT-*#=') AS text
  FROM orders, (VALUES (0, 'hg17'), (1, 'panTro1'), (2, 'mm5')) s(i, sp) WHERE NOT (i = 2 AND o_orderkey % 3 = 0)
), cols AS (
  SELECT block_id, x.i, string_agg(substr(text, x.i, 1), '' ORDER BY ci) AS col FROM comp, range(1, 33) x(i) GROUP BY block_id, x.i
)"""
SCORED_SQL = BLOCKS_SQL + """, sc AS (
  SELECT block_id, ci, sp, src, split_part(src, '.', 2) AS chrom, block_id * 8 AS start, length(replace(text, '-', ''))::BIGINT AS size, strand, src_size, text, (block_id % 7)::DOUBLE AS score FROM comp
), ref AS (
  SELECT *, CASE WHEN strand = '-' THEN src_size - start - size ELSE start END AS fs, CASE WHEN strand = '-' THEN src_size - start ELSE start + size END AS fe,
    list_filter(range(1, 33), lambda i: substr(text, i::INTEGER, 1) <> '-') AS bc FROM sc WHERE ci = 0
)"""
ASKED_SQL = """asks AS (
  SELECT c_custkey AS row_idx, 'chr' || (c_custkey % 22 + 1) AS chrom, c_custkey * 53 % 100000 AS start, c_custkey * 53 % 100000 + 120 AS "end", CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '+' END AS strand FROM customer
)"""
INTERVALS_SQL = """iv AS (
  SELECT o_orderkey AS row_idx, 'chr' || (o_custkey % 22 + 1) AS chrom, o_orderkey * 7919 % 5000000 AS start, o_orderkey * 7919 % 5000000 + o_custkey % 400 + 50 AS "end" FROM orders
)"""
ITEMS_SQL = """items AS (
  SELECT l_orderkey, l_linenumber, 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey * 100 AS start, l_partkey * 100 + floor(l_quantity)::BIGINT * 10 AS "end" FROM lineitem
)"""
PARTS_SQL = """parts AS (
  SELECT p_size % 4 AS ord, 'part' || (p_size % 4) AS name, ((p_size % 4) * 10)::VARCHAR AS score, 'chr' || (p_partkey % 22 + 1) AS chrom,
    p_partkey * 104729 % 5000000 AS start, p_partkey * 104729 % 5000000 + p_size * 20 + 100 AS "end" FROM part
)"""
MASKS_SQL = """masks AS (
  SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, s AS start, s + p_size + 40 AS "end"
  FROM part, unnest([p_partkey * 1237 % 480000, 20000000 - 480000 + p_partkey * 991 % 480000]) t(s)
)"""
SEQ_SQL = """types AS (
  SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT event_type FROM events)
), ev AS (
  SELECT user_id AS seq_id, code, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events JOIN types USING (event_type)
)"""
KMERS_SQL = SEQ_SQL + """, kmers AS (
  SELECT a.seq_id, a.code || ' ' || b.code || ' ' || c.code AS kmer, count(*) AS count
  FROM ev a JOIN ev b ON a.seq_id = b.seq_id AND b.n = a.n + 1 JOIN ev c ON a.seq_id = c.seq_id AND c.n = a.n + 2 GROUP BY ALL
)"""
PAIRS_SQL = KMERS_SQL + """, pairs AS (
  SELECT a.seq_id AS i, b.seq_id AS j, sum(a.count * b.count)::DOUBLE AS w FROM kmers a JOIN kmers b ON a.kmer = b.kmer GROUP BY ALL
)"""
MATRIX_SQL = PAIRS_SQL + """, ids AS (SELECT DISTINCT user_id AS id FROM events), matrix AS (
  SELECT a.id AS i, b.id AS j, coalesce(w, 0) AS w FROM ids a CROSS JOIN ids b LEFT JOIN pairs ON i = a.id AND j = b.id
)"""
SIM_SQL = MATRIX_SQL + """, places AS (SELECT id, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS place FROM ids), sim AS (
  SELECT a.place AS i, b.place AS j, w FROM matrix JOIN places a ON a.id = i JOIN places b ON b.id = j
)"""
FEATURES_SQL = """feat AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, nullif(l_discount, 0.05::DOUBLE) AS l_discount, nullif(l_tax, 0.02::DOUBLE) AS l_tax FROM lineitem
)"""
