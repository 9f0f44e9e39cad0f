"""Queries that write the given tables in the text formats and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as W
from .. import sources as S
from ..operators import blocks as B
from ..operators import columns as C
from ..operators import mappings as M
from ..operators import phylogeny as P
from ..operators import statistics as T
from ..sources import packed as P8
from ..sources import shared_folder
from . import fixtures as X
from .alignment import _SS_SQL, query


def _lines(rows: DataFrame, columns: list[str], sep: str = " ", order: str | None = None) -> str:
    """Rows written as lines; the folder."""
    folder = shared_folder(rows.sparkSession)
    S.write_lines(rows.orderBy(order) if order else rows, folder, columns, sep)
    return folder


@query("SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey * 100 AS start, l_partkey * 100 + floor(l_quantity)::BIGINT * 10 AS \"end\", l_returnflag || chr(9) || l_linestatus || chr(9) || l_linenumber AS rest FROM lineitem")
def interval_fields_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lines at tabs with fields beyond the third."""
    start = F.col("l_partkey") * 100
    rows = X.table(spark, d, "lineitem").select("*", F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.floor("l_quantity") * 10).alias("end"))
    folder = _lines(rows, ["chrom", "start", "end", "l_returnflag", "l_linestatus", "l_linenumber"], "\t")
    return S.read_intervals(spark, folder, tabs=True).select("chrom", "start", "end", "rest")


@query(f"WITH {X.PARTS_SQL} SELECT ord::INTEGER AS ord, name, score, chrom, start, \"end\" FROM parts")
def partition_manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = X.partitions(spark, d)
    top = shared_folder(spark)
    rows.select("ord", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value")).write.partitionBy("ord").text(f"{top}/parts")
    names = rows.groupBy("ord").agg(F.first("name").alias("name"), F.first("score").alias("score")).orderBy("ord")
    names.select(F.concat_ws(" ", "name", "score", F.concat(F.lit(f"{top}/parts/ord="), F.col("ord").cast("string"))).alias("value")).coalesce(1).write.text(f"{top}/manifest")
    return S.read_partitions(spark, f"{top}/manifest")


@query("SELECT p_brand AS key, arg_max(p_partkey, p_partkey)::VARCHAR AS symbol FROM part GROUP BY p_brand")
def mapping_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A mapping with a line for each part: of a key's lines the last counts."""
    part = X.table(spark, d, "part").select(F.replace("p_brand", F.lit(" "), F.lit("_")).alias("key"), "p_partkey")
    back = S.read_mapping(spark, _lines(part, ["key", "p_partkey"], order="p_partkey"))
    return back.select(F.replace("key", F.lit("_"), F.lit(" ")).alias("key"), "symbol")


@query("SELECT vec_id::VARCHAR AS label, label + 1 AS count, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding) AS n FROM embeddings")
def distribution_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "embeddings").select("vec_id", (F.col("label") + 1).alias("count"), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ").alias("p"))
    back = S.read_distributions(spark, _lines(rows, ["vec_id", "count", "p"]))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    return back.select("label", "count", F.round(F.get("p", F.lit(0)), 6).alias("first"), F.round(total, 6).alias("total"), F.size("p").alias("n"))


@query(f"WITH {X.SEQ_SQL}, places AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS place FROM (SELECT DISTINCT seq_id FROM ev)) SELECT place AS seq_id, string_agg(code, ' ' ORDER BY n) AS ints FROM ev JOIN places USING (seq_id) GROUP BY place")
def int_sequence_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = X.sequences(spark, d).select("seq_id", F.array_join(F.transform("ints", lambda x: x.cast("string")), " ").alias("value"))
    back = S.read_int_sequences(spark, _lines(rows, ["value"], order="seq_id"))
    return back.select("seq_id", F.array_join(F.transform("ints", lambda x: x.cast("string")), " ").alias("ints"))


@query("SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS stage, (c_custkey % 1000)::INTEGER AS n_clusters, -c_nationkey AS left, c_nationkey + 1 AS right, c_acctbal AS sim FROM customer")
def merge_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "customer").select("c_custkey", F.col("c_custkey") % 1000, -F.col("c_nationkey"), F.col("c_nationkey") + 1, "c_acctbal").toDF("k", "n", "l", "r", "s")
    return S.read_merges(spark, _lines(rows, ["n", "l", "r", "s"], order="k"))


@query("SELECT 'chr' || s_suppkey AS name, 'hg' || s_nationkey AS build, s_name AS chrom, floor(abs(s_acctbal) * 1000)::BIGINT AS size, 'f' || s_suppkey AS fname FROM supplier")
def chromosome_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s, text = X.table(spark, d, "supplier"), lambda c: F.col(c).cast("string")
    rows = s.select(F.concat(F.lit("chr"), text("s_suppkey")).alias("name"), F.concat(F.lit("hg"), text("s_nationkey")).alias("build"), "s_name", F.floor(F.abs("s_acctbal") * 1000).alias("size"), F.concat(F.lit("f"), text("s_suppkey")).alias("f"))
    return S.read_chromosomes(spark, _lines(rows, ["name", "build", "s_name", "size", "f"], ","))


@query(f"WITH {X.FEATURES_SQL} SELECT * FROM feat")
def feature_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A feature table with its gaps, written and read with a header."""
    folder, rows = shared_folder(spark), X.features(spark, d)
    S.write_features(rows, folder)
    return S.read_features(spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_idx, nullif(l_discount, 0.05::DOUBLE) AS score FROM lineitem")
def score_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One column with its gaps, by place."""
    rows = X.table(spark, d, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0.05D)")).select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"), "l_discount")
    return S.read_scores(spark, _lines(rows, ["l_discount"], order="k"))


_THREE = """WITH s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_idx, l_extendedprice / 1000 AS score, l_quantity AS cpg, l_discount AS cons FROM lineitem), m AS (
  SELECT covar_pop(cpg, cpg) AS aa, covar_pop(cons, cons) AS bb, covar_pop(cpg, cons) AS ab, covar_pop(score, cpg) AS ya, covar_pop(score, cons) AS yb, avg(score) AS my, avg(cpg) AS ma, avg(cons) AS mb FROM s
), b AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS b2 FROM m)
SELECT row_idx, round(score - (my - b1 * ma - b2 * mb) - b1 * cpg - b2 * cons, 4) AS residual FROM s, b"""


@query(_THREE)
def zipped_score_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Three score files laid side by side by place, and what a linear model of two leaves of the third."""
    rows = X.table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"), (F.col("l_extendedprice") / 1000).alias("score"), F.col("l_quantity").alias("cpg"), F.col("l_discount").alias("cons"))
    files = {c: S.read_scores(spark, _lines(rows.select("k", c), [c], order="k")) for c in ("score", "cpg", "cons")}
    fit = T.ols_residuals(S.zip_scores(**files), "score", ["cpg", "cons"])
    return fit.select("row_idx", F.round("residual", 4).alias("residual"))


_CURVES = " UNION ALL ".join(f"SELECT '{c}' AS source, l_returnflag = 'R' AS y, {c}::DOUBLE AS s FROM lineitem WHERE {w}" for c, w in (("l_quantity", "true"), ("l_extendedprice", "true"), ("l_tax", "l_tax > 0")))


@query(f"""WITH v AS ({_CURVES}), e AS (SELECT source, min(s) AS lo, max(s) AS hi FROM v GROUP BY source), c AS (
  SELECT source, floor((s - lo) / (hi - lo) * 255)::INTEGER AS k, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM v JOIN e USING (source) GROUP BY 1, 2
), g AS (SELECT source, k::INTEGER AS k, lo + (hi - lo) * k / 255 AS threshold FROM e, range(256) t(k))
SELECT g.source, g.k, round(threshold, 6) AS threshold, round(sum(coalesce(p, 0)) OVER w / sum(coalesce(p, 0)) OVER (PARTITION BY g.source), 9) AS tpr,
  round(sum(coalesce(n, 0)) OVER w / sum(coalesce(n, 0)) OVER (PARTITION BY g.source), 9) AS fpr
FROM g LEFT JOIN c ON g.k = c.k AND g.source = c.source WINDOW w AS (PARTITION BY g.source ORDER BY g.k DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curves(spark: SparkSession, d: str) -> DataFrame:
    """The curves of three score sources, of one with the scores over 0 alone; each source is written as
    lines of a label and a score, and read."""
    rows, all_ = X.table(spark, d, "lineitem"), None
    for c in ("l_quantity", "l_extendedprice", "l_tax"):
        one = S.read_labelled_scores(spark, _lines(rows, ["l_returnflag", c])).withColumn("source", F.lit(c))
        all_ = one if all_ is None else all_.unionByName(one)
    out = T.roc_curves(all_, "source", "score", F.col("label") == "R", 256, above_zero=("l_tax",))
    return out.select("source", "k", *(F.round(c, n).alias(c) for c, n in (("threshold", 6), ("tpr", 9), ("fpr", 9))))


@query(_SS_SQL + """, head AS (
  SELECT unnest(range(-8, 0)) AS ord, unnest(['NSEQS = 3', 'LENGTH = 1000', 'TUPLE_SIZE = 1', 'NTUPLES = ' || (SELECT count(*) FROM n), 'NAMES = hg17,panTro1,mm5', 'ALPHABET = ACGT-', 'NCATS = -1', '']) AS value
) SELECT * FROM head UNION ALL SELECT row_number() OVER (ORDER BY key) - 1, (row_number() OVER (ORDER BY key) - 1) || chr(9) || key || chr(9) || count FROM n""")
def statistics_file(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a file of sufficient statistics."""
    return S.statistics_text(C.sufficient_statistics(X.blocks(spark, d), X.SPECIES), X.SPECIES, 1000)


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, nullif(p_size, 7) AS score FROM part)
SELECT -1::BIGINT AS ord, 'fixedStep chrom=chr1 start=1 step=1' AS value UNION ALL SELECT row_idx, coalesce(score::VARCHAR, 'NA') FROM s""")
def wiggle_file(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a track, a gap where a score is missing."""
    rows = B.dense_order(X.table(spark, d, "part").select("p_partkey", F.expr("nullif(p_size, 7)").alias("score")), "p_partkey")
    return S.wiggle_text(rows.withColumn("row_idx", F.col("_place") - 1), "chr1")


@query(f"WITH {X.FEATURES_SQL} SELECT 'x.' || l_orderkey || ' ' || l_linenumber || ' ' || l_discount || ' ' || l_tax AS value FROM feat WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL")
def prefixed_lines_without_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Lines in which no field is missing, with a prefix."""
    folder = _lines(X.features(spark, d), ["l_orderkey", "l_linenumber", "l_discount", "l_tax"])
    return S.prefix_lines(S.without_missing(S.numbered_lines(spark, folder)), "x.").select("value")


@query("WITH l AS (SELECT max(o_orderpriority) AS m FROM orders) SELECT o_orderkey::VARCHAR AS value FROM orders, l WHERE o_orderpriority = m")
def last_file(spark: SparkSession, d: str) -> DataFrame:
    """Of the files of a folder, one for each priority, the lines of the last by name."""
    folder = shared_folder(spark)
    rows = X.table(spark, d, "orders").select("o_orderpriority", F.col("o_orderkey").cast("string").alias("value"))
    rows.repartition(8, "o_orderpriority").write.partitionBy("o_orderpriority").text(folder)
    last = S.last_path(spark, f"{folder}/*", "part-*")
    return spark.read.text(last.rsplit("/", 1)[0]).select("value")


@query("""WITH a(c, n) AS (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3)), u AS (SELECT DISTINCT upper(translate(substr(md5(o_orderkey || '-hg17'), 1, 1), '0123456789abcdef', 'ACGTACGTACGT-*#=')) AS c FROM orders)
SELECT x.c || y.c AS key, s.c AS state, (SELECT count(*) FROM u WHERE u.c = x.c) AS seen, round(lik / sum(lik) OVER (PARTITION BY x.c, y.c), 9) AS p
FROM a x, a y, a s, LATERAL (SELECT (0.25 + CASE WHEN x.c = s.c THEN 0.75 ELSE -0.25 END * exp(-0.4 / 3)) * (0.25 + CASE WHEN y.c = s.c THEN 0.75 ELSE -0.25 END * exp(-0.8 / 3)) AS lik) l""")
def all_tree_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every column that a tree of two leaves can have, its root's states, and whether a block's first column begins so."""
    model = P.TreeModel.parse("ALPHABET: A C G T\nBACKGROUND: 0.25 0.25 0.25 0.25\nRATE_MAT:\n" + "\n".join(" ".join("-1" if i == j else repr(1 / 3) for j in range(4)) for i in range(4)) + "\nTREE: (hg17:0.1,mm5:0.2);")
    first = X.blocks(spark, d).select(F.upper(F.substring(F.get("components", F.lit(0))["text"], 1, 1)).alias("c")).distinct().withColumn("_s", F.lit(1))
    states = F.arrays_zip(F.array(*map(F.lit, "ACGT")).alias("state"), F.col("p"))
    keys = P.all_columns(spark, model, ["hg17", "mm5"]).select("key", F.explode(states).alias("z")).select("key", "z.state", F.round("z.p", 9).alias("p"))
    keys = keys.join(F.broadcast(first), F.substring("key", 1, 1) == F.col("c"), "left")  # a few characters
    return keys.select("key", "state", F.coalesce(F.col("_s"), F.lit(0)).cast("long").alias("seen"), "p")


_TILES = "tiles AS (SELECT 'chr' || ((p_partkey - 1) % 22 + 1) AS chrom, (p_partkey - 1) // 22 AS tile_no, translate(md5('p' || p_partkey), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM part)"


def _packed(spark: SparkSession, d: str) -> str:
    """A folder of packed sequence files: a chromosome's bases, 32 from each part."""
    k = F.col("p_partkey")
    seq = F.translate(F.md5(F.concat(F.lit("p"), k.cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    tiles = X.table(spark, d, "part").select(F.concat(F.lit("chr"), ((k - 1) % 22 + 1).cast("string")).alias("chrom"), F.floor((k - 1) / 22).alias("tile_no"), seq.alias("seq"))
    folder = shared_folder(spark)
    P8.write_packed(tiles, folder)
    return folder


@query(f"WITH {_TILES} SELECT chrom, tile_no, seq FROM tiles")
def packed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Packed sequence files written, and read by tiles of 32 bases."""
    return P8.read_packed(spark, _packed(spark, d), tile=32)


@query(f"""WITH {_TILES}, whole AS (SELECT chrom, string_agg(seq, '' ORDER BY tile_no) AS seq FROM tiles GROUP BY chrom), iv AS (
  SELECT c_custkey AS row_idx, 'chr' || (c_custkey % 23 + 1) AS chrom, c_custkey * 37 % 2800 AS start, c_custkey * 37 % 2800 + c_custkey % 90 AS "end" FROM customer
), f AS (SELECT row_idx, whole.chrom AS there, CASE WHEN start < "end" THEN substr(seq, (start + 1)::INTEGER, ("end" - start)::INTEGER) ELSE '' END AS seq FROM iv LEFT JOIN whole USING (chrom))
SELECT row_idx, CASE WHEN there IS NOT NULL THEN seq END AS seq, round(CASE WHEN length(seq) > 0 THEN len(regexp_extract_all(seq, '[CG]')) / length(seq)::DOUBLE END, 9) AS density FROM f""")
def packed_gc_density(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of packed sequences, read one by one, and their share of C and G."""
    k = F.col("c_custkey")
    asks = X.table(spark, d, "customer").select(k.alias("row_idx"), F.concat(F.lit("chr"), (k % 23 + 1).cast("string")).alias("chrom"), (k * 37 % 2800).alias("start"), (k * 37 % 2800 + k % 90).alias("end"))
    return P8.fetch_packed(asks, _packed(spark, d)).select("row_idx", "seq", F.round(W.density(F.col("seq"), "[CG]"), 9).alias("density"))


@query(_SS_SQL + """, head AS (
  SELECT unnest(range(-8, 0)) AS ord, unnest(['NSEQS = 3', 'LENGTH = 1000', 'TUPLE_SIZE = 1', 'NTUPLES = ' || (SELECT count(*) FROM n), 'NAMES = hg17,panTro1,mm5', 'ALPHABET = ACGT-', 'NCATS = -1', '']) AS value
), l AS (SELECT * FROM head UNION ALL SELECT row_number() OVER (ORDER BY key) - 1, (row_number() OVER (ORDER BY key) - 1) || chr(9) || key || chr(9) || count FROM n)
SELECT 'columns.ss' AS file, sha256(string_agg(value || chr(10), '' ORDER BY ord)) AS sha256 FROM l""")
def statistics_one_file(spark: SparkSession, d: str) -> DataFrame:
    """A file of sufficient statistics; its bytes."""
    folder = shared_folder(spark)
    S.write_statistics(C.sufficient_statistics(X.blocks(spark, d), X.SPECIES), X.SPECIES, 1000, folder, "columns.ss")
    return _digests(spark, folder)


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


@query(f"""WITH {X.ITEMS_SQL}, p AS (SELECT chrom, start // 100 AS pos, max("end" - start)::DOUBLE AS score FROM items GROUP BY ALL), q AS (SELECT * FROM p WHERE score <> 300), l AS (
  SELECT chrom, pos, 1 AS k, score::VARCHAR AS value FROM q
  UNION ALL SELECT chrom, pos, 0, 'fixedStep chrom=' || chrom || ' start=' || (pos + 1) || ' step=1' FROM q WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.chrom = q.chrom AND b.pos = q.pos - 1)
  UNION ALL SELECT DISTINCT chrom, -1, 0, 'track type=wiggle_0 name=items.' || chrom FROM q
)
SELECT chrom || '.wig' AS file, sha256(string_agg(value || chr(10), '' ORDER BY pos, k)) AS sha256 FROM l GROUP BY chrom""")
def track_files(spark: SparkSession, d: str) -> DataFrame:
    """A track file for each chromosome, gaps where scores are missing; their bytes."""
    folder = shared_folder(spark)
    rows = X.item_intervals(spark, d).groupBy("chrom", F.floor(F.col("start") / 100).alias("pos")).agg(F.max(F.col("end") - F.col("start")).cast("double").alias("score"))
    S.write_tracks(rows.withColumn("score", F.expr("nullif(score, 300D)")), folder, "items")
    return _digests(spark, folder)


@query("SELECT doc_id::VARCHAR AS label, lang FROM documents WHERE doc_id % 3 <> 0")
def commented_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of which each third is a comment; the others, by their place without comments."""
    docs = X.table(spark, d, "documents").select("doc_id", "lang", F.concat(F.when(F.col("doc_id") % 3 == 0, "#").otherwise(""), F.col("doc_id").cast("string"), F.lit(" 1 0.5")).alias("value"))
    folder = _lines(docs.select("doc_id", "value"), ["value"], order="doc_id")
    back = S.read_distributions(spark, folder)
    return back.join(docs.select(F.col("doc_id").cast("string").alias("label"), "lang"), "label").select("label", "lang")


@query("SELECT s_name AS key, (s_suppkey % 9)::VARCHAR AS symbol FROM supplier")
def mapping_from_trace(spark: SparkSession, d: str) -> DataFrame:
    """The row of a trace of clusterings that has nine clusters, given to names by their places."""
    s = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("key"))
    names = B.dense_order(s, "k").withColumn("row_idx", F.col("_place") - 1)
    every = names.agg(F.sort_array(F.collect_list(F.struct("row_idx", "k"))).alias("_a"))  # a clustering is a row of its trace, as the format has it
    trace = every.select(F.explode(F.array(*map(F.lit, (7, 9, 12)))).alias("n_clusters"), "_a").withColumn("assign", F.transform("_a", lambda x: (x["k"] % F.col("n_clusters")).cast("int")))
    return M.from_clusters(names.select("row_idx", "key"), trace.select("n_clusters", "assign"), 9)
