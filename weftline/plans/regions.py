"""Queries over regions of blocks (ranges, tiles, depth) and over scores of symbols in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as W
from ..operators import blocks as B
from ..operators import phylogeny as P
from ..operators import scoring as G
from ..operators import tiling as L
from ..sources import saved
from . import fixtures as X
from .alignment import _SS_SQL, _statistics, query

_COMPONENTS = ["src", "start", "size", "strand", "text"]


@query(f"""WITH {X.ITEMS_SQL}, ev AS (
  SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM items WHERE start < "end" UNION ALL SELECT chrom, "end", -1 FROM items WHERE start < "end") GROUP BY chrom, pos HAVING sum(d) <> 0
), r AS (SELECT chrom, pos AS start, lead(pos) OVER w AS "end", (sum(d) OVER w)::BIGINT AS depth FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos))
SELECT * FROM r WHERE depth > 0""")
def cover_depth(spark: SparkSession, d: str) -> DataFrame:
    """How many line items' intervals cover each stretch of bases."""
    return L.cover_depth(X.item_intervals(spark, d))


@query(f"""WITH {X.SCORED_SQL}, b AS (
  SELECT ref.chrom, ref.fs + x.k AS pos, count(DISTINCT sc.sp) AS n FROM ref JOIN sc USING (block_id), range(0, 32) x(k) WHERE x.k < ref.size GROUP BY ALL
), g AS (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS run FROM b WHERE n >= 3)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end" FROM g GROUP BY chrom, run""")
def covered_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Where all three species are over a base."""
    return L.covered_ranges(X.scored_blocks(spark, d), X.SPECIES, 3)


_CUT = f"""WITH {X.SCORED_SQL}, {X.ASKED_SQL}, hit AS (
  SELECT row_idx, asks.strand AS side, ref.block_id, ref.strand, greatest(asks.start, fs) AS low, least("end", fe) AS high, fs, fe, bc
  FROM asks JOIN ref ON asks.chrom = ref.chrom AND asks.start < fe AND fs < "end"
), spot AS (
  SELECT *, bc[CASE WHEN strand = '-' THEN fe - high ELSE low - fs END + 1] AS c1, bc[CASE WHEN strand = '-' THEN fe - low ELSE high - fs END] AS c2 FROM hit
), cut AS (
  SELECT row_idx, side, spot.strand AS ref_strand, spot.block_id, ci, src, sc.start + length(replace(substr(text, 1, c1::INTEGER - 1), '-', '')) AS start, sc.strand, src_size, substr(text, c1::INTEGER, (c2 - c1 + 1)::INTEGER) AS text
  FROM spot JOIN sc ON sc.block_id = spot.block_id
)"""


@query(_CUT + " SELECT row_idx, block_id, src, start, length(replace(text, '-', ''))::BIGINT AS size, strand, text FROM cut")
def extract_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of blocks that ranges meet, cut to them on either strand of the blocks."""
    return L.extract_ranges(X.asked_ranges(spark, d), X.scored_blocks(spark, d)).select("row_idx", "block_id", F.inline("components")).drop("src_size")


@query(_CUT + """, t AS (SELECT *, length(replace(text, '-', ''))::BIGINT AS size, side <> ref_strand AS turned FROM cut)
SELECT row_idx, block_id, src, CASE WHEN turned THEN src_size - start - size ELSE start END AS start, size, CASE WHEN turned = (strand = '-') THEN '+' ELSE '-' END AS strand,
  CASE WHEN turned THEN translate(reverse(text), 'ACGTacgt', 'TGCAtgca') ELSE text END AS text FROM t""")
def extract_ranges_by_strand(spark: SparkSession, d: str) -> DataFrame:
    """The same, turned so that the first species runs as the range does."""
    rows = L.extract_ranges(X.asked_ranges(spark, d), X.scored_blocks(spark, d), by_strand=True)
    return rows.select("row_idx", "block_id", F.inline("components")).drop("src_size")


@query(f"""WITH {X.SCORED_SQL} SELECT block_id, k::INTEGER AS piece, src, start + length(replace(substr(text, 1, k::INTEGER * 10), '-', '')) AS start, length(replace(substr(text, k::INTEGER * 10 + 1, 10), '-', ''))::BIGINT AS size, strand,
  substr(text, k::INTEGER * 10 + 1, 10) AS text FROM sc, range(0, 4) t(k)""")
def chop_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in pieces of ten columns."""
    return L.chop_blocks(X.scored_blocks(spark, d), 10).select("block_id", "piece", F.inline("components")).drop("src_size")


_BASES = f"""WITH {X.SCORED_SQL}, base AS (
  SELECT chrom, fs + x.k AS pos, block_id, strand, score, fs, bc[CASE WHEN strand = '-' THEN size - x.k ELSE x.k + 1 END] AS col FROM ref, range(0, 32) x(k) WHERE x.k < size
), best AS (
  SELECT chrom, pos, block_id, strand, col FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY score DESC, fs, block_id) AS n FROM base) WHERE n = 1
)"""


@query(_BASES + """, g AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, block_id ORDER BY pos) AS run FROM best)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", block_id AS id FROM g GROUP BY chrom, block_id, run""")
def best_cover(spark: SparkSession, d: str) -> DataFrame:
    """For each base the best block over it."""
    c0 = F.get("components", F.lit(0))
    pieces = X.scored_blocks(spark, d).select(W.chrom_of(c0["src"]).alias("chrom"), W.forward_start(c0).alias("start"), W.forward_end(c0).alias("end"), "score", F.col("block_id").alias("id"))
    return L.best_cover(pieces)


@query(_BASES + f""", {X.ASKED_SQL}, p AS (
  SELECT row_idx, x.pos, block_id, best.strand, col, asks.strand AS side FROM asks JOIN LATERAL (SELECT unnest(range(asks.start, asks."end")) AS pos) x ON true LEFT JOIN best ON best.chrom = asks.chrom AND best.pos = x.pos
), r AS (SELECT *, pos - row_number() OVER (PARTITION BY row_idx, block_id ORDER BY pos) AS run FROM p), s AS (
  SELECT row_idx, any_value(side) AS side, block_id, any_value(strand) AS strand, min(pos) AS low, count(*)::INTEGER AS n, min(col)::INTEGER AS c1, max(col)::INTEGER AS c2 FROM r GROUP BY row_idx, block_id, run
), x AS (
  SELECT s.row_idx, s.side, s.low, i, CASE WHEN s.block_id IS NULL THEN repeat('*', n) ELSE coalesce(substr(sc.text, c1, c2 - c1 + 1), repeat('*', c2 - c1 + 1)) END AS text, s.strand
  FROM s CROSS JOIN (VALUES (0), (1), (2)) k(i) LEFT JOIN sc ON sc.block_id = s.block_id AND sc.ci = k.i
), w AS (
  SELECT row_idx, any_value(side) AS side, i, string_agg(CASE WHEN strand = '-' THEN translate(reverse(text), 'ACGTacgt', 'TGCAtgca') ELSE text END, '' ORDER BY low) AS text FROM x GROUP BY row_idx, i
)
SELECT row_idx, i::INTEGER AS i, CASE WHEN side = '-' THEN translate(reverse(text), 'ACGTacgt', 'TGCAtgca') ELSE text END AS text FROM w""")
def tile_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One block for each range, each base from the best block over it."""
    rows = L.tile_blocks(X.asked_ranges(spark, d), X.scored_blocks(spark, d), X.SPECIES, by_strand=True)
    return rows.select("row_idx", F.posexplode("components").alias("i", "c")).select("row_idx", "i", "c.text")


_ORDER = 5
_HISTORY = _SS_SQL + f""", m AS (SELECT key, count % 5 AS symbol FROM n WHERE count % 3 <> 0), pl AS (
  SELECT cols.block_id, cols.i, m.symbol, sum(CASE WHEN m.symbol IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY cols.block_id ORDER BY cols.i) AS g FROM cols LEFT JOIN m ON m.key = cols.col
), h AS (
  SELECT block_id, i, symbol, CASE WHEN symbol IS NULL THEN NULL ELSE coalesce(string_agg(symbol::VARCHAR, ' ') FILTER (WHERE symbol IS NOT NULL) OVER (PARTITION BY block_id, g ORDER BY i ROWS BETWEEN {_ORDER} PRECEDING AND 1 PRECEDING), '') END AS before FROM pl
), ends AS (
  SELECT before, d AS depth, array_to_string(string_split(before, ' ')[len(string_split(before, ' ')) - d + 1:], ' ') AS context
  FROM (SELECT DISTINCT before FROM h WHERE symbol IS NOT NULL), unnest(range(0, CASE WHEN before = '' THEN 1 ELSE len(string_split(before, ' ')) + 1 END)) t(d)
), c AS (
  SELECT o_orderpriority < '3' AS urgent, depth, CASE WHEN depth = 0 THEN '' ELSE context END AS context, symbol, count(*) AS count
  FROM h JOIN orders ON o_orderkey = block_id JOIN ends USING (before) WHERE symbol IS NOT NULL GROUP BY ALL
), tot AS (SELECT urgent, depth, context, sum(count)::BIGINT AS total FROM c GROUP BY ALL), sh AS (
  SELECT c.*, count / total AS p, regexp_replace(context, '^[^ ]+ ?', '') AS up FROM c JOIN tot USING (urgent, depth, context)
), kl AS (
  SELECT a.urgent, a.depth, a.context, sum(a.p * ln(a.p / b.p)) AS kl FROM sh a JOIN sh b ON a.urgent = b.urgent AND b.depth = a.depth - 1 AND b.context = a.up AND b.symbol = a.symbol GROUP BY ALL
), worth AS (
  SELECT urgent, depth, context FROM tot LEFT JOIN kl USING (urgent, depth, context) WHERE depth = 0 OR (total >= 10 AND kl >= 0.01)
), tree AS (
  SELECT DISTINCT w.urgent, d AS depth, CASE WHEN d = 0 THEN '' ELSE array_to_string(string_split(w.context, ' ')[w.depth - d + 1:], ' ') END AS context FROM worth w, unnest(range(0, w.depth + 1)) t(d)
)"""


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """``(block_id, urgent, ints)``: blocks as symbols; two classes of them."""
    mapping = _statistics(spark, d).where("count % 3 <> 0").select("key", (F.col("count") % 5).cast("string").alias("symbol"))
    coded = B.to_symbols(X.blocks(spark, d), mapping).select("block_id", F.split("symbols", " ").cast("array<int>").alias("ints"))
    urgent = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), (F.col("o_orderpriority") < "3").alias("urgent"))
    return coded.join(urgent, "block_id")


@query(_HISTORY + " SELECT urgent, depth::INTEGER AS depth, context, total, round(kl, 8) AS kl FROM tree JOIN tot USING (urgent, depth, context) LEFT JOIN kl USING (urgent, depth, context)")
def context_tree(spark: SparkSession, d: str) -> DataFrame:
    """A Markov model of variable order for each class of blocks."""
    counts = saved(G.context_counts(_symbols(spark, d), _ORDER, ("urgent",)))
    return G.context_tree(counts, by=("urgent",)).withColumn("kl", F.round("kl", 8))


_TABLE = _HISTORY + """, side AS (
  SELECT t.depth, t.context, s.symbol, coalesce(sum(count) FILTER (WHERE urgent), 0) AS a, coalesce(sum(count) FILTER (WHERE NOT urgent), 0) AS b
  FROM (SELECT DISTINCT depth, context FROM tree) t CROSS JOIN (SELECT DISTINCT symbol FROM c) s LEFT JOIN c ON c.depth = t.depth AND c.context = t.context AND c.symbol = s.symbol GROUP BY ALL
), odds AS (
  SELECT depth, context, symbol, ln(((a + 1.0) / (sum(a) OVER w + count(*) OVER w)) / ((b + 1.0) / (sum(b) OVER w + count(*) OVER w))) AS score FROM side WINDOW w AS (PARTITION BY depth, context)
)"""


def _table(symbols: DataFrame) -> DataFrame:
    counts = saved(G.context_counts(symbols, _ORDER, ("urgent",)))
    return saved(G.log_odds(counts, G.context_tree(counts, by=("urgent",)), F.col("urgent")))


@query(_TABLE + " SELECT depth::INTEGER AS depth, context, symbol::INTEGER AS symbol, round(score, 8) AS score FROM odds")
def score_table(spark: SparkSession, d: str) -> DataFrame:
    """Log odds of symbols after the contexts of both models."""
    return _table(saved(_symbols(spark, d))).withColumn("score", F.round("score", 8))


_PLACES = _TABLE + """, look AS (
  SELECT h.before, h.symbol, arg_max(score, odds.depth) AS score FROM (SELECT DISTINCT before, symbol FROM h WHERE symbol IS NOT NULL) h JOIN ends USING (before)
  JOIN odds ON odds.depth = ends.depth AND odds.context = CASE WHEN ends.depth = 0 THEN '' ELSE ends.context END AND odds.symbol = h.symbol GROUP BY ALL
), ps AS (SELECT h.block_id, h.i, look.score FROM h LEFT JOIN look ON look.before = h.before AND look.symbol = h.symbol)"""


@query(_PLACES + " SELECT block_id, count(score) AS n, round(CASE WHEN count(*) - count(score) <= 20 THEN avg(score) END, 8) AS score FROM ps GROUP BY block_id")
def block_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each block's mean score, if it has enough symbols."""
    symbols = saved(_symbols(spark, d))
    scores = G.scored(symbols, _table(symbols), _ORDER, ("block_id",))
    return G.run_scores(scores, "block_id", most_missing=20).withColumn("score", F.round("score", 8))


@query(_PLACES + """, spot AS (
  SELECT comp.chrom, comp.start + ps.i - 1 AS pos, score FROM ps JOIN (SELECT block_id, split_part(src, '.', 2) AS chrom, start FROM comp WHERE ci = 0) comp USING (block_id)
), win AS (
  SELECT chrom, pos AS start, count(score) OVER w AS n, avg(score) OVER w AS score, count(*) OVER w AS wide FROM spot WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 99 FOLLOWING)
)
SELECT chrom, start, n, round(CASE WHEN 100 - n <= 60 THEN score END, 8) AS score FROM win WHERE wide = 100""")
def window_scores(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 100 places, at each place, along the first species."""
    symbols = saved(_symbols(spark, d))
    scores = G.scored(symbols, _table(symbols), _ORDER, ("block_id",))
    c0 = F.get("components", F.lit(0))
    starts = X.blocks(spark, d).select("block_id", W.chrom_of(c0["src"]).alias("chrom"), c0["start"].alias("at"))
    return G.run_windows(scores.join(starts, "block_id"), 100, 1, most_missing=60).withColumn("score", F.round("score", 8))


@query()
def model_fit(spark: SparkSession, d: str) -> DataFrame:
    """The steps by which a substitution model is fitted to the columns of all blocks."""
    columns = saved(_statistics(spark, d).select("key", "count"))
    fit = P.fit_model(columns, P.parse_newick("((hg17:0.1,panTro1:0.3):0.2,mm5:0.4);"), X.SPECIES)
    return spark.createDataFrame(fit.trace, "step int, log_likelihood double, scale double, kappa double, gap double")
