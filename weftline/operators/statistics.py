"""Statistics of feature tables and score vectors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import numbered_rows, saved


def correlations(rows: DataFrame, columns: list[str], by: str | None = None, complete: bool = False) -> DataFrame:
    """``(x, y, r)`` for all pairs of columns: over rows in which both are there, or with ``complete``
    over rows that have all columns. One aggregate holds all pairs; with ``by`` a row for each group."""
    pairs = list(combinations(columns, 2))
    base = rows.dropna(subset=columns) if complete else rows
    cells = [F.corr(F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))).alias(f"r{k}") for k, (x, y) in enumerate(pairs)]
    one = (base.groupBy(by) if by else base.groupBy()).agg(*cells)
    made = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{k}").alias("r")) for k, (x, y) in enumerate(pairs))))
    return one.select(*([by] if by else []), made.alias("c")).select(*([by] if by else []), "c.*")


def ols_fit(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """A row of least-squares coefficients, ``b0`` (the constant) and ``b1`` on, with ``n`` and ``r2``, for
    one or two regressors, from one aggregate of co-moments over rows without nulls."""
    full = rows.dropna(subset=[y, *xs])
    moments = [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate([y, *xs]) for j, b in enumerate([y, *xs]) if i <= j]
    means = [F.avg(c).alias(f"m_{i}") for i, c in enumerate([y, *xs])]
    s = full.agg(*moments, *means, F.count(F.lit(1)).alias("n"))
    c = lambda i, j: F.col(f"c_{min(i, j)}_{max(i, j)}")
    if len(xs) == 1:
        b = [F.try_divide(c(0, 1), c(1, 1))]
    elif len(xs) == 2:
        det = c(1, 1) * c(2, 2) - c(1, 2) * c(1, 2)
        b = [F.try_divide(c(0, 1) * c(2, 2) - c(0, 2) * c(1, 2), det), F.try_divide(c(0, 2) * c(1, 1) - c(0, 1) * c(1, 2), det)]
    else:
        raise ValueError("one or two regressors; ols_summary takes more")
    s = s.withColumns({f"b{k + 1}": x for k, x in enumerate(b)})
    fitted = sum((F.col(f"b{k + 1}") * c(0, k + 1) for k in range(len(xs))), F.lit(0.0))
    s = s.withColumn("b0", F.col("m_0") - sum((F.col(f"b{k + 1}") * F.col(f"m_{k + 1}") for k in range(len(xs))), F.lit(0.0)))
    return s.withColumn("r2", F.try_divide(fitted, c(0, 0))).select("n", "b0", *(f"b{k + 1}" for k in range(len(xs))), "r2")


def ols_residuals(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``rows`` with ``residual``: null where a value is missing. The fit is one row, sent to all tasks."""
    out = rows.crossJoin(F.broadcast(ols_fit(rows, y, xs)))  # one row
    fitted = sum((F.col(f"b{k + 1}") * F.col(x) for k, x in enumerate(xs)), F.col("b0"))
    return out.withColumn("residual", F.col(y) - fitted).select(*rows.columns, "residual")


def ols_summary(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``(term, estimate, std_error, t, p, r2)`` of a least-squares fit over rows without nulls."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    full = rows.dropna(subset=[y, *xs]).select(*(F.col(c).cast("double").alias(c) for c in [y, *xs]))
    data = VectorAssembler(inputCols=xs, outputCol="_x").transform(full)
    s = LinearRegression(featuresCol="_x", labelCol=y, solver="normal", regParam=0.0).fit(data)
    t = s.summary
    values = [*s.coefficients.toArray().tolist(), s.intercept]
    table = zip([*xs, "(Intercept)"], values, t.coefficientStandardErrors, t.tValues, t.pValues, [t.r2] * (len(xs) + 1), strict=True)
    return rows.sparkSession.createDataFrame([(a, *map(float, b)) for a, *b in table], "term string, estimate double, std_error double, t double, p double, r2 double")


def fixed_residual(score: Column, cons: Column, gc: Column) -> Column:
    """A score less a given linear model of conservation and GC content."""
    # fixed values: the published fit
    return score - (F.lit(-0.34866) + F.lit(0.17174) * cons + F.lit(0.63263) * gc)


def roc_curve(rows: DataFrame, score: str, positive: Column, breaks: int = 2048) -> DataFrame:
    """``(k, threshold, tpr, fpr)`` at ``breaks`` even thresholds from the lowest score to the highest;
    a row is called positive from the threshold on. Scores are counted by threshold once and then
    summed from the top, over at most ``breaks`` rows."""
    scored = rows.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), positive.cast("int").alias("y"))
    ends = scored.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(breaks - 1))).alias("k")).withColumn("threshold", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (breaks - 1))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (breaks - 1))).otherwise(F.lit(breaks - 1))
    counts = scored.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("k")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))  # ends: one row
    rows_ = grid.join(counts, "k", "left").na.fill(0, ["p", "n"])
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows_.select("k", "threshold", F.try_divide(F.sum("p").over(up), F.sum("p").over(every)).alias("tpr"), F.try_divide(F.sum("n").over(up), F.sum("n").over(every)).alias("fpr"))


def roc_curves(rows: DataFrame, by: str, score: str, positive: Column, breaks: int = 2048, above_zero: tuple[str, ...] = ()) -> DataFrame:
    """``(by, k, threshold, tpr, fpr)``: a curve as ``roc_curve`` has it for each score source in ``by``, to be
    laid over each other. Of the sources in ``above_zero`` only scores over 0 count."""
    scored = rows.where(F.col(score).isNotNull()).where(~F.col(by).isin(*above_zero) | (F.col(score) > 0)) if above_zero else rows.where(F.col(score).isNotNull())
    scored = scored.select(F.col(by).alias("g"), F.col(score).cast("double").alias("s"), positive.cast("int").alias("y"))
    ends = scored.groupBy("g").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))  # a row for each source
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (breaks - 1))).otherwise(F.lit(breaks - 1))
    counts = scored.join(F.broadcast(ends), "g").groupBy("g", at.cast("int").alias("k")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    grid = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(breaks - 1)))).join(counts, ["g", "k"], "left").na.fill(0, ["p", "n"])
    up = Window.partitionBy("g").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("g")
    rate = lambda c: F.try_divide(F.sum(c).over(up), F.sum(c).over(every))
    return grid.select(F.col("g").alias(by), "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (breaks - 1)).alias("threshold"), rate("p").alias("tpr"), rate("n").alias("fpr"))


def ecdf_grid(rows: DataFrame, value: str, by: str, span: list[str], steps: int = 1000) -> DataFrame:
    """``(by, k, x, cdf)``: the share of a group's values up to each of ``steps + 1`` even points between
    the smallest and largest values of the groups in ``span``. Nulls don't count."""
    base = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    ends = base.where(F.col("g").isin(span)).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("v") <= F.col("lo"), F.lit(0)).otherwise(F.ceil(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * steps))
    counts = base.crossJoin(F.broadcast(ends)).groupBy("g", F.least(F.coalesce(place, F.lit(0)), F.lit(steps + 1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))  # ends: one row
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    grid = totals.crossJoin(F.broadcast(ends)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))))
    up = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = grid.join(counts, ["g", "k"], "left").withColumn("c", F.sum(F.coalesce("n", F.lit(0))).over(up))
    return out.select(F.col("g").alias(by), "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / steps).alias("x"), (F.col("c") / F.col("total")).alias("cdf"))


def box_statistics(rows: DataFrame, value: str, by: str) -> DataFrame:
    """``(by, low, q1, median, q3, high)`` of each group."""
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    found = quantiles(rows, value, list(names), [by])
    return found.groupBy(by).agg(*(F.max(F.when(F.col("share") == q, F.col("v"))).alias(n) for q, n in names.items()))


def dataset_class(dataset: Column, support: Column) -> Column:
    """The class of a region by its data set and support."""
    # fixed values: the names of the data sets
    promoters, distal, repeats, modules, putative = "pos_enc_proms_tile", "enc_distal_loose_2_tile", "enc_ar", "wang_preCRMs_tile", "put_enc_proms_tile"
    by_support = lambda *steps: F.coalesce(*(F.when(support >= least, k) for least, k in steps))
    kind = F.when(dataset == promoters, by_support((15, 3), (5, 2), (float("-inf"), 1)))
    kind = kind.when(dataset == distal, F.when(support == 1, 4).when(support > 1, 5))
    kind = kind.when(dataset == repeats, 6).when(dataset == modules, 7).when(dataset == putative, 8)
    return F.coalesce(kind, F.lit(0))


def classed_regions(rows: DataFrame, columns: tuple[str, ...], dataset: str = "dataset", support: str = "support", most: int = 5) -> DataFrame:
    """``rows`` that have all ``columns`` and are of no regulatory tile, with their ``class``, up to ``most``."""
    # fixed value: the data set that is left out
    full = rows.dropna(subset=list(columns)).where(F.col(dataset) != "reg_tile")
    return full.withColumn("class", dataset_class(F.col(dataset), F.col(support))).where(F.col("class") <= most)


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None, bins: int = 4_096, sorted_rows: int = 65_536) -> DataFrame:
    """``by``, ``share`` and ``v``: exact quantiles, between two values by their distance; nulls don't count.

    The two ranks on either side of a quantile are looked for by narrowing: a histogram of a group's values says in which bin a rank is, and what that bin's
    smallest and largest values are; a bin of more than ``sorted_rows`` rows (unless all are equal) is cut to ``bins`` bins again, and only what is left is
    sorted. So nothing but counts is shuffled, and no task sorts more than a bin. Values that are infinite or no number have no bins; where
    there are any, all are sorted by ranges (``numbered_rows``)."""
    keys = by or []
    base = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_one"))
    base = base.withColumn("_g", group)
    odd = F.isnan("_v") | (F.abs("_v") == float("inf"))
    ends = saved(base.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.max(odd).alias("_odd")))
    if ends.where("_odd").limit(1).count():
        return _sorted_quantiles(base.drop("_g"), shares, keys)
    pos = F.col("share") * (F.col("_n") - 1)
    asked = ends.select("_g", "_lo", "_hi", "_n", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    asked = asked.select("_g", "_lo", "_hi", "_n", "share", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))).alias("_rank"))
    # where each rank is: between two values, so many rows before, so many there
    found = saved(asked.select("_g", "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), "_n").distinct())
    while found.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > sorted_rows)).limit(1).count():
        spans = found.select("_g", "_lo", "_hi", "_before").distinct()  # a row for each rank asked for, at most
        inside = base.join(spans, "_g").where("_v >= _lo and _v <= _hi")
        # halves, so that the distance of two values of opposite signs is a number, too
        place = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        span = ["_g", "_lo", "_hi", "_before"]
        counts = inside.groupBy(*span, F.floor(F.when(F.col("_v") == F.col("_lo"), 0.0).otherwise(F.coalesce(place, F.lit(1.0))) * bins).alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        first = F.coalesce(F.sum("n").over(Window.partitionBy(*span).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", F.col("_before") + first)
        found = found.join(counts, span).where("_rank >= before and _rank < before + n")
        found = saved(found.select("_g", "_rank", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("before").alias("_before"), F.col("n").alias("_n")))
    spans = found.where("_lo < _hi").select("_g", "_lo", "_hi", "_before").distinct()
    inside = base.join(spans, "_g").where("_v >= _lo and _v <= _hi")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_g", "_before").orderBy("_v")) - 1
    values = inside.select("_g", "_v", rank.alias("_rank")).join(found.select("_g", "_rank"), ["_g", "_rank"], "left_semi")
    values = values.unionByName(found.where("_lo = _hi").select("_g", F.col("_lo").alias("_v"), "_rank"))
    near = asked.join(values, ["_g", "_rank"])
    part = F.max(pos - F.floor(pos))
    out = near.groupBy("_g", "share").agg(_between(part).alias("v"))
    return out.select(*(F.col("_g").getField(k).alias(k) for k in keys), "share", "v")


def _between(part: Column) -> Column:
    """Between the smaller and the larger of a group's values (infinite ones, too)."""
    low, high = F.min("_v"), F.max("_v")
    return F.when(low == high, low).otherwise(low + (high - low) * part)


def _sorted_quantiles(base: DataFrame, shares: list[float], keys: list[str]) -> DataFrame:
    """The same for any values ``_v``: they are sorted in ranges and the two rows on either side of a quantile picked by their places."""
    placed = numbered_rows(base.select(*keys, "_v"), [*keys, "_v"])
    ends = placed.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    at = F.explode(F.array(*map(F.lit, shares))).alias("share")
    asked = ends.select(*keys, "_first", "_n", at).withColumn("_pos", F.col("_first") + F.col("share") * (F.col("_n") - 1))
    near = F.explode(F.sequence(F.floor("_pos"), F.ceil("_pos"))).alias("_place")
    found = asked.select(*keys, "share", "_pos", near).join(placed.select("_place", "_v"), "_place")
    part = F.max(F.col("_pos") - F.floor("_pos"))
    return found.groupBy(*keys, "share").agg(_between(part).alias("v"))


def quantile_split(rows: DataFrame, columns: tuple[str, str, str], q: float = 0.9) -> DataFrame:
    """``rows`` with ``region``: which of the three columns lie above their ``q`` quantile, the others
    strictly below theirs (``high_`` and the names, joined by ``_and_``; ``none``); a value equal to its
    quantile, or missing, puts a row in no region (null)."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns))).alias("x")).select("x._c", "x._v")
    told = quantiles(long, "_v", [q], ["_c"]).agg(*(F.max(F.when(F.col("_c") == c, F.col("v"))).alias(f"_q_{c}") for c in columns))
    out = rows.crossJoin(F.broadcast(told))  # one row
    high = {c: F.col(c) > F.col(f"_q_{c}") for c in columns}
    low = {c: F.col(c) < F.col(f"_q_{c}") for c in columns}
    region = F.when(low[columns[0]] & low[columns[1]] & low[columns[2]], F.lit("none"))
    for n in (1, 2, 3):
        for some in combinations(columns, n):
            fits = F.lit(True)
            for c in columns:
                fits = fits & (high[c] if c in some else low[c])
            region = region.when(fits, F.lit("high_" + "_and_".join(some)))
    return out.withColumn("region", region).select(*rows.columns, "region")


def top_n(rows: DataFrame, n: int, value: str, columns: list[str]) -> DataFrame:
    """The ``n`` rows with the highest values, ascending; nulls out, ties by all columns."""
    ties = [F.desc(c) for c in columns if c != value]
    best = rows.select(*columns).where(F.col(value).isNotNull()).orderBy(F.desc(value), *ties).limit(n)
    return best.orderBy(value, *(c for c in columns if c != value))


def entropy(rows: DataFrame, count: str = "count") -> DataFrame:
    """``(n, h, h_norm)``: Shannon entropy (natural log) of counts, and over the log of their number."""
    from ..functions import entropy_term

    total = rows.agg(F.sum(count).alias("_t"))
    p = rows.where(F.col(count) > 0).crossJoin(F.broadcast(total)).withColumn("_p", F.col(count) / F.col("_t"))  # total: one row
    out = p.agg(F.count(F.lit(1)).alias("n"), F.sum(entropy_term(F.col("_p"))).alias("h"))
    return out.withColumn("h_norm", F.when(F.col("n") > 1, F.col("h") / F.ln("n")))
