"""Readers and writers of text formats. Every reader gives rows a place (``row_idx``) where the format's
order has a meaning: it is counted by file and split, as text files are read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as W


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in the folder that all executors share, which ``spark.checkpoint.dir`` names. Where
    that is unset a session on one machine, as in tests, gets a temporary folder; a cluster an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/weftline-{uuid.uuid4().hex}"


def saved(rows: DataFrame) -> DataFrame:
    """A table written to the shared folder and read from there: its plan ends, and it is there for
    every later use, whatever executor is lost."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered_rows(rows: DataFrame, order: list[str], place: str = "_place") -> DataFrame:
    """``rows`` with their places, from 1 on, in ``order`` (any keys that sort).

    Rows are dealt to ranges of the order, whatever its values, sorted there and written; a place is a
    row's number in its file plus the rows of the files before it, of which there is one count each. So
    no task gets more than its range."""
    path = shared_folder(rows.sparkSession)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    read = rows.sparkSession.read.schema(rows.schema).parquet(path)
    read = read.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = read.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    number = F.regexp_extract("_file", "^part-([0-9]+)", 1).cast("long")
    before = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return read.join(F.broadcast(counts), "_file").withColumn(place, F.col("_first") + F.col("_row") + 1).drop("_file", "_row", "_first")


def numbered_lines(spark: SparkSession, paths: str | list[str], line_sep: str | None = None) -> DataFrame:
    """``(row_idx, value)``: the lines (or records) of text files with their places, compressed or not.

    A place is a number within the split plus the lines of all splits before it; the counts by split
    are the only thing that is summed in one place."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    raw = reader.text(paths).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    counts = raw.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # sent, being a row for each split: else each line would be shuffled with its file's name, those of a split to one task
    return raw.join(F.broadcast(counts), ["_f", "_b"]).select((F.col("_i") - F.col("_first") + F.col("_before")).alias("row_idx"), "value")


def fields(column: str = "value") -> F.Column:
    """The fields of a line, at any white space."""
    return F.split(F.trim(F.regexp_replace(column, "\\s+", " ")), " ")


def read_maf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(block_id, score, components)`` of alignment files: a record begins with a line that begins with
    ``a``, so it does not matter how lines end and how many empty ones stand between. Lines other than
    those of components are left out, records without any, too."""
    records = numbered_lines(spark, paths, "\na").withColumn("_l", F.split("value", "\r?\n"))
    lines = F.filter("_l", lambda x: F.startswith(x, F.lit("s ")) | F.startswith(x, F.lit("s\t")))

    def part(line: F.Column) -> F.Column:
        f = F.split(F.trim(F.regexp_replace(line, "\\s+", " ")), " ")
        n = lambda k: f[k].cast("long")
        return F.struct(f[1].alias("src"), n(2).alias("start"), n(3).alias("size"), f[4].alias("strand"), n(5).alias("src_size"), F.coalesce(F.get(f, F.lit(6)), F.lit("")).alias("text"))

    score = F.regexp_extract(F.col("_l")[0], "\\bscore=([-+0-9.eE]+)", 1)
    out = records.select(F.col("row_idx").alias("block_id"), F.when(score != "", score.cast("double")).alias("score"), F.transform(lines, part).alias("components"))
    return out.where(F.size("components") > 0)


def maf_text(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``value``, a record of an alignment file."""
    line = lambda c: F.concat_ws(" ", F.lit("s"), c["src"], c["start"].cast("string"), c["size"].cast("string"), c["strand"], c["src_size"].cast("string"), c["text"])
    return blocks.withColumn("value", F.concat(F.lit("a\n"), F.array_join(F.transform("components", line), "\n"), F.lit("\n")))


def write_maf(blocks: DataFrame, path: str, by_source: bool = False, order: str = "block_id") -> None:
    """Write blocks; ``by_source`` gives a folder to each source of the first component."""
    rows = maf_text(blocks).withColumn("ref_src", F.get("components", F.lit(0))["src"])
    if by_source:
        rows.repartition("ref_src").sortWithinPartitions("ref_src", order).select("ref_src", "value").write.partitionBy("ref_src").text(path)
    else:
        rows.sortWithinPartitions(order).select("value").write.text(path)


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(rec_no, header, seq)``; the lines of a sequence are joined."""
    records = numbered_lines(spark, paths, "\n>").withColumn("_r", F.regexp_replace("value", "^>|\\r$", ""))
    lines = F.split("_r", "\r?\n")
    return records.where(F.trim("_r") != "").select(F.col("row_idx").alias("rec_no"), lines[0].alias("header"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("seq"))


def read_intervals(spark: SparkSession, paths: str | list[str], tabs: bool = False) -> DataFrame:
    """``(row_idx, chrom, start, end, label, strand)`` from lines of fields at white space (or at tabs);
    a label that is not there is empty, a strand ``+``. With ``tabs`` there is also ``rest``: the fields after
    the third as they stand, joined by tabs (null without any), so that a line can be written again whole."""
    lines = numbered_lines(spark, paths).where(F.trim("value") != "").where(~F.startswith("value", F.lit("#")))
    f = F.split("value", "\t") if tabs else fields()
    lines = lines.withColumn("_f", f)
    rest = [F.when(F.size("_f") > 3, F.array_join(F.slice("_f", F.lit(4), F.size("_f")), "\t")).alias("rest")] if tabs else []
    return lines.select("row_idx", F.col("_f")[0].alias("chrom"), F.col("_f")[1].cast("long").alias("start"), F.col("_f")[2].cast("long").alias("end"), F.coalesce(F.get("_f", F.lit(3)), F.lit("")).alias("label"), F.coalesce(F.get("_f", F.lit(4)), F.lit("+")).alias("strand"), *rest)


def read_partitions(spark: SparkSession, manifest: str) -> DataFrame:
    """``(ord, name, score, chrom, start, end)`` of the interval files that a manifest names, one to a
    line: name, score, file. The manifest is a few lines."""
    rows = [r["_f"] for r in numbered_lines(spark, manifest).where(F.trim("value") != "").select("row_idx", fields().alias("_f")).orderBy("row_idx").collect()]
    out = None
    for k, (name, score, path) in enumerate(rows):
        one = read_intervals(spark, path).select(F.lit(k).alias("ord"), F.lit(name).alias("name"), F.lit(score).alias("score"), "chrom", "start", "end")
        out = one if out is None else out.unionByName(one)
    return out


def read_mapping(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(key, symbol, line_no)``, one row for each key: the last line counts."""
    rows = numbered_lines(spark, paths).where(F.trim("value") != "").select("row_idx", fields().alias("_f"))
    rows = rows.select(F.col("_f")[0].alias("key"), F.col("_f")[1].alias("symbol"), F.col("row_idx").alias("line_no"))
    return rows.groupBy("key").agg(F.max_by("symbol", "line_no").alias("symbol"), F.max("line_no").alias("line_no"))


def read_distributions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(row_idx, label, count, p)``; comment lines are left out, and rows are counted without them."""
    rows = numbered_lines(spark, paths).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select("row_idx", fields().alias("_f"))
    return rows.select("row_idx", F.col("_f")[0].alias("label"), F.try_to_number(F.col("_f")[1], F.lit("9999999999999")).cast("long").alias("count"), F.slice("_f", F.lit(3), F.size("_f")).cast("array<double>").alias("p"))


def read_matrix(spark: SparkSession, paths: str | list[str], skip_rows: int = 0, skip_columns: int = 0, labelled: bool = False) -> DataFrame:
    """``(i, j, w)`` of a text matrix; ``labelled`` drops a first field that begins with ``V``."""
    rows = numbered_lines(spark, paths).where(F.trim("value") != "").where(F.col("row_idx") >= skip_rows).select((F.col("row_idx") - skip_rows).alias("i"), fields().alias("_f"))
    cells = F.slice("_f", F.lit(skip_columns + 1), F.size("_f"))
    if labelled:
        cells = F.when(F.startswith(F.col("_f")[0], F.lit("V")), F.slice("_f", F.lit(2), F.size("_f"))).otherwise(F.col("_f"))
    return rows.select(F.col("i").cast("int").alias("i"), F.posexplode(cells.cast("array<double>")).alias("j", "w"))


def matrix_text(matrix: DataFrame, labelled: bool = True) -> DataFrame:
    """``(i, value)``: rows of a square text matrix, cells with nine decimals at tabs, labels ``V`` and a
    number from 0 on. Cells that the matrix, in long form, does not have are 0, and so are whole rows, as a
    cell is read by its place."""
    n = matrix.agg((F.greatest(F.max("i"), F.max("j")) + 1).cast("int").alias("_n"))
    rows = matrix.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("_c"))
    every = n.select(F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"), "_n")
    # the rows are the whole matrix, however small the planner takes them to be
    rows = every.join(rows.hint("merge"), "i", "left").withColumn("_c", F.coalesce("_c", F.array().cast(rows.schema["_c"].dataType)))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    last = lambda k: F.coalesce(F.try_element_at("_c", k)["j"], F.lit(-1))
    some = F.flatten(F.transform("_c", lambda c, k: F.concat(zeros(c["j"] - F.when(k > 0, last(k)).otherwise(-1) - 1), F.array(c["w"]))))
    whole = F.concat(some, zeros(F.col("_n") - 1 - F.when(F.size("_c") > 0, last(F.size("_c"))).otherwise(-1)))
    cells = F.transform(whole, lambda w: F.format_string("%.9f", w))
    return rows.select("i", F.concat_ws("\t", F.format_string("V%d", "i"), cells).alias("value") if labelled else F.array_join(cells, "\t").alias("value"))


def read_int_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(seq_id, ints)``: a sequence of whole numbers to a line."""
    rows = numbered_lines(spark, paths)
    return rows.select(F.col("row_idx").alias("seq_id"), F.when(F.trim("value") == "", F.array().cast("array<int>")).otherwise(fields().cast("array<int>")).alias("ints"))


def read_merges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(stage, n_clusters, left, right, sim)``: a dendrogram, one merge to a line."""
    f = F.col("_f")
    rows = numbered_lines(spark, paths).where(F.trim("value") != "").select("row_idx", fields().alias("_f"))
    return rows.select((F.col("row_idx") + 1).cast("int").alias("stage"), f[0].cast("int").alias("n_clusters"), f[1].cast("int").alias("left"), f[2].cast("int").alias("right"), f[3].cast("double").alias("sim"))


def read_scores(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(row_idx, score)``; ``NA`` is null."""
    return numbered_lines(spark, paths).select("row_idx", F.when(F.trim("value") != "NA", F.trim("value")).cast("double").alias("score"))


def read_labelled_scores(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(row_idx, label, score)`` from lines of two fields; ``NA`` is null."""
    rows = numbered_lines(spark, paths).where(F.trim("value") != "").select("row_idx", fields().alias("_f"))
    return rows.select("row_idx", F.col("_f")[0].alias("label"), F.when(F.col("_f")[1] != "NA", F.col("_f")[1]).cast("double").alias("score"))


def zip_scores(**columns: DataFrame) -> DataFrame:
    """``row_idx`` and a column for each of the score vectors ``(row_idx, score)``, by place; as far as the
    shortest goes."""
    out = None
    for name, scores in columns.items():
        one = scores.select("row_idx", F.col("score").alias(name))
        out = one if out is None else out.join(one, "row_idx")
    return out


def prefix_lines(lines: DataFrame, prefix: str, column: str = "value") -> DataFrame:
    """Lines with ``prefix`` before each."""
    return lines.withColumn(column, F.concat(F.lit(prefix), column))


def without_missing(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines in which ``NA`` stands nowhere."""
    return lines.where(~F.contains(column, F.lit("NA")))


def last_path(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """Of the files of a folder whose names match, the one that comes last by name (of numbered results
    the best); none of none. Only names are looked at."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.agg(F.max("path")).first()[0]


def read_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(row_idx, label)``: a label to a line."""
    return numbered_lines(spark, paths).select("row_idx", F.trim("value").alias("label"))


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header, fields at tabs, ``NA`` for null."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA", schema=schema)


def write_features(rows: DataFrame, path: str) -> None:
    """A table as above, unquoted."""
    rows.write.csv(path, sep="\t", header=True, quote="", nullValue="NA")


def read_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """``(name, build, chrom, size, fname)`` from fields at commas."""
    return spark.read.csv(path, schema="name string, build string, chrom string, size long, fname string")


def read_nib(spark: SparkSession, folder: str, tile: int = 65_536) -> DataFrame:
    """``(chrom, tile_no, seq)`` of packed sequence files ``<chrom>.nib``; see ``packed`` for readers of ranges and the writer."""
    from .packed import read_packed

    return read_packed(spark, folder, tile)


def write_lines(rows: DataFrame, path: str, columns: list[str], sep: str = " ", compression: str = "none") -> None:
    """Rows as lines of text, fields joined by ``sep``; null is ``NA``. ``compression``: gzip, bzip2 or none."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]
    rows.select(F.concat_ws(sep, *cells).alias("value")).write.option("compression", compression).text(path)


def statistics_text(counts: DataFrame, species: list[str], length: int, alphabet: str = W.ALPHABET) -> DataFrame:
    """``(ord, value)``: the lines of a file of sufficient statistics: seven head lines, an empty one and
    the rows ``i key count``."""
    n = counts.agg(F.count(F.lit(1)).alias("n"))
    heads = ["NSEQS = %d" % len(species), f"LENGTH = {length}", "TUPLE_SIZE = 1", None, f"NAMES = {','.join(species)}", f"ALPHABET = {alphabet}", "NCATS = -1", ""]
    table = F.array(*(F.concat(F.lit("NTUPLES = "), F.col("n").cast("string")) if h is None else F.lit(h) for h in heads))
    head = n.select(F.posexplode(table).alias("k", "value")).select((F.col("k") - len(heads)).cast("long").alias("ord"), "value")
    return head.unionByName(counts.select(F.col("i").cast("long").alias("ord"), F.concat_ws("\t", "i", "key", "count").alias("value")))


def write_statistics(counts: DataFrame, species: list[str], length: int, folder: str, name: str, alphabet: str = W.ALPHABET) -> None:
    """The lines of ``statistics_text`` as one file ``name`` in ``folder``."""
    from .files import write_whole

    write_whole(statistics_text(counts, species, length, alphabet).withColumn("file", F.lit(name)), folder)


def write_tracks(scores: DataFrame, folder: str, name: str, step: int = 1) -> None:
    """A wiggle file for each chromosome of ``(chrom, pos, score)``, called as it, with ``.wig`` behind: a line that describes the track, then, for each stretch of
    positions next to each other (``step`` apart), a line that says where it begins (from 1 on) and its scores. Null scores end a stretch."""
    from .files import Part, write_whole

    rows = scores.where("score is not null").select("chrom", F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score"))
    # a stretch begins where the position before is not there; each position looks one step back
    before = rows.select("chrom", (F.col("pos") + step).alias("pos"), F.lit(True).alias("_on")).distinct()
    rows = rows.join(before, ["chrom", "pos"], "left")
    begins = F.concat(F.lit("fixedStep chrom="), "chrom", F.lit(" start="), (F.col("pos") + 1).cast("string"), F.lit(f" step={step}"))
    lines = rows.select("chrom", "pos", F.lit(1).alias("k"), F.col("score").cast("string").alias("value")).unionByName(rows.where("_on is null").select("chrom", "pos", F.lit(0).alias("k"), begins.alias("value")))
    heads = rows.select("chrom").distinct().select("chrom", F.lit(None).cast("long").alias("pos"), F.lit(0).alias("k"), F.concat(F.lit(f"track type=wiggle_0 name={name}."), "chrom").alias("value"))
    write_whole(heads.unionByName(lines).withColumn("file", F.concat("chrom", F.lit(".wig"))), folder, Part(order=("pos", "k")))


def wiggle_text(scores: DataFrame, chrom: str, start: int = 1, step: int = 1) -> DataFrame:
    """``(ord, value)``: the lines of a track: its head, then a score to a line, in order."""
    head = scores.sparkSession.range(1).select(F.lit(-1).cast("long").alias("ord"), F.lit(f"fixedStep chrom={chrom} start={start} step={step}").alias("value"))
    return head.unionByName(scores.select(F.col("row_idx").cast("long").alias("ord"), F.coalesce(F.col("score").cast("string"), F.lit("NA")).alias("value")))
