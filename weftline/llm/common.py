"""What the operators of this subpackage share: the shared folder, word hashes, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the folder that all executors share.

    The session's ``spark.checkpoint.dir`` names it. Where that is unset a session on one machine, as in
    tests, gets a temporary folder; on a cluster there is no such folder, and this raises.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
            top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/weftline-{uuid.uuid4().hex}"


#: The tables saved within ``settled``.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts lineage and keeps a result that
    is used more than once, and a lost executor takes none of it away."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    made = _MADE.get()
    if made is not None:
        made.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "saved_at", None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` describes, saved; what was saved on the way to it is deleted."""
    outer = _MADE.set([])
    try:
        out = saved(make())
        dropped(*(t for t in _MADE.get() if t is not out))
    finally:
        _MADE.reset(outer)
    return out


def packed_row(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows of ``docs`` as one column ``row``, and columns computed from them: whatever the columns of
    ``docs`` are called, they don't clash with others."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), *(c.alias(name) for name, c in more.items()))


def unpacked_row(rows: DataFrame, docs: DataFrame, **added: str | Column) -> DataFrame:
    """The columns of ``docs`` again, and those added; one of ``docs`` that is called as an added one goes."""
    new = {name.lower() for name in added}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in new]
    return rows.select(*kept, *((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in added.items()))


def crc_text(column: str) -> F.Column:
    """crc32 of a key written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


class WordHash(dict):
    """64-bit hashes of words, kept for the words met lately."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of a text's words."""
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def joined(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of pairs of hashes, order included."""
    return mixed(a * np.uint64(0xD6E8FEB86659FD93 + 2 * seed) + mixed(b + np.uint64(0x2545F4914F6CDD1D + seed)))


def batches(schema: pa.Schema, rows: Iterator[dict], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Gather dicts of equally long columns to batches of about ``size`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for columns in rows:
        batch = pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= size:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
