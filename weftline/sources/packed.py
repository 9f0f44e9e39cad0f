"""Packed sequence files ``<chrom>.nib``, two bases a byte: written whole, read by ranges.

A file is a head of 8 bytes (the magic number, the number of bases) and a half byte for each base, the high half first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import file_system, write_whole

# fixed values: the magic number, the bases by code and the bit of a masked (lower-case) base
MAGIC, LETTERS, MASKED = 0x6BE93D3A, b"TCAGN", 8

#: How many bases a reader holds at once, and how many at least are a task's work.
BATCH, LEAST = 1_048_576, 4_194_304


def packed_bytes(text: bytes) -> bytes:
    """Bases as half bytes; of an odd number the last half is 0. What is no base is N."""
    table = np.full(256, LETTERS.index(b"N"), np.uint8)
    for code, letter in enumerate(LETTERS):
        table[letter], table[ord(chr(letter).lower())] = code, code | MASKED
    codes = table[np.frombuffer(text, np.uint8)]
    codes = np.concatenate([codes, np.zeros(len(codes) % 2, np.uint8)])
    return (codes[::2] << 4 | codes[1::2]).tobytes()


def unpacked_bases(data: bytes, skip: int, n: int) -> str:
    """``n`` bases from the ``skip``-th half byte on, in capitals."""
    packed = np.frombuffer(data, np.uint8)
    codes = np.stack([packed >> 4, packed & 15], axis=1).ravel()[skip : skip + n] & 7
    return np.frombuffer(LETTERS, np.uint8)[np.minimum(codes, len(LETTERS) - 1)].tobytes().decode()


class Store:
    """The files of a folder, each opened once in a task; counts the bytes that are read of them."""

    def __init__(self, folder: str) -> None:
        self.store, self.top = file_system(folder)
        self.open: dict[str, tuple] = {}
        self.bytes = 0

    def length(self, chrom: str) -> int:
        """How many bases a file has; -1 if there is none."""
        from pyarrow import fs

        if chrom not in self.open:
            path = f"{self.top}/{chrom}.nib"
            if "/" in chrom or self.store.get_file_info(path).type != fs.FileType.File:
                self.open[chrom] = (None, -1)
            else:
                source = self.store.open_input_file(path)
                head = np.frombuffer(source.read_at(8, 0), "<u4")
                self.bytes += 8
                if len(head) < 2 or head[0] != MAGIC:
                    raise ValueError(f"{path} is no packed sequence file")
                self.open[chrom] = (source, int(head[1]))
            if len(self.open) > 64:  # no more files are open at once
                first = next(iter(self.open))
                if self.open[first][0] is not None:
                    self.open[first][0].close()
                del self.open[first]
        return self.open[chrom][1]

    def bases(self, chrom: str, start: int, end: int) -> str | None:
        """The bases of a range, clipped to what is there; null without a file. Only the bytes that hold them are read."""
        n = self.length(chrom)
        if n < 0:
            return None
        start, end = max(0, start), min(end, n)
        if start >= end:
            return ""
        low, high = start // 2, (end + 1) // 2
        self.bytes += high - low
        return unpacked_bases(self.open[chrom][0].read_at(high - low, 8 + low), start % 2, end - start)


class Tiles(InputPartition):
    def __init__(self, chrom: str, first: int, last: int) -> None:
        self.chrom, self.first, self.last = chrom, first, last


class PackedReader(DataSourceReader):
    """Tiles of the files of a folder. Conditions on ``chrom`` and ``tile_no`` decide which files are opened and which bytes are read."""

    def __init__(self, folder: str, tile: int, run: int) -> None:
        self.folder, self.tile, self.run = folder, tile, run
        self.chroms: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("chrom",) and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = asked if self.chroms is None else self.chroms & asked
            elif name == ("tile_no",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """``run`` tiles at a time, or as many as have ``LEAST`` bases: tasks don't grow in number with tiles that are short; only heads are read."""
        from pyarrow import fs

        store = Store(self.folder)
        found = store.store.get_file_info(fs.FileSelector(store.top, allow_not_found=True))
        names = sorted(f.base_name.removesuffix(".nib") for f in found if f.base_name.endswith(".nib") and not f.base_name.startswith("."))
        out, run = [], max(self.run, LEAST // self.tile)
        for chrom in names if self.chroms is None else [c for c in names if c in self.chroms]:
            last = -(-store.length(chrom) // self.tile)
            last = last if self.high is None else min(last, self.high)
            out += [Tiles(chrom, at, min(at + run, last)) for at in range(self.low, last, run)]
        return out or [Tiles("", 0, 0)]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        """About ``BATCH`` bases are read at a time and cut into tiles."""
        store, many = Store(self.folder), max(1, BATCH // self.tile)
        names = ["chrom", "tile_no", "seq"]
        for first in range(partition.first, partition.last, many):
            last = min(first + many, partition.last)
            text = store.bases(partition.chrom, first * self.tile, last * self.tile)
            ends = np.minimum(np.arange(last - first + 1, dtype=np.int64) * self.tile, len(text)).astype(np.int32)
            seqs = pa.StringArray.from_buffers(last - first, pa.py_buffer(ends), pa.py_buffer(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(partition.chrom), last - first), pa.array(np.arange(first, last, dtype=np.int64)), seqs], names=names)


class Packed(DataSource):
    """``packed_sequences``: ``(chrom, tile_no, seq)`` of the packed sequence files of the folder that ``path`` names, in tiles of ``tile`` bases, ``run`` of which
    are a task's work (more, if they are short)."""

    @classmethod
    def name(cls) -> str:
        return "packed_sequences"

    def schema(self) -> str:
        return "chrom string, tile_no bigint, seq string"

    def reader(self, schema) -> PackedReader:  # noqa: ANN001
        return PackedReader(self.options["path"], int(self.options.get("tile", 65_536)), int(self.options.get("run", 64)))


def read_packed(spark: SparkSession, folder: str, tile: int = 65_536, run: int = 64) -> DataFrame:
    """The tiles of a folder of packed sequence files (``Packed``); conditions on ``chrom`` and ``tile_no`` reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Packed)
    return spark.read.format("packed_sequences").option("tile", tile).option("run", run).load(folder)


def fetch_packed(intervals: DataFrame, folder: str) -> DataFrame:
    """``intervals`` with ``seq``, the bases of each on its chromosome (in capitals; null without a file, clipped to its length), and ``bytes``, what was read for
    it. Intervals are put in order of places by ranges, so tasks share a busy chromosome, and each reads the bytes of its intervals and the heads of their files, nothing else."""
    kept = F.struct(*(F.col(f"`{c}`") for c in intervals.columns))
    rows = intervals.select(kept.alias("row"), F.col("chrom").alias("chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    rows = rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end")

    @F.arrow_udf("struct<seq:string,bytes:bigint>")
    def fetched(chroms: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        store, out = Store(folder), []
        for chrom, start, end in zip(chroms.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            before = store.bytes
            seq = None if chrom is None or start is None or end is None else store.bases(chrom, start, end)
            out.append({"seq": seq, "bytes": store.bytes - before})
        return pa.array(out, pa.struct([("seq", pa.string()), ("bytes", pa.int64())]))

    rows = rows.select("row", fetched("chrom", "start", "end").alias("f"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in intervals.columns), "f.seq", "f.bytes")


def write_packed(tiles: DataFrame, folder: str) -> None:
    """``<chrom>.nib`` for each chromosome of ``(chrom, tile_no, seq)``: its tiles in order, one file (``write_whole``). Every tile but the last of a file
    has an even number of bases, as two share a byte; others are an error."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else packed_bytes(t.encode()) for t in texts.to_pylist()], pa.binary())

    sizes = tiles.groupBy("chrom").agg(F.sum(F.length("seq")).alias("n"), F.max("tile_no").alias("last"))
    odd = tiles.join(sizes, "chrom").where((F.length("seq") % 2 == 1) & (F.col("tile_no") < F.col("last")))
    if odd.limit(1).count():
        raise ValueError("a tile before the last has an odd number of bases")
    number = lambda n: F.unhex(F.concat(*(F.lpad(F.hex(F.floor(n / 256**k) % 256), 2, "0") for k in range(4))))
    heads = sizes.select("chrom", F.lit(-1).cast("long").alias("ord"), F.concat(number(F.lit(MAGIC)), number(F.col("n"))).alias("value"))
    bodies = tiles.select("chrom", F.col("tile_no").cast("long").alias("ord"), packed("seq").alias("value"))
    write_whole(heads.unionByName(bodies).withColumn("file", F.concat("chrom", F.lit(".nib"))), folder)
