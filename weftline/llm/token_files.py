"""Token-id files: blocks of ids as bit or byte planes, each plane compressed, with a chunk index.

A file holds the documents of one range of keys in ascending order:

    magic ``WTPL0001``
    chunks: for each block of ``block_ids`` ids its planes, one after the other, each compressed with
        zstandard (a plane of zeros takes no bytes); after them the block of document ends (keys,
        flags of null keys and id counts of the documents that end in the block), compressed
    index: JSON, compressed: for each chunk its place, the lengths of its parts, its number of ids,
        its first id's number in the file and its number of documents; the plane kind; totals
    the index's length (8 bytes, little-endian), magic

A reader takes the last bytes, the index, and then any chunk on its own.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches
from .tokens import encoder, tokenizer_path

MAGIC = b"WTPL0001"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block: 32 of bits or 4 of bytes, lowest first; empty where all are zero."""
    columns = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [c.tobytes() if c.any() else b"" for c in columns]
    out = []
    for column in columns:
        used = np.bitwise_or.reduce(column) if len(column) else 0
        out += [np.packbits(column >> k & 1).tobytes() if used >> k & 1 else b"" for k in range(8)]
    return out


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block of ``n``."""
    columns = np.zeros((4, n), np.uint8)
    for k, plane in enumerate(planes):
        if plane and kind == "byte":
            columns[k] = np.frombuffer(plane, np.uint8)
        elif plane:
            columns[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << np.uint8(k % 8)
    return np.ascontiguousarray(columns.T).view("<u4").ravel()


class PlaneWriter:
    """Writes one file to a binary stream, a block at a time."""

    def __init__(self, out: io.RawIOBase, kind: str = "byte", block_ids: int = 65536, level: int = 3) -> None:
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.press = zstandard.ZstdCompressor(level=level)
        self.chunks: list[dict] = []
        self.at, self.ids, self.n_docs = len(MAGIC), 0, 0
        self.held: list[bytes] = []
        self.held_ids = 0
        self.ends: list[tuple[int | None, int, int]] = []  # key, number of ids, ids held when it ended
        out.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        """A document with its ids as little-endian 32-bit bytes."""
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        self.ends.append((key, len(ids) // 4, self.held_ids))
        if self.held_ids >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        raw, done = b"".join(self.held), 0
        while self.held_ids - done >= self.block_ids or (last and (done < self.held_ids or (done == 0 and self.ends))):
            n = min(self.block_ids, self.held_ids - done)
            ids = np.frombuffer(raw, "<u4", n, 4 * done)
            parts = [self.press.compress(p) if p else b"" for p in to_planes(ids, self.kind)]
            ended = [e for e in self.ends if e[2] <= done + n]
            self.ends = self.ends[len(ended) :]
            keys = np.array([0 if k is None else k for k, _, _ in ended], "<i8").tobytes() + np.array([k is None for k, _, _ in ended], np.uint8).tobytes() + np.array([n_ids for _, n_ids, _ in ended], "<i8").tobytes()
            parts.append(self.press.compress(keys))
            self.chunks.append({"at": self.at, "parts": [len(p) for p in parts], "ids": n, "first": self.ids, "docs": len(ended)})
            for p in parts:
                self.out.write(p)
                self.at += len(p)
            self.ids += n
            self.n_docs += len(ended)
            done += n
            if last and done >= self.held_ids:
                break
        self.held = [raw[4 * done :]] if 4 * done < len(raw) else []
        self.held_ids -= done
        self.ends = [(k, n_ids, e - done) for k, n_ids, e in self.ends]

    def close(self) -> None:
        """The rest, the index and the end; the stream stays open."""
        if self.held_ids or self.ends:
            self._flush(True)
        index = self.press.compress(json.dumps({"kind": self.kind, "ids": self.ids, "docs": self.n_docs, "chunks": self.chunks}).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


def read_index(source, size: int) -> dict:  # noqa: ANN001
    """The chunk index of a file that can be sought."""
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token-plane file, or one cut short")
    n = int.from_bytes(tail[:8], "little")
    source.seek(size - 16 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))


def read_chunk(source, chunk: dict, kind: str) -> tuple[np.ndarray, list[int | None], np.ndarray]:  # noqa: ANN001
    """A chunk's ids, and the keys and id counts of the documents that end in it."""
    source.seek(chunk["at"])
    open_ = zstandard.ZstdDecompressor()
    parts = [open_.decompress(source.read(n)) if n else b"" for n in chunk["parts"]]
    n, docs = chunk["ids"], parts.pop()
    m = chunk["docs"]
    keys = np.frombuffer(docs, "<i8", m).tolist()
    nulls = np.frombuffer(docs, np.uint8, m, 8 * m)
    keys = [None if z else k for k, z in zip(keys, nulls, strict=True)]
    return from_planes(parts, n, kind), keys, np.frombuffer(docs, "<i8", m, 9 * m)


def _file_system(folder: str):  # noqa: ANN202
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + unquote(folder.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    kind: str = "word",
    end_id: int = 1,
    planes: str = "byte",
    block_ids: int = 65536,
    files: int | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Encode whole texts and write them to token files in ``folder``, in ascending order of ``key``.

    Documents are dealt to ranges of keys (ties by a hash of the text, so that a key with very many
    rows is split too), ``files`` of them if given, else as Spark sizes its partitions; each task writes the file of its range under a name of its own try and then
    renames it, so that a task that runs again leaves a whole file. ``folder`` has to be a place
    that every executor can write to. Returns one row for each file: ``(file_no, ids, docs)``; it
    runs when it is read, so read it once.

    A null text is empty (its document is the end id alone); a null key comes first. Repeated rows
    are written each. An empty table writes no documents.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    store, top = _file_system(folder)
    store.create_dir(top, recursive=True)  # an empty table has no task that would
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    tie = F.xxhash64("t")
    order = [F.col("k").asc_nulls_first(), tie]
    rows = (rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)).sortWithinPartitions(F.col("k").asc_nulls_first(), tie, "t")
    schema = pa.schema([("file_no", pa.int64()), ("ids", pa.int64()), ("docs", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, enc, end = task.partitionId(), encoder(path, kind), np.array([end_id], "<u4").tobytes()
        store, top = _file_system(folder)
        store.create_dir(top, recursive=True)
        own = f"{top}/.{number:06d}.{task.taskAttemptId()}"
        with store.open_output_stream(own) as out:
            to = PlaneWriter(out, planes, block_ids)
            for part in parts:
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    for k, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                        to.add(k, ids + end)
            to.close()
        store.move(own, f"{top}/{number:06d}.planes")
        yield from batches(schema, iter([{"file_no": [number], "ids": [to.ids], "docs": [to.n_docs]}]))

    return rows.mapInArrow(run, "file_no long, ids long, docs long")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder of token files, from the files alone:
    ``(doc_id, start, n_tokens, ids)``; ``start`` counts all ids before it, ``ids`` are bytes.

    Two passes: one over the indexes, whose totals (one row for each file) give each file's first
    number; one over the chunks, of which a task holds one at a time and the document it is in.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(folder).select("path", "length")
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    totals = pa.schema([("path", pa.string()), ("length", pa.int64()), ("ids", pa.int64())])

    def indexes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            paths, lengths, ids = part.column(0).to_pylist(), part.column(1).to_pylist(), []
            for p, n in zip(paths, lengths, strict=True):
                store, at = _file_system(p)
                with store.open_input_file(at) as source:
                    ids.append(read_index(source, n)["ids"])
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(ids, pa.int64())], schema=totals)

    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for part in parts:
                for p, n, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    store, at = _file_system(p)
                    with store.open_input_file(at) as source:
                        index, rest = read_index(source, n), b""
                        for chunk in index["chunks"]:
                            ids, keys, counts = read_chunk(source, chunk, index["kind"])
                            raw, done = rest + ids.tobytes(), 0
                            cols: dict[str, list] = {"doc_id": keys, "start": [], "n_tokens": counts.tolist(), "ids": []}
                            for m in cols["n_tokens"]:
                                cols["start"].append(first)
                                cols["ids"].append(raw[done : done + 4 * m])
                                first, done = first + m, done + 4 * m
                            rest = raw[done:]
                            yield cols

        yield from batches(schema, each(), 1_000)

    # file names are numbers of ranges, in order of keys; one row for each file
    files = found.mapInArrow(indexes, "path string, length long, ids long")
    # a number of more digits than the others is the longer name
    before = Window.orderBy(F.length("path"), "path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", "length", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    # as many partitions as there are files: a number of its own, which is not folded into fewer
    return files.repartitionByRange(max(1, found.count()), "path").mapInArrow(chunks, out)
