"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches
from .tokens import encoder, tokenizer_path

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
_CUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PACKED = _CUT.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


class CapacityTree:
    """A tournament tree over the free room of bins: each inner node holds the larger of its two
    children, so the first bin with room for an item is found, and its room changed, in log(bins)."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The leftmost bin with room for ``size``, which it then holds."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_ = at - self.leaves
        room[at] -= size
        at //= 2
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at //= 2
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (sizes from 1 to ``capacity``): items by decreasing size, ties in the
    given order, each into the first bin that has room."""
    tree = CapacityTree(max(1, len(sizes)), capacity)
    bins = np.zeros(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        bins[k] = tree.place(int(sizes[k]))
    return bins


def plan_group(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, bin, offset)`` of a group's items.

    After first-fit decreasing, the emptiest bins are dealt out, cut where needed, over the room that
    is left in the fullest ones, until one bin at most is part filled; that one is cut into bins whose
    lengths are powers of two, which need no padding.
    """
    if not len(sizes):
        return []
    held: dict[int, list[tuple[int, int, int]]] = {}
    for item, bin_ in enumerate(first_fit_decreasing(sizes, capacity).tolist()):
        held.setdefault(bin_, []).append((item, 0, int(sizes[item])))
    filled = {b: sum(p[2] for p in pieces) for b, pieces in held.items()}
    order = sorted((b for b in held if filled[b] < capacity), key=lambda b: (-filled[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        to, giver = order[low], order[high]
        room = capacity - filled[to]
        item, start, length = held[giver].pop()
        moved = min(room, length)
        held[to].append((item, start, moved))
        if moved < length:
            held[giver].append((item, start + moved, length - moved))
        filled[to] += moved
        filled[giver] -= moved
        low += filled[to] == capacity
        high -= filled[giver] == 0
    out: list[tuple[int, int, int, int, int]] = []
    bin_ = 0
    for b in sorted(held):
        total = filled[b]
        if not total:
            continue
        ends = [total] if total == capacity else [1 << k for k in reversed(range(total.bit_length())) if total >> k & 1]
        at, end = 0, ends.pop(0)
        for item, start, length in held[b]:
            while length:
                part = min(length, end - at)
                out.append((item, start, part, bin_, at))
                item, start, length, at = item, start + part, length - part, at + part
                if at == end:
                    bin_, at = bin_ + 1, 0
                    end = ends.pop(0) if ends else 0
    return out


def cut_documents(docs: DataFrame, path: str, kind: str, end_id: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token ids of every document with ``end_id`` after them, cut to pieces of ``capacity`` ids and
    a rest; ids as little-endian numbers of ``width`` bytes. A null text is empty: its document is
    the end id alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, kind), np.array([end_id], "<u4").tobytes()
        narrow = max(enc.largest, end_id) < 1 << 16  # then two bytes an id are shuffled, not four

        def each() -> Iterator[dict]:
            for part in parts:
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    cols: dict[str, list] = {f.name: [] for f in _CUT}
                    for k, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                        ids += end
                        n, width = len(ids) // 4, 4
                        if narrow:
                            ids, width = np.frombuffer(ids, "<u4").astype("<u2").tobytes(), 2
                        for start in range(0, n, capacity):
                            piece = ids[width * start : width * (start + capacity)]
                            for name, value in zip(cols, (k, start, len(piece) // width, n, piece), strict=True):
                                cols[name].append(value)
                    yield cols

        yield from batches(_CUT, each(), 4_000)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    kind: str = "byte",
    end_id: int = 0,
    capacity: int = 1024,
    group_pieces: int = 8192,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Pieces of sequences: ``(doc_id, start, length, doc_tokens, ids, sequence_id, offset)``.

    Every id of every document (its text's ids by the tokenizers library, then ``end_id``) lies in one
    piece; the pieces of a sequence are gapless from offset 0 and hold at most ``capacity`` ids.
    Pieces are dealt at random (by a hash of key, start and ids, so that reruns agree, copies of a page under many keys
    part and so do many pages of one key) and packed in groups
    of at most ``group_pieces``, each on its own: full pieces are sequences as they are, the rest goes
    by first-fit decreasing over a tournament tree. A task holds one group at a time, however many
    pieces it gets, so a key that has very many rows only adds groups.

    Nulls: a null text is empty, so its document is one id; a null key stays null. Repeated rows are
    packed each. An empty table gives no rows. ``docs`` may have any other columns; they are not read.
    """
    pieces = cut_documents(docs, path or tokenizer_path("byte_bpe_50k.json"), kind, end_id, capacity, text, key)
    dealt = pieces.withColumn("_r", F.xxhash64("doc_id", "start", "doc_tokens", F.crc32("ids")))
    dealt = dealt.repartition(F.col("_r")).sortWithinPartitions("_r", "doc_id", "start", "ids").drop("_r")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, group = TaskContext.get().partitionId() << 40, 0
        held: list[pa.RecordBatch] = []

        def pack(table: pa.Table) -> dict:
            nonlocal group
            doc_id, start, n, ids = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
            sizes = table.column("length").to_numpy()
            cols: dict[str, list] = {f.name: [] for f in _PACKED}
            first = base + (group << 20)
            group += 1
            full, rest = np.flatnonzero(sizes == capacity).tolist(), np.flatnonzero(sizes != capacity).tolist()
            placed = [(item, 0, capacity, bin_, 0) for bin_, item in enumerate(full)]
            placed += [(rest[k], at, length, len(full) + bin_, offset) for k, at, length, bin_, offset in plan_group(sizes[rest], capacity)]
            for item, at, length, bin_, offset in placed:
                width = len(ids[item]) // int(sizes[item])
                part = ids[item][width * at : width * (at + length)]
                part = part if width == 4 else np.frombuffer(part, "<u2").astype("<u4").tobytes()
                row = (doc_id[item], start[item] + at, length, n[item], part, first + bin_, offset)
                for name, value in zip(cols, row, strict=True):
                    cols[name].append(value)
            return cols

        def each() -> Iterator[dict]:
            rows = 0
            for part in parts:
                while part.num_rows:
                    some = part.slice(0, group_pieces - rows)
                    held.append(some)
                    rows += some.num_rows
                    part = part.slice(some.num_rows)
                    if rows == group_pieces:
                        yield pack(pa.Table.from_batches(held))
                        held.clear()
                        rows = 0
            if held:
                yield pack(pa.Table.from_batches(held))
                held.clear()

        yield from batches(_PACKED, each(), 4_000)

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema)
