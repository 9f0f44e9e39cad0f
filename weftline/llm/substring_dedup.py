"""Removing repeated passages: a Relative Lempel-Ziv parse of documents against all earlier text.

The reference is the corpus itself, indexed in blocks. A block is a stretch of 20 to 32 words around
an anchor: the smallest hash of 8 words among those in a window of 20. Any two equal windows
have the same anchor at the same place, so equal text is cut into equal blocks wherever it stands, and
an anchor is a seed that leads from a document to the places of the reference.

1. **Index.** Each block of each document is looked up among all blocks of the corpus by its anchor and
   its words; one with an earlier equal gets the first place where it stands.
2. **Boundaries.** A block that is the first of its kind is where factors begin or end. If its anchor
   stands in other blocks too, a factor may still reach into it: its windows are looked up one by one,
   among those of all such blocks, and get their first places. Anchors in many texts (``hot_anchors``)
   are taken to stand in others, so that no task gets all blocks of a common phrase.
3. **Factors.** Each document is then parsed from left to right: a factor copies words from one place of the
   reference and goes on as long as the next block or window stands right there, too. Factors of
   at least a window's words are the duplicate spans.

Together this finds every window of 20 words that starts anywhere earlier, and nothing else: every window
lies in one block, which either has an earlier equal, or has its windows looked up, or has an anchor that
stands nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, joined, mixed, packed_row, saved, unpacked_row, word_hashes

ANCHOR = 8


def _hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all stretches of ``n`` words, by doubling."""
    level, length, out, done = mixed(words + np.uint64(seed)), 1, None, 0
    while True:
        if n & length:
            out = level if out is None else joined(out[: len(level) - done], level[done : done + len(out)], seed + length)
            done += length
        if 2 * length > n:
            break
        level = joined(level[:-length], level[length:], seed + length)
        length *= 2
    return out[: max(0, len(words) - n + 1)]


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The place of the first smallest of each ``n`` values in a row."""
    at = np.arange(len(values))
    length, out, done = 1, None, 0
    while True:
        if n & length:
            if out is None:
                out = at
            else:
                m = min(len(out), len(at) - done)
                a, b = out[:m], at[done : done + m]
                out = np.where(values[b] < values[a], b, a)
            done += length
        if 2 * length > n:
            break
        a, b = at[:-length], at[length:]
        at = np.where(values[b] < values[a], b, a)
        length *= 2
    return out[: max(0, len(values) - n + 1)]


def parse(words: np.ndarray, window: int = 20) -> tuple[np.ndarray, ...]:
    """The blocks of a document's word hashes: hash of the anchor, two hashes of the block, its first
    window and how many windows it has."""
    none = np.empty(0, np.uint64)
    if len(words) < window:
        return none, none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    anchors = _hashes(words, ANCHOR, 11)
    place = _smallest(anchors, window - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    span = (last - first).astype(np.uint64)
    # two windows that overlap cover the block, so their hashes and their distance stand for it
    ids = [joined(joined(h[first], h[last], 5), span, 6) for h in (_hashes(words, window, 21), _hashes(words, window, 22))]
    return anchors[place[first]], *ids, first, last - first + 1


def _firsts(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their key, by ``order`` (rows equal in both are first together), and a
    first row for each."""
    rank = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.ones(len(rank), bool)
    if len(rank) > 1:
        new[1:] = np.any([k[rank][1:] != k[rank][:-1] for k in keys], axis=0)
    lead = rank[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out, first = np.zeros(len(rank), bool), np.zeros(len(rank), np.int64)
    out[rank] = np.all([o[rank] == o[lead] for o in order], axis=0)
    first[rank] = lead
    return out, first


_ROW = [("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("doc", pa.int64()), ("place", pa.int64()), ("mark", pa.int32()), ("src", pa.int64()), ("from", pa.int32())]
#: What is shuffled of a block: ``place`` is the hash of the text, then the word where the block begins; ``mark`` its number of
#: windows (a block has no more than a window has words), and two bits; ``src`` and ``from`` are 0 where nothing is known yet. Of the second
#: hash 32 bits go along: with the first one's 64 and an anchor in common, of 1e12 blocks two different ones are taken for one with a chance of about 1e-5.
_SHAPE = "key long, h1 long, h2 int, doc long, place long, mark int, src long, from int"
_KNOWN, _HOT = 1 << 30, 1 << 29


def _folded(found: Callable, hot: np.ndarray | None = None, held_rows: int = 1_000_000) -> Callable:
    """A task that gathers rows and settles, before anything is shuffled, which of them repeat an
    earlier row of the same task: those are known, with its place, and get a key of their own that
    spreads them. Rows with a key of ``hot`` (sorted) are marked and spread by their first hash, by which equal
    rows still meet."""
    schema = pa.schema(_ROW)
    hot = np.empty(0, np.uint64) if hot is None else hot

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def settle() -> Iterator[pa.RecordBatch]:
            key, h1, h2, doc, th, at, size = (np.concatenate(c) for c in zip(*held, strict=True))
            place = (th.astype(np.int64) << 32) | at.astype(np.int64)
            h2 = (h2 >> np.uint64(32)).astype(np.uint32)
            first, lead = _firsts([h1, h2], [doc, place])
            is_hot = np.isin(key, hot)
            key = np.where(is_hot, mixed(h1), key)
            key = np.where(first, key.view(np.int64), mixed(doc.view(np.uint64) * np.uint64(31) + at.astype(np.uint64)).view(np.int64))
            mark = size.astype(np.int64) + np.where(first, 0, _KNOWN) + np.where(is_hot, _HOT, 0)
            src, from_ = np.where(first, 0, doc[lead]), np.where(first, 0, at[lead])
            columns = (key, h1.view(np.int64), h2.view(np.int32), doc, place, mark.astype(np.int32), src, from_.astype(np.int32))
            for k in range(0, len(key), 50_000):
                yield pa.record_batch([pa.array(c[k : k + 50_000]) for c in columns], schema=schema)

        for part in parts:
            for row in found(part):
                if len(row[0]):
                    held.append(list(row))
                    n += len(row[0])
                if n >= held_rows:
                    yield from settle()
                    held.clear()
                    n = 0
        if held:
            yield from settle()

    return run


def _first_of(rows: DataFrame) -> DataFrame:
    """``(key, h1, h2, doc, th, at, n, hot, repeat, src, from)``: whether an earlier row has the same hashes (``repeat``), and its place (``src``, ``from``)."""
    same = Window.partitionBy("key", "h1", "h2").orderBy("doc", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("lead", F.first(F.struct("doc", "place")).over(same))
    bit = lambda b: F.col("mark").bitwiseAND(b) != 0
    word = lambda place: place.bitwiseAND(0x7FFFFFFF).cast("int")
    known = bit(_KNOWN)
    return rows.select(
        "key", "h1", "h2", "doc", F.shiftright("place", 32).cast("int").alias("th"), word(F.col("place")).alias("at"), F.col("mark").bitwiseAND(_HOT - 1).alias("n"), bit(_HOT).alias("hot"),
        (known | (F.col("lead") != F.struct("doc", "place"))).alias("repeat"), F.when(known, F.col("src")).otherwise(F.col("lead.doc")).alias("src"),
        F.when(known, F.col("from")).otherwise(word(F.col("lead.place"))).alias("from"),
    )


def hot_anchors(docs: DataFrame, total: int, window: int = 20, sample: int = 20_000, share: float = 1e-3) -> np.ndarray:
    """Anchors, sorted, that stand in more than ``share`` of the texts: of ``total`` about ``sample`` are
    looked at (all, if they are fewer). There are no more of them than blocks in a thousand texts. They only say how
    work is spread; what is found is the same whichever anchors are taken for hot."""
    part = min(1.0, sample / max(1, total))
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in parts:
            each = [np.unique(parse(word_hashes(t.split()), window)[0]) for t in as_bytes(few.column(0))]
            keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *each]), return_counts=True)
            yield pa.record_batch([keys.view(np.int64), n.astype(np.int64)], schema=schema)

    some = docs.select("text").sample(part, seed=0)
    counts = some.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    told = counts.where(F.col("n") > max(10.0, share * part * total)).select("key").toArrow()  # bounded: share
    return np.sort(told.column("key").to_numpy().view(np.uint64))


def repeated_spans(docs: DataFrame, window: int = 20, hot: np.ndarray | None = None) -> DataFrame:
    """``(doc, th, spans)`` for the documents ``(doc, th, text)``: ``spans`` are ``(at, n, src, from)``, word
    numbers and lengths of the passages whose every window of ``window`` words starts earlier, too, and where
    the first of them starts. They overlap and are not joined yet (``factors``). The windows of a block with an
    anchor of ``hot`` (``hot_anchors``) are looked up in any case, so that such blocks need not meet in one task."""

    def blocks(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc, th, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
            key, h1, h2, at, n = parse(word_hashes(text.split()), window)
            yield key, h1, h2, np.full(len(at), doc, np.int64), np.full(len(at), th, np.int32), at, n

    found = docs.mapInArrow(_folded(blocks, hot), _SHAPE)
    found = _first_of(found.repartition("key"))
    every = Window.partitionBy("key")
    several = (F.min("h1").over(every) != F.max("h1").over(every)) | (F.min("h2").over(every) != F.max("h2").over(every))
    found = found.withColumn("several", F.col("hot") | several).where("repeat or several").select("doc", "th", "at", "n", "repeat", "src", "from")
    found = saved(found)

    lists = found.where("not repeat").groupBy("doc", "th").agg(F.collect_list(F.struct("at", "n")).alias("blocks"))
    open_ = docs.join(lists, ["doc", "th"]).select("doc", "th", "text", F.col("blocks.at").alias("at"), F.col("blocks.n").alias("n"))

    def windows(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc, th, text, at, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), *(part.column(k).to_pylist() for k in (3, 4)), strict=True):
            words = word_hashes(text.split())
            h1, h2 = _hashes(words, window, 31), _hashes(words, window, 32)
            want = np.unique(np.concatenate([np.arange(a, a + m) for a, m in zip(at, n, strict=True)]))
            yield h1[want], h1[want], h2[want], np.full(len(want), doc, np.int64), np.full(len(want), th, np.int32), want, np.ones(len(want), np.int64)

    single = _first_of(open_.mapInArrow(_folded(windows), _SHAPE).repartition("key")).where("repeat").select("doc", "th", "at", "n", "src", "from")
    spans = found.where("repeat").select("doc", "th", "at", "n", "src", "from").unionByName(single)
    return spans.groupBy("doc", "th").agg(F.collect_list(F.struct("at", (F.col("n") + window - 1).alias("n"), "src", "from")).alias("spans"))


def factors(at: np.ndarray, n: np.ndarray, src: np.ndarray, from_: np.ndarray) -> tuple[np.ndarray, ...]:
    """The greedy parse of a document: from left to right, spans that follow each other in the document and in
    one place of the reference are one factor ``(at, n, src, from)``."""
    order = np.lexsort((n, at))
    at, n, src, from_ = (x[order] for x in (at, n, src, from_))
    if not len(at):
        return at, n, src, from_
    goes_on = (src[1:] == src[:-1]) & (from_[1:] - at[1:] == from_[:-1] - at[:-1]) & (at[1:] <= at[:-1] + n[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    ends = np.maximum.reduceat(at + n, first)
    return at[first], ends - at[first], src[first], from_[first]


def kept_words(words: list[bytes], at: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The words that no factor covers."""
    if not len(at):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``_kept`` (the words left of its text, joined by single spaces),
    ``_n_words``, ``_n_removed`` and ``_factors``: the repeated passages ``(at, n, src, from)``, ``n`` words
    from word ``at`` on, which also stand in document ``src`` from its word ``from`` on.

    Words are runs of anything but ASCII white space. A word goes when some window of ``window`` words
    around it starts earlier, too: in a document with a smaller key, or earlier in its own. All windows
    are judged on the texts as given.

    A null text has no words and keeps none; its ``_kept`` is empty. A row with a null key has no place
    in the order: it loses nothing and nothing is lost to it. Rows that repeat a key with the same text
    are one document, judged once; with another text each is a document, in an order by a hash of the
    text. Texts of fewer words than a window stay. An empty table gives no rows. Columns of ``docs``
    stay, whatever their names; only one that is called as an added one is replaced by it.
    """
    rows = packed_row(docs, doc=F.col(key).cast("long"), th=F.hash(F.col(text)), text=F.col(text))
    judged = rows.where("doc is not null and text is not null").select("doc", "th", "text")
    spans = repeated_spans(judged, window, hot_anchors(judged, docs.count(), window)).select("doc", "th", *(F.col(f"spans.{c}").alias(c) for c in ("at", "n", "src", "from")))
    rows = rows.join(spans, ["doc", "th"], "left")
    kinds = {"at": pa.int64(), "n": pa.int64(), "src": pa.int64(), "from": pa.int64()}

    @F.arrow_udf("struct<kept string, words long, removed long, factors array<struct<at long, n long, src long, from long>>>")
    def cut(texts: pa.Array, *lists: pa.Array) -> pa.Array:
        kept, words, removed, found, ends = [], [], [], [], [0]
        spans = [c.cast(pa.list_(pa.int64())) for c in lists]
        for k, t in enumerate(as_bytes(texts)):
            before = (t or b"").split()
            own = factors(*(np.array(c[k].values, np.int64) if c[k].is_valid else np.empty(0, np.int64) for c in spans))
            after = kept_words(before, own[0], own[1])
            kept.append(b" ".join(after))
            words.append(len(before))
            removed.append(len(before) - len(after))
            found.append(own)
            ends.append(ends[-1] + len(own[0]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4
        parts = pa.StructArray.from_arrays([pa.array(c, kinds[n]) for n, c in zip(kinds, columns, strict=True)], list(kinds))
        lists_ = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), lists_], ["kept", "words", "removed", "factors"])

    rows = rows.select("row", cut("text", "at", "n", "src", "from").alias("cut"))
    return unpacked_row(rows, docs, _kept="cut.kept", _n_words="cut.words", _n_removed="cut.removed", _factors="cut.factors")
