"""An exact Jaccard join of documents by their word shingles, for linked classes of documents.

The method is a partition of the universe with the pigeonhole principle. Two sets of s and l elements
whose Jaccard similarity is at least t differ in at most (1 - t) / (1 + t) * (s + l) elements. Hash the
elements into segments: if a set is indexed by more segments than the two differ in, the other set
agrees with it in one of these; a segment whose one-deletion neighbourhood is indexed counts twice.

* **Sizes** are cut into bands, each reaching up to its first size over t, so that linked sets lie in one
  band or in neighbouring ones. A band has a number of segments, for all its sets the same.
* **Frequencies.** An element that only one text has can be in no intersection. All elements are
  counted once (shuffled by hash, packed); such single ones are left out of the segments and taken off the
  differences that a set may have, and a set that has more of them than any link allows is not indexed.
* **Allocation by cost.** A set is indexed by the segments, and the neighbourhoods, that meet the fewest
  other texts by these counts, as many as its differences ask for; which ones is its own choice,
  as the larger set of a pair looks up all its segments, and all its neighbourhoods where the
  band has any.
* **Frequent elements**, of more than a thousandth of a sample of texts, are not counted at all: they stand in several texts, and go along with
  their texts, with the number that the sample tells, which only says what a segment costs.
* **Verification** intersects the sets of each candidate pair. Elements are hashes of 64 bits (the
  five 64-bit hashes of whole words, mixed), of which at least 56 and the bucket's bits are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, dropped, joined, mixed, packed_row, saved, unpacked_row, word_hashes
from .components import connected_components


def shingle_sets(texts: list[bytes | None], n: int = 5) -> list[np.ndarray]:
    """For each whole text the distinct hashed shingles of ``n`` words, ascending; A-Z count as a-z. Of
    fewer words the whole sequence is one; without words there is none."""
    words = [(t or b"").lower().split() for t in texts]
    h = word_hashes([w for ws in words for w in ws])
    runs = h
    for k in range(1, n):
        runs = joined(runs[: len(h) - k], h[k:], 40 + k) if len(h) > k else runs[:0]
    out, first = [], 0
    for end in np.cumsum([len(ws) for ws in words]).tolist():
        if end - first >= n:
            out.append(np.unique(runs[first : end - n + 1]))
        else:
            few = h[first:end][:1]
            for k in range(first + 1, end):
                few = joined(few, h[k : k + 1], 70)
            out.append(few)
        first = end
    return out


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text], n)[0]


def may_link(size_a, size_b, shared_a, shared_b, percent: int):  # noqa: ANN001, ANN201  numbers or arrays
    """Whether sets of these sizes, with so many elements that other texts have, can link at all."""
    return percent * (size_a + size_b) <= (100 + percent) * np.minimum(shared_a, shared_b)


class Band(NamedTuple):
    """Set sizes from ``low`` to ``high``, the segments of these sets, and whether a segment's
    one-deletion neighbourhood may be indexed."""

    number: int
    low: int
    high: int
    segments: int
    deletions: bool


def bands(percent: int, largest: int, small: int = 48) -> list[Band]:
    """The bands of all sizes up to ``largest``. A set is indexed by at most one segment more than it may
    have differences. Up to size ``small`` there are half as many segments, as each can count twice;
    the larger bands have a third to spare, from which a set chooses."""
    out: list[Band] = []
    low = 1
    while low <= largest:
        high = low * 100 // percent
        most = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
        deletions = high <= small
        out.append(Band(len(out), low, high, most // 2 + 2 if deletions else (most + 1) * 4 // 3, deletions))
        low = high + 1
    return out


BOTH, INDEXES, ASKS = 0, 1, 2  # what a set does with a key
_LAST = 1e12  # what the key of an empty segment is taken to cost


class Scheme:
    """The keys of sets."""

    def __init__(self, percent: int) -> None:
        self.percent, self.bands = percent, bands(percent, 1 << 20)
        self.highs = [b.high for b in self.bands]

    def band(self, n: int) -> int:
        while self.highs[-1] < n:
            self.bands = bands(self.percent, 4 * self.highs[-1])
            self.highs = [b.high for b in self.bands]
        return bisect_left(self.highs, n)

    def needed(self, size: int, shared: int) -> int:
        """How many segments index a set of this size, of which so many elements are in other texts, for
        all larger partners; 0 if it has none of its size or more."""
        p = self.percent
        largest = min(100 * size // p, shared * (100 + p) // p - size)
        return 0 if largest < size else (100 - p) * (size + largest) // (100 + p) - (size - shared) + 1

    def keys(self, size: int, found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a set and what it does with each. ``found``: those of its elements that other texts
        have, ``count``: in how many texts each is."""
        own = self.band(size)
        spread = mixed(found + np.uint64(0x51ED2701))
        keys, roles = [], []
        for band in self.bands[max(0, own - 1) : own + 1]:
            segment = ((spread >> np.uint64(20)) % np.uint64(band.segments)).astype(np.int64)
            sums = np.zeros(band.segments, np.uint64)
            np.add.at(sums, segment, spread)
            label = mixed(np.arange(band.segments, dtype=np.uint64) + np.uint64(band.number << 32))
            whole = joined(label, sums, 51)
            without = sums[segment] - spread
            chosen = np.zeros(band.segments, np.int64)
            if band.number == own and (need := self.needed(size, len(found))):
                chosen = _allocated(segment, count, band, need)
            role = np.where(chosen > 0, BOTH, ASKS)
            keys.append(whole)
            roles.append(role)
            if band.deletions:
                keys.append(np.unique(joined(label[segment], without, 52)))  # asks with an element less
                roles.append(np.full(len(keys[-1]), ASKS))
                twice = chosen[segment] == 2
                less = np.setdiff1d(joined(label[segment[twice]], without[twice], 51), whole)
                one_more = joined(label, sums, 52)[chosen == 2]
                keys += [less, one_more]
                roles += [np.full(len(less), INDEXES), np.full(len(one_more), INDEXES)]
        return np.concatenate(keys), np.concatenate(roles)


def _allocated(segment: np.ndarray, count: np.ndarray, band: Band, need: int) -> np.ndarray:
    """How often each segment counts (0, 1, or 2 with its one-deletion neighbourhood), so that they count
    ``need`` times at the least cost. A key costs a row and at most as many meetings as its rarest
    element has texts."""
    n = np.bincount(segment, minlength=band.segments)
    rank = np.lexsort((count, segment))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    sorted_ = np.concatenate([count[rank], [0.0, 0.0]])
    least = np.where(n > 0, sorted_[first], _LAST)  # the rarest element of each segment
    out = np.zeros(band.segments, np.int64)
    if not band.deletions:
        out[np.argsort(least, kind="stable")[:need]] = 1
        return out
    second = np.where(n > 1, sorted_[first + 1], _LAST)
    # without the rarest element the second rarest tells; without any other the rarest does
    more = 1 + n + least + np.where(n > 0, second + np.maximum(n - 1, 0) * least, 0)
    cost = np.concatenate([least, np.maximum(more, least)])
    for k in np.argsort(cost, kind="stable")[:need].tolist():
        out[k % band.segments] += 1
    return out


WORDS_ODD = 4  # 64-bit words of parities


def parities(found: np.ndarray) -> list[int]:
    """A bit for each of 64 * WORDS_ODD cells, set if an odd number of elements fall in it; two sets
    differ in at least as many elements as they differ in bits."""
    cell = (mixed(found) >> np.uint64(32)).astype(np.int64) % (64 * WORDS_ODD)
    odd = np.bincount(cell, minlength=64 * WORDS_ODD) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


# ---- how many texts have each element: texts -> buckets of elements -> texts

_PARCEL = "bucket int, th long, size long, held binary, counts binary, elements binary, codes binary"
_KINDS = [("bucket", pa.int32()), ("th", pa.int64()), ("size", pa.int64()), ("held", pa.binary()), ("counts", pa.binary()), ("elements", pa.binary()), ("codes", pa.binary())]


def _parcels(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _KINDS, strict=True)], schema=pa.schema(_KINDS))


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start, and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    return starts, np.diff(starts, append=len(of))


def _cut(elements: np.ndarray, bits: int) -> bytes:
    """Seven bytes of each element; its bucket has the first ``bits`` bits."""
    return (elements << np.uint64(bits) >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _whole(cut: bytes, bucket: int, bits: int) -> np.ndarray:
    parts = np.zeros((len(cut) // 7, 8), np.uint8)
    parts[:, :7] = np.frombuffer(cut, np.uint8).reshape(-1, 7)
    rest = parts.view("<u8")[:, 0] << np.uint64(8) >> np.uint64(bits)
    return rest | np.uint64(bucket << (64 - bits)) if bits else rest


def frequent_elements(texts: DataFrame, n: int, total: int, sample: int = 20_000, share: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Elements, sorted, that more than ``share`` of the texts have, and codes for their number: of ``total`` texts about ``sample`` are looked
    at (all, if they are fewer), so there are no more of them than elements in a thousand texts. They only say how work is spread and what
    a segment costs: an element that is taken for one of several texts, and is not, is in no intersection, so what links is the same whichever are taken for frequent."""
    part = min(1.0, sample / max(1, total))
    schema = pa.schema([("e", pa.int64()), ("n", pa.int64())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text in a task are one text; bounded: sample
        for few in parts:
            for at in range(0, few.num_rows, 200):
                some = few.slice(at, 200)
                new = {th: k for k, th in enumerate(some.column(0).to_pylist()) if th not in seen}
                seen.update(new)
                found = shingle_sets(as_bytes(some.column(1).take(pa.array(list(new.values()), pa.int64()))), n)
                e, m = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
                yield pa.record_batch([e.view(np.int64), m.astype(np.int64)], schema=schema)

    counts = texts.sample(part, seed=0).mapInArrow(count, "e long, n long").groupBy("e").agg(F.sum("n").alias("n"))
    told = counts.where(F.col("n") > max(10.0, share * part * total)).toArrow()  # bounded: share
    elements, number = told.column("e").to_numpy().view(np.uint64), told.column("n").to_numpy() / part
    order = np.argsort(elements)
    return elements[order], np.minimum(np.round(8 * np.log2(np.maximum(number[order], 2))), 255).astype(np.uint8)


def _dealt(n: int, bits: int, frequent: tuple[np.ndarray, np.ndarray], held_elements: int = 1_000_000) -> Callable:
    """A task that deals the elements of texts ``(th, text)`` to buckets by their first bits: a row for each
    bucket and some thousand texts, and a row for each text with its size (its bucket is below 0). Elements of ``frequent`` need no count; they go
    along with the sizes, whole, with their codes, so that no bucket gets an entry of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(f) for f in held.values()], np.int64)
            names = np.fromiter(held, np.int64, len(held))
            elements, owner = np.concatenate(list(held.values())), np.repeat(np.arange(len(held), dtype=np.int32), sizes)
            rows = []
            if len(frequent[0]):
                at = np.minimum(np.searchsorted(frequent[0], elements), len(frequent[0]) - 1)
                often = np.flatnonzero(frequent[0][at] == elements)
                to = (names.view(np.uint64) & np.uint64(1023)).astype(np.int64)[owner[often]]
                often = often[np.argsort(to, kind="stable")]
                to = np.sort(to)
                for first, m in zip(*(x.tolist() for x in _runs(to)), strict=True):
                    own = often[first : first + m]
                    starts, counts = _runs(owner[own])
                    rows.append((-1 - int(to[first]), None, None, names[owner[own[starts]]].tobytes(), counts.astype("<u4").tobytes(), elements[own].tobytes(), frequent[1][at[own]].tobytes()))
                seldom = np.ones(len(elements), bool)
                seldom[often] = False
                elements, owner = elements[seldom], owner[seldom]
            bucket = (elements >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(elements), np.int32)
            order = np.argsort(bucket, kind="stable")
            yield _parcels([(-1 - (th & 1023), th, size, None, None, None, None) for th, size in zip(names.tolist(), sizes.tolist(), strict=True)])
            for at, m in zip(*(x.tolist() for x in _runs(bucket[order])), strict=True):
                own = order[at : at + m]
                starts, counts = _runs(owner[own])
                rows.append((int(bucket[own[0]]), None, None, names[owner[own[starts]]].tobytes(), counts.astype("<u4").tobytes(), _cut(elements[own], bits), None))
            yield _parcels(rows)

        total = 0
        for part in parts:
            for at in range(0, part.num_rows, 256):
                few = part.slice(at, 256)
                for th, found in zip(few.column(0).to_pylist(), shingle_sets(as_bytes(few.column(1)), n), strict=True):
                    if len(found) and th not in held:
                        held[th] = found
                        total += len(found)
                if total >= held_elements:
                    yield from out()
                    held.clear()
                    total = 0
        if held:
            yield from out()

    return run


def _grouped(settle: Callable) -> Callable:
    """A task over parcels sorted by bucket: ``settle(bucket, sizes, parcels)`` for each bucket in turn, with
    the rows ``(th, size)`` and ``(held, counts, elements, codes)`` in it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sizes, parcels = None, [], []
        for few in (part.slice(at, 64) for part in parts for at in range(0, part.num_rows, 64)):
            for bucket, th, size, *parcel in zip(*(c.to_pylist() for c in few.columns), strict=True):
                if bucket != now:
                    if now is not None:
                        yield from settle(now, sizes, parcels)
                    now, sizes, parcels = bucket, [], []
                if th is None:
                    parcels.append(parcel)
                else:
                    sizes.append((th, size))
                # what is below 0 passes by: it is not held until its bucket ends
                if now < 0 and (len(sizes) >= 50_000 or len(parcels) >= 64):
                    yield from settle(now, sizes, parcels)
                    sizes, parcels = [], []
        if now is not None:
            yield from settle(now, sizes, parcels)

    return run


def _counted(bits: int) -> Callable:
    """Settles a bucket of elements: how many texts have each. Those that several have go back to their
    texts, in as many parts as there are buckets, with a code for their number. Copies of a text in
    several parcels are one text."""

    def settle(bucket: int, sizes: list, parcels: list) -> Iterator[pa.RecordBatch]:
        mask = (1 << bits) - 1
        if sizes:
            yield _parcels([(th & mask, th, size, None, None, None, None) for th, size in sizes])
        if bucket < 0:  # elements with a code: on to the parts of their texts
            if parcels:
                names, n, elements, codes = (np.concatenate([np.frombuffer(p[k], t) for p in parcels]) for k, t in enumerate((np.int64, "<u4", np.uint64, np.uint8)))
                order = np.argsort(names & mask, kind="stable")
                own = np.argsort(np.repeat(names & mask, n), kind="stable")
                names, n, elements, codes = names[order], n[order], elements[own], codes[own]
                ends = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
                rows = []
                for at, m in zip(*(x.tolist() for x in _runs(names & mask)), strict=True):
                    few, all_ = slice(at, at + m), slice(ends[at], ends[at + m])
                    rows.append((int(names[at] & mask), None, None, names[few].tobytes(), n[few].astype("<u4").tobytes(), elements[all_].tobytes(), codes[all_].tobytes()))
                yield _parcels(rows)
            return
        if not parcels:
            return
        held = np.concatenate([np.frombuffer(p[0], np.int64) for p in parcels])
        counts = np.concatenate([np.frombuffer(p[1], "<u4") for p in parcels]).astype(np.int64)
        elements = np.concatenate([_whole(p[2], bucket, bits) for p in parcels])
        parcels.clear()
        once = np.zeros(len(held), bool)
        once[np.unique(held, return_index=True)[1]] = True
        elements, held, counts = elements[np.repeat(once, counts)], held[once], counts[once]
        order = np.argsort(elements)
        starts, n = _runs(elements[order])
        code = np.empty(len(elements), np.uint8)
        code[order] = np.repeat(np.minimum(np.round(8 * np.log2(n)), 255).astype(np.uint8), n)
        owner = np.repeat(np.arange(len(held), dtype=np.int32), counts)
        kept = np.flatnonzero(code)
        kept = kept[np.argsort(held[owner[kept]] & mask, kind="stable")]
        to = held[owner[kept]] & mask
        rows = []
        for at, m in zip(*(x.tolist() for x in _runs(to)), strict=True):
            own = kept[at : at + m]
            first, n = _runs(owner[own])
            rows.append((int(to[at]), None, None, held[owner[own[first]]].tobytes(), n.astype("<u4").tobytes(), elements[own].tobytes(), code[own].tobytes()))
        if rows:
            yield _parcels(rows)

    return settle


_SET = "th long, size long, shared long, elements binary, codes binary, odd array<long>"


def _gathered(percent: int) -> Callable:
    """Settles a part of the texts: each once, with the elements that other texts have too and their codes,
    if so many that it may link, and their parities."""
    schema = pa.schema([("th", pa.int64()), ("size", pa.int64()), ("shared", pa.int64()), ("elements", pa.binary()), ("codes", pa.binary()), ("odd", pa.list_(pa.int64()))])

    def settle(bucket: int, sizes: list, parcels: list) -> Iterator[pa.RecordBatch]:
        size_of = dict(sizes)
        empty = {"elements": None, "codes": None, "odd": None}
        found: dict[int, dict] = {}
        if parcels:
            held = np.concatenate([np.frombuffer(p[0], np.int64) for p in parcels])
            counts = np.concatenate([np.frombuffer(p[1], "<u4") for p in parcels]).astype(np.int64)
            elements = np.concatenate([np.frombuffer(p[2], np.uint64) for p in parcels])
            codes = np.concatenate([np.frombuffer(p[3], np.uint8) for p in parcels])
            owner = np.repeat(held, counts)
            order = np.lexsort((elements, owner))
            # a text that came from several tasks has its frequent elements as many times
            new = np.ones(len(order), bool)
            new[1:] = (owner[order][1:] != owner[order][:-1]) | (elements[order][1:] != elements[order][:-1])
            order = order[new]
            for at, n in zip(*(x.tolist() for x in _runs(owner[order])), strict=True):
                own = order[at : at + n]
                th = int(owner[own[0]])
                size = size_of[th]
                found[th] = {"shared": n} | empty
                if may_link(size, -(-percent * size // 100), n, n, percent):
                    found[th] |= {"elements": elements[own].tobytes(), "codes": codes[own].tobytes(), "odd": parities(elements[own])}
        rows = [{"th": th, "size": size, "shared": 0} | empty | found.get(th, {}) for th, size in size_of.items()]
        for at in range(0, len(rows), 2_000):
            yield pa.RecordBatch.from_pylist(rows[at : at + 2_000], schema=schema)

    return settle


def text_sets(texts: DataFrame, chars: int, total: int, n: int = 5, percent: int = 75, bucket_chars: int = 8_000_000) -> DataFrame:
    """``(th, size, shared, elements, codes, odd)`` for the texts ``(th, text)`` that have words; texts with
    one ``th`` are one text. ``chars`` and ``total``: about how many characters and texts there are, for the number of buckets and a sample."""
    frequent = frequent_elements(texts, n, total)
    bits = max(0, int(chars / bucket_chars)).bit_length()
    sent = texts.mapInArrow(_dealt(n, bits, frequent), _PARCEL).repartition("bucket").sortWithinPartitions("bucket")
    back = sent.mapInArrow(_grouped(_counted(bits)), _PARCEL).repartition("bucket").sortWithinPartitions("bucket")
    return saved(back.mapInArrow(_grouped(_gathered(percent)), _SET))


# ---- candidates

_KEYED = "key long, role int, id long, size long, shared long"
_KEYED_SCHEMA = pa.schema([("key", pa.int64()), ("role", pa.int32()), ("id", pa.int64()), ("size", pa.int64()), ("shared", pa.int64())])


def _indexed(percent: int) -> Callable:
    """A task that makes the keys of sets ``(id, size, elements, codes)``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for part in parts:
            held, n = [], 0
            for at, (id_, size, elements, codes) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                found = np.frombuffer(elements, np.uint64)
                keys, roles = scheme.keys(size, found, np.exp2(np.frombuffer(codes, np.uint8) / 8))
                m = len(keys)
                held.append((keys.view(np.int64), roles.astype(np.int32), np.full(m, id_, np.int64), np.full(m, size, np.int64), np.full(m, len(found), np.int64)))
                n += m
                if n >= 100_000 or at == part.num_rows - 1:
                    yield pa.record_batch([np.concatenate(c) for c in zip(*held, strict=True)], schema=_KEYED_SCHEMA)
                    held, n = [], 0

    return run


class _Pairs:
    """Pairs of ids, each once for as long as they are held."""

    def __init__(self, limit: int = 500_000) -> None:
        self.held: list[np.ndarray] = []
        self.n, self.limit = 0, limit

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        self.n += len(a)

    def taken(self, last: bool = False) -> np.ndarray:
        if not self.n or (self.n < self.limit and not last):
            return np.empty((0, 2), np.int64)
        both = np.unique(np.concatenate(self.held), axis=0)
        self.held, self.n = [], 0
        if not last and len(both) < self.limit // 2:
            self.held, self.n = [both], len(both)
            return both[:0]
        return both


_STARS = f"{_KEYED}, a long, b long"


def _stars(percent: int, piece: int = 200_000) -> Callable:
    """A task over keyed sets, sorted by key and role. Of each group that an indexing set begins come the
    pairs of that set with all others, and of groups of three and more their rows too. A group is
    never held whole: of a long one each piece begins with its first rows again."""
    schema = pa.schema([*_KEYED_SCHEMA, ("a", pa.int64()), ("b", pa.int64())])

    def settled(rows: list[np.ndarray], pairs: _Pairs) -> Iterator[pa.RecordBatch]:
        key, role, id_, size, shared = rows
        starts, n = _runs(key)
        lead = np.repeat(starts, n)
        ok = role[lead] != ASKS
        pair = ok & (id_ != id_[lead]) & may_link(size, size[lead], shared, shared[lead], percent)
        pairs.add(id_[lead[pair]], id_[pair])
        big = ok & np.repeat(n > 2, n)
        if big.any():
            none = pa.nulls(int(big.sum()), pa.int64())
            yield pa.record_batch([*(c[big] for c in rows), none, none], schema=schema)

    def told(both: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(both):
            yield pa.record_batch([*(pa.nulls(len(both), f.type) for f in _KEYED_SCHEMA), both[:, 0], both[:, 1]], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, carry = _Pairs(), None
        for part in parts:
            rows = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            if not len(rows[0]):
                continue
            at = int(np.searchsorted(rows[0], rows[0][-1]))
            if at:
                yield from settled([c[:at] for c in rows], pairs)
            carry = [c[at:] for c in rows]
            if len(carry[0]) > piece:
                yield from settled(carry, pairs)
                carry = [c[:3] for c in carry]
            yield from told(pairs.taken())
        if carry is not None and len(carry[0]):
            yield from settled(carry, pairs)
        yield from told(pairs.taken(last=True))

    return run


def _crossing(percent: int) -> Callable:
    """A task over rows ``(key, tile, asks, id, component, size, shared, o0 ..)`` sorted by the first three: the
    pairs of indexing and asking sets of a tile that lie in two components and that sizes, shared
    elements and parities allow. The indexing sets of a tile are held, the others pass by."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def told(both: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(both):
            yield pa.record_batch([both[:, 0], both[:, 1]], schema=schema)

    def met(index: list[np.ndarray], ask: list[np.ndarray], pairs: _Pairs) -> None:
        for at in range(0, len(ask[0]), 512):
            id_, part, size, shared, *odd = (c[at : at + 512][None, :] for c in ask)
            id1, part1, size1, shared1, *odd1 = (c[:, None] for c in index)
            ok = (part1 != part) & may_link(size1, size, shared1, shared, percent)
            i, j = np.nonzero(ok)
            differ = sum(np.bitwise_count(x[i, 0] ^ y[0, j]).astype(np.int64) for x, y in zip(odd1, odd, strict=True))
            both = size1[i, 0] + size[0, j]
            ok = (100 + percent) * (differ + both - shared1[i, 0] - shared[0, j]) <= (100 - percent) * both
            pairs.add(id1[i, 0][ok], id_[0, j][ok])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, now, index = _Pairs(), None, None
        for part in parts:
            key, tile, asks, *rows = (c.to_numpy(zero_copy_only=False) for c in part.columns)
            step = np.ones(len(key), bool)
            step[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]) | (asks[1:] != asks[:-1])
            for a, b in zip(*(lambda s: (s, [*s[1:], len(key)]))(np.flatnonzero(step).tolist()), strict=True):
                some = [c[a:b] for c in rows]
                if (key[a], tile[a]) != now:
                    now, index = (key[a], tile[a]), None
                if not asks[a]:
                    index = some if index is None else [np.concatenate(x) for x in zip(index, some, strict=True)]
                elif index is not None:
                    met(index, some, pairs)
                    yield from told(pairs.taken())
        yield from told(pairs.taken(last=True))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` of ids whose sets link, by their intersection."""

    @F.arrow_udf("boolean")
    def near(size_a: pa.Array, size_b: pa.Array, set_a: pa.Array, set_b: pa.Array) -> pa.Array:
        both = np.array(
            [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(set_a.to_pylist(), set_b.to_pylist(), strict=True)],
            np.int64,
        )
        return pa.array(100 * both >= percent * (size_a.to_numpy() + size_b.to_numpy() - both))

    side = [sets.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("elements").alias(f"set_{x}")) for x in "ab"]
    found = pairs.join(side[0], "a").join(side[1], "b")
    return found.where(near("size_a", "size_b", "set_a", "set_b")).select("a", "b").distinct()


def set_links(sets: DataFrame, percent: int = 75, tile: int = 2_048) -> DataFrame:
    """``(node, component)`` for the sets ``(id, size, shared, elements, codes, odd)`` that link with others:
    the smallest id that links lead to.

    First each group of sets with a common key is compared with its first indexing set. Where that
    leaves several components in a group, each indexing set is compared with each asking set of another
    component, in tiles of at most about ``tile`` indexing sets; so groups of near copies cost a pair each,
    and no link between components is lost.
    """
    keyed = sets.select("id", "size", "elements", "codes").mapInArrow(_indexed(percent), _KEYED)
    keyed = keyed.repartition("key").sortWithinPartitions("key", "role", "id")
    found = saved(keyed.mapInArrow(_stars(percent), _STARS))
    pairs = saved(found.where("a is not null").select("a", "b").distinct())
    links = saved(_linked(pairs, sets, percent))
    parts = connected_components(links)

    grouped = found.where("key is not null").drop("a", "b")
    of_id = parts.select(F.col("node").alias("id"), "component")
    grouped = grouped.join(of_id, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = grouped.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.when(F.col("role") != ASKS, 1)).alias("n"))
    open_ = open_.where("lo <> hi").select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    grouped = saved(grouped.join(open_, "key"))
    if grouped.isEmpty():
        dropped(found, pairs, links, grouped)
        return parts
    grouped = grouped.join(sets.select("id", "size", *(F.col("odd")[k].alias(f"o{k}") for k in range(WORDS_ODD))), ["id", "size"])
    rest = ["id", "component", "size", "shared", *(f"o{k}" for k in range(WORDS_ODD))]
    index = grouped.where(F.col("role") != ASKS).select("key", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"), F.lit(0).alias("asks"), *rest)
    ask = grouped.where(F.col("role") != INDEXES).select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("asks"), *rest)
    tiles = index.union(ask).repartition("key", "tile").sortWithinPartitions("key", "tile", "asks")
    more = tiles.mapInArrow(_crossing(percent), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    more = saved(_linked(more, sets, percent))
    parts = parts if more.isEmpty() else connected_components(links.union(more))
    dropped(found, pairs, links, grouped, more)
    return parts


def jaccard_classes(docs: DataFrame, percent: int = 75, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``_size`` (its number of distinct shingles) and ``_component`` (the
    smallest key that links lead to, its own included). Two documents link when the Jaccard similarity
    of their sets of shingles of ``words`` words is at least ``percent`` hundredths.

    Equal texts are one text, compared once. A null text or one without words has no shingles and links
    with nothing. A row with a null key has no component and links with nothing. Rows that repeat a key are
    one document, linked by any of their texts. An empty table gives no rows. Columns of ``docs`` stay,
    whatever their names; only one that is called as an added one is replaced by it.
    """
    first, second = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    slim = saved(docs.select(F.col(key).cast("long").alias("doc"), first.alias("th"), second.alias("th2"), F.coalesce(F.length(text), F.lit(0)).alias("chars")))
    # a text is named by 64 bits; where two texts of different 128 bits have the same, they are named by all of these
    twice = [r.th for r in slim.groupBy("th").agg(F.min("th2").alias("a"), F.max("th2").alias("z")).where("a <> z").select("th").collect()]  # chance: n^2 / 2^65 of n texts
    named = (lambda a, b: F.when(a.isin(twice), F.xxhash64(a, b)).otherwise(a)) if twice else (lambda a, b: a)
    name = named(first, second)
    rows = docs.select(F.col(key).cast("long").alias("doc"), name.alias("th"), F.col(text).alias("text"))
    slim = slim.select("doc", named(F.col("th"), F.col("th2")).alias("th"), "chars")
    sums = slim.agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n")).first()
    told = text_sets(rows.where("text is not null").select("th", "text"), sums.chars or 0, sums.n, words, percent)

    # a text is named by the smallest key that has it
    names = slim.where("doc is not null").groupBy("th").agg(F.min("doc").alias("id"))
    names = saved(names.join(told.select("th"), "th"))
    sets = saved(told.where("elements is not null").join(names, "th").drop("th"))
    named = slim.where("doc is not null").select("doc", "th").join(names, "th").select("doc", "id").distinct()
    of_doc = saved(named.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z")))
    parts = set_links(sets, percent)
    dropped(sets)
    several = of_doc.where("a <> z")
    if not several.isEmpty():  # keys with several texts join these
        links = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        parts = connected_components(links.union(several.join(named, "doc").select("a", F.col("id").alias("b"))))
    of_doc = of_doc.join(parts.select(F.col("node").alias("a"), "component"), "a", "left")
    of_doc = of_doc.select("doc", F.coalesce("component", "a").alias("component"))

    own = slim.select("doc", "th").distinct().join(told.select("th", "size"), "th", "left").join(of_doc, "doc", "left")
    own = own.select(F.col("doc").alias("doc_"), F.col("th").alias("th_"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("component", "doc").alias("component"))
    out = packed_row(docs, doc=F.col(key).cast("long"), th=name)
    out = out.join(own, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("th") == F.col("th_")))
    return unpacked_row(out, docs, _size="size", _component="component")
