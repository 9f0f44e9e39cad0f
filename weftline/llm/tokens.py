"""Token ids of public tokenizers, remembered for the pieces of text met lately."""

from __future__ import annotations

import os

import numpy as np

#: Characters that only some call white space; white space that is rare.
_UNSURE, _RARE = b"\x00\x1c\x1d\x1e\x1f\x85\xa0", b"\t\r\x0b\x0c"
_BLANK = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
_LONGEST = 255
_LOADED: dict[tuple[str, str], "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Ids of short pieces of text in arrays: an open-addressed table of 128-bit hashes, by which many
    pieces are looked up at once, and one run of ids for all of them.

    A hash is a sum of random numbers for each character at its place in the piece.
    """

    def __init__(self, limit: int = 1_000_000) -> None:
        rng = np.random.default_rng(20_240_229)
        self.random = rng.integers(0, 2**64, (2, (_LONGEST + 2) * 256), np.uint64)
        self.random[:, 32::256] = 0  # the space that ends a piece
        self.limit, self.slots = limit, 1 << (2 * limit - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((2, self.slots), np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.at, self.n = np.zeros(self.limit + 1, np.int64), np.zeros(self.limit + 1, np.int32)
        self.ids, self.used, self.size = np.zeros(1 << 16, np.uint32), 0, 0

    def hashes(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hashes of pieces, each from its start up to the space before the next."""
        place = np.arange(len(chars), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(starts, append=len(chars)))
        cell = place * 256 + chars
        return np.stack([np.add.reduceat(r[cell], starts) for r in self.random])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entries of hashes; -1 where there is none."""
        out = np.full(h.shape[1], -1, np.int32)
        left, mask = np.arange(h.shape[1]), np.uint64(self.slots - 1)
        slot = (h[0] & mask).astype(np.int64)
        while len(left):
            e = self.entry[slot]
            same = (self.keys[0][slot] == h[0][left]) & (self.keys[1][slot] == h[1][left]) & (e >= 0)
            out[left[same]] = e[same]
            on = ~same & (e >= 0)
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """New pieces with their ids."""
        m = len(ids)
        n = np.fromiter(map(len, ids), np.int64, m) // 4
        data = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(data) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(data)] = data
        new = np.arange(self.size, self.size + m)
        self.at[new], self.n[new] = self.used + np.cumsum(n) - n, n
        self.used, self.size = self.used + len(data), self.size + m
        left, slot = np.arange(m), (h[0] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = self.entry[slot] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            where = slot[put]
            self.entry[where], self.keys[0][where], self.keys[1][where] = new[left[put]], h[0][left[put]], h[1][left[put]]
            left, slot = left[~put], (slot[~put] + ~free[~put]) & (self.slots - 1)

    def runs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, one after the other, and the number of each."""
        n = self.n[entries].astype(np.int64)
        ends = np.cumsum(n)
        where = np.repeat(self.at[entries] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[where], n


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes, equal to those of the tokenizers library.

    All ids come from that library. Texts of plain Latin letters are cut where the tokenizer cannot
    join anything, at spaces and ends of lines; each piece is encoded once, many at a time, and
    remembered (up to ``limit`` pieces). Any other text is encoded as it is, among them all that might hold
    the string of a special token, which the library by default makes that token.

    ``kind``: "byte" for a byte-level vocabulary that keeps spaces at the start of its tokens; "word"
    for one that drops white space and ends words.
    """

    def __init__(self, path: str, kind: str, limit: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind, self.table = kind, PieceTable(limit)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.largest = max(vocabulary.values())
        self.starts = np.zeros(self.largest + 1, bool)
        if kind == "byte":
            self.starts[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True
        else:
            self.starts[vocabulary["0</w>"]] = True

    def plain(self, text: str) -> bytes | None:
        """The text's pieces with a space after each, in Latin-1; null if it cannot be cut so."""
        if self.kind == "word":
            text = text.lower()
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if b"<|" in raw or raw.translate(None, _UNSURE) != raw:
            return None
        if self.kind == "word":
            return raw.translate(_BLANK) + b" "
        # runs of white space of which the tokenizer might join some
        odd = b"   " in raw or b" \n" in raw or b"\n " in raw or b"\n\n\n" in raw or raw.endswith((b"  ", b"\n\n"))
        if odd or raw.translate(None, _RARE) != raw:
            return None
        return raw.replace(b"\n", b" \n") + b" "

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Encode pieces, some hundred in a text; tokens tell where each begins."""
        byte = self.kind == "byte"
        if byte:
            texts = [w if w[:1] == "\n" else " " + w for w in new]
            alone = [k for k, w in enumerate(new) if w in ("", "\n")]
        else:
            texts = new
            alone = [k for k, w in enumerate(new) if not w or "0" in w]
        apart = set(alone)
        out: list[bytes] = [b""] * len(new)
        for k, ids in zip(alone, self._raw([texts[k] for k in alone]), strict=True):
            out[k] = ids
        rest = [k for k in range(len(new)) if k not in apart] if apart else list(range(len(new)))
        for at in range(0, len(rest), 256):
            few = rest[at : at + 256]
            ids = np.array(self.tok.encode_batch_fast([("" if byte else " 0 ").join([texts[k] for k in few])], add_special_tokens=False)[0].ids, "<u4")
            cuts, data = np.flatnonzero(self.starts[ids]), ids.tobytes()
            ends = [*(4 * cuts[byte:]).tolist(), len(data)]
            if len(ends) == len(few) and (not byte or cuts[0] == 0):
                begins = [0, *ends[:-1]] if byte else [0, *(e + 4 for e in ends[:-1])]
                parts = [data[a:b] for a, b in zip(begins, ends, strict=True)]
            else:
                parts = self._raw([texts[k] for k in few])
            for k, p in zip(few, parts, strict=True):
                out[k] = p
        return out

    def _cut(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of texts in the form of ``plain``, but for their first pieces if the kind is byte; null for
        a text with a piece too long to be remembered, or with more pieces than there is room for."""
        buffer = b"".join(texts)
        chars = np.frombuffer(buffer, np.uint8)
        ends = np.flatnonzero(chars == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) for t in texts]))  # each text's first piece
        long = ends - starts > _LONGEST
        if long.any():
            bad = set((np.searchsorted(first, np.flatnonzero(long), side="right") - 1).tolist())
            good = iter(self._cut([t for k, t in enumerate(texts) if k not in bad]) if len(bad) < len(texts) else [])
            return [None if k in bad else next(good) for k in range(len(texts))]
        h = self.table.hashes(chars, starts)
        found = self.table.find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            _, at = np.unique(h[0][missing], return_index=True)
            at = missing[at]
            if self.table.size + len(at) > self.table.limit:
                self.table.clear()
                _, at = np.unique(h[0], return_index=True)
                if len(at) > self.table.limit:
                    return [None] * len(texts)
            words = [buffer[a:b].decode("latin-1") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self.table.add(h[:, at], self._learn(words))
            found = self.table.find(h)
        if self.kind == "byte":
            found[first[:-1]] = self.table.limit  # an entry without ids
        ids, n = self.table.runs(found)
        data = ids.astype("<u4", copy=False).tobytes()
        to = np.concatenate([[0], np.cumsum(n)])[first] * 4
        return [data[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null."""
        out: list[bytes | None] = [b"" if t is None else None for t in texts]
        held, size = [], 0
        for k, t in enumerate(texts):
            p = None if t is None or len(t) > 1 << 21 else self.plain(t)
            if p is not None:
                held.append((k, p))
                size += len(p)
            if held and (size > 1 << 21 or k == len(texts) - 1):
                self._encode_plain(held, texts, out)
                held, size = [], 0
        if held:
            self._encode_plain(held, texts, out)
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._raw([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _encode_plain(self, held: list[tuple[int, bytes]], texts: list[str | None], out: list[bytes | None]) -> None:
        found = self._cut([p for _, p in held])
        if self.kind == "byte":  # the first piece of a text has no space before it
            heads = self._raw([p[: p.index(b" ")].decode("latin-1") for _, p in held])
            found = [None if ids is None else head + ids for head, ids in zip(heads, found, strict=True)]
        for (k, _), ids in zip(held, found, strict=True):
            out[k] = ids


def encoder(path: str, kind: str) -> Encoder:
    """The encoder of this process."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Encoder(path, kind)
    return _LOADED[path, kind]
