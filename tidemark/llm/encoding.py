"""Exact encoding of many whole texts with the `tokenizers` library.

A text is cut before a space or line feed that stands between two characters which cannot be white space, and between a Latin
letter and an ASCII sign. No pre-token of the two vocabularies used here (runs of letters, digits or signs, with at most one
leading space or with white space dropped) crosses such a cut, and no special string holds one, so encoding the pieces one by
one gives the ids of the whole text. A worker process keeps the ids of the pieces it has met. A long text is read in windows
that end at such cuts.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm import scan

_WIDE_LEADS = (0xE1, 0xE2, 0xE3)  # lead bytes of all white space of three bytes
_SIGN = np.zeros(256, bool)
_SIGN[list(b'.,;:!?%$#&*()[]{}"/-+=@~')] = True  # neither the apostrophe of contractions nor the signs of special strings
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the pieces; together they are the texts, byte for byte."""
    n = len(data)
    edge = np.zeros(n + 2, bool)
    edge[off] = True
    sp = np.flatnonzero((data == 0x20) | (data == 0x0A))
    sp = sp[(sp > 0) & (sp + 1 < n)]
    sp = sp[~edge[sp] & ~edge[sp + 1]]
    before, after = data[sp - 1], data[sp + 1]
    ok = (before > 0x20) & (before != 0x7F) & (after > 0x20) & (after != 0x7F)
    back2, back3 = data[np.maximum(sp - 2, 0)], data[np.maximum(sp - 3, 0)]
    high = before >= 0x80
    ok &= ~(high & (((back2 == 0xC2) & ((before == 0x85) | (before == 0xA0))) | np.isin(back3, _WIDE_LEADS)))
    ok &= ~(np.isin(after, _WIDE_LEADS) | (after == 0xC2))
    sign = np.flatnonzero(_SIGN[data[1:]]) + 1 if n else sp
    sign = sign[~edge[sign]]
    before = data[sign - 1]
    accented = (data[np.maximum(sign - 2, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    sign = sign[_LETTER[before] | accented]
    full = off[:-1] < off[1:]
    starts = np.sort(np.concatenate([off[:-1][full], sp[ok], sign]), kind="stable")
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def windows(data: np.ndarray, off: np.ndarray, most: int = 4 * scan.SLICE_BYTES):
    """(bytes, offsets) of parts of a slice: the slice itself, or a long text in windows that end at safe cuts."""
    if len(data) <= most or len(off) > 2:
        yield data, off
        return
    lo, wide = 0, most
    while lo < len(data):
        hi = min(len(data), lo + wide)
        if hi < len(data):
            last = int(unit_spans(data[lo:hi], np.array([0, hi - lo]))[0][-1])
            if last == 0:  # no safe cut so far
                wide *= 2
                continue
            hi, wide = lo + last, most
        yield data[lo:hi], np.array([0, hi - lo])
        lo = hi


class Encoder:
    """Ids of texts. One of these lives in each worker process for each tokenizer (see `encoder`)."""

    def __init__(self, path: str, bits: int = 20, store: int = 1 << 22):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), store
        self.memo = scan.Memo(2, np.int32, bits)
        self.store, self.used = np.zeros(min(store, 1 << 18), np.uint32), 0

    def _make(self, data, starts, ends):
        raw = data.tobytes()

        def make(which):
            rows = np.zeros((len(which), 2), np.int32)
            for lo in range(0, len(which), 20_000):
                part = which[lo : lo + 20_000]
                words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[part].tolist(), ends[part].tolist())]
                got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
                ids, owner = np.array(got.ids, np.uint32), np.array(got.word_ids, np.int64)
                size = np.bincount(owner, minlength=len(part)) if len(owner) else np.zeros(len(part), np.int64)
                while self.used + len(ids) > len(self.store):
                    self.store = np.concatenate([self.store, np.zeros(len(self.store), np.uint32)])
                self.store[self.used : self.used + len(ids)] = ids
                rows[lo : lo + len(part), 0] = self.used + np.cumsum(size) - size
                rows[lo : lo + len(part), 1] = size
                self.used += len(ids)
            return rows

        return make

    def _pieces(self, data: np.ndarray, off: np.ndarray):
        """(place in the store, number of ids, text index) of each piece."""
        if self.used > self.most:
            self.memo.reset()
            self.store, self.used = self.store[: 1 << 18].copy(), 0
        starts, ends, doc = unit_spans(data, off)
        rows = self.memo.look(scan.span_hashes(data, starts, ends), self._make(data, starts, ends)) if len(starts) else np.zeros((0, 2), np.int32)
        return rows[:, 0], rows[:, 1], doc

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        total = np.zeros(len(off) - 1, np.int64)
        for part, bounds in windows(data, off):
            _, size, doc = self._pieces(part, bounds)
            total += np.bincount(doc, size, len(off) - 1).astype(np.int64)
        return total

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of each text's ids)."""
        ids, total = [np.zeros(0, np.uint32)], np.zeros(len(off) - 1, np.int64)
        for part, bounds in windows(data, off):
            at, size, doc = self._pieces(part, bounds)
            end = np.cumsum(size, dtype=np.int64)
            if len(end):
                ids.append(self.store[np.repeat(at - (end - size), size) + np.arange(end[-1])])
            total += np.bincount(doc, size, len(off) - 1).astype(np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(total)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a tokenizer file; only the last one used is kept."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
