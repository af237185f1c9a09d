"""Vectorised scanning of text columns inside Arrow tasks.

Everything here works on the UTF-8 bytes of a whole Arrow string column: no Python string is made for a document. A column
is cut into slices of bounded bytes (`slices`), so one very long text is a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Space and the ASCII controls 9 to 13 separate words.
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_BREAK = np.zeros(256, bool)
_BREAK[list(WORD_BREAKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """(first, last) row ranges of at most `most` bytes each; a longer text stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def texts(column, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) for each slice of a column."""
    data, off = column_bytes(column)
    for lo, hi in slices(off, most):
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
    # Workers live on between tasks; what Arrow has freed goes back.
    pa.default_memory_pool().release_unused()


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def spans(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the runs of bytes that are no breaks; no run crosses texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~breaks[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    b, e = off[:-1][full], off[1:][full] - 1
    first[b], last[e] = inside[b], inside[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of lines, empty ones too, without their line feeds; an empty text is one empty line."""
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    # A line feed that ends a text opens an empty last line of that text, not a line of the next.
    doc = np.sort(np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, cut, "right") - 1]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], cut]), kind="stable")
    return starts, ends, doc


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        _powers[kind] = np.cumprod(p, dtype=np.uint64)
    return _powers[kind][:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and their inverses modulo 2**64."""
    return _power("up", _BASE, n), _power("down", _BASE_INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power("up", _BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", _BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def windows_hash(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` item hashes, in order."""
    n = max(0, len(items) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(_BASE) + items[k : k + n]
    return mix(h)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the `width`-word shingles of each text (see `ngram_join` for the rules)."""
    data = lower(data)
    starts, ends, doc = spans(data, off)
    words = span_hashes(data, starts, ends)
    bounds = np.searchsorted(doc, np.arange(len(off)))
    count = np.diff(bounds)
    every = windows_hash(words, width)
    flat = every[doc[: len(every)] == doc[width - 1 :]] if len(every) else every
    ends = np.cumsum(np.maximum(count - (width - 1), 0))
    starts = np.concatenate([[0], ends[:-1]])
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        flat[lo:hi].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[starts[starts < ends]] = True
    flat, kept = flat[new], np.concatenate([[0], np.cumsum(new)])
    out = [flat[lo:hi] for lo, hi in zip(kept[starts].tolist(), kept[ends].tolist())]
    for k in np.flatnonzero((count > 0) & (count < width)).tolist():
        out[k] = windows_hash(words[bounds[k] : bounds[k + 1]], int(count[k]))
    return out


class Memo:
    """Values by 64-bit hash, kept in a table of fixed size: what a task has worked out once it need not work out again.

    A hash has two places in the table. One that finds both taken replaces the first, and what was there is made again when it
    is met again, so memory is bounded whatever the text.
    """

    def __init__(self, width: int, kind=np.int64, bits: int = 19):
        self.bits, self.width, self.kind = bits, width, kind
        self.reset()

    def reset(self) -> None:
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros((1 << self.bits, self.width), self.kind)

    def look(self, hashes: np.ndarray, make) -> np.ndarray:
        """One row of values for each hash; `make(indices)` returns those of the items at the indices, one for each new hash."""
        hashes = np.maximum(hashes, np.uint64(1))
        mask = np.uint64((1 << self.bits) - 1)
        one, two = (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)
        place = np.where(self.keys[one] == hashes, one, two)
        out, new = self.values[place], np.flatnonzero(self.keys[place] != hashes)
        if len(new):
            keys, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            made = make(new[first])
            out[new] = made[inverse]
            where = np.where((self.keys[one[new[first]]] == 0) | (self.keys[two[new[first]]] != 0), one[new[first]], two[new[first]])
            where, which = np.unique(where, return_index=True)
            self.keys[where], self.values[where] = keys[which], made[which]
        return out
