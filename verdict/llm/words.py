"""Words and word hashes of Arrow text batches, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes (these bytes never occur
inside a longer UTF-8 sequence). Hashes are 64 bit and the same on every
machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
CHUNK_BYTES = 1 << 20   # bytes hashed at a time
SLICE_BYTES = 1 << 20   # text bytes of one slice of a batch (a longer text is a slice of its own)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def constants(seed: int, n: int, odd: bool = True) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        c = mix64(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))
    return c | _U(1) if odd else c


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BYTE = constants(11, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = int(constants(12, 1)[0])
_BASE_INV = pow(_BASE, -1, 1 << 64)


class _Cache(dict):
    """Arrays made once a process. Pickled empty: functions that are sent by
    value take no arrays of the driver with them."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def _power(name: str, base: int, n: int) -> np.ndarray:
    p = _powers.get(name)
    if p is None or len(p) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        p = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return p[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset:a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches, text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of about ``max_bytes`` of text, so
    that what a worker holds does not depend on the batch."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // max_bytes
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield b.slice(int(i), int(j - i))


class Words:
    """Words of a text column: byte ranges ``start``/``end`` in ``raw``, row
    ``doc``, and ``first`` (n rows + 1): the words of row i are
    ``first[i]:first[i + 1]``."""

    def __init__(self, column: pa.Array, is_word: np.ndarray = _IS_WORD):
        self.raw, self.offsets = raw, offsets = text_buffer(column)
        inside = is_word[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(raw)]
        before[begins] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(raw), bool)
        after[:-1] = inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        after[ends] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False, table: np.ndarray | None = None,
               prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` takes A-Z as a-z, ``table``
        gives each byte's value, ``prefix`` takes a word's first bytes only."""
        if table is None:
            table = _BYTE_LOWER if lower else _BYTE
        out = np.empty(len(self.start), np.uint64)
        i, n = 0, len(self.start)
        while i < n:
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + CHUNK_BYTES, "right")))
            length = int(self.end[j - 1] - at)
            with np.errstate(over="ignore"):
                total = np.zeros(length + 1, np.uint64)
                np.cumsum(table[self.raw[at:at + length]] * _power("up", _BASE, length), out=total[1:])
                s, e = self.start[i:j] - at, self.end[i:j] - at
                if prefix is not None:
                    e = np.minimum(e, s + prefix)
                out[i:j] = (total[e] - total[s]) * _power("down", _BASE_INV, length)[s]
            i = j
        return mix64(out)


def runs(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash for each ``width`` consecutive entries of h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(constants(seed, width)):
            out += h[j:j + n] * c
    return mix64(out)
