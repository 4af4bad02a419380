"""Words of many texts at once: numpy over the Arrow buffers, no loop over words.

A text's words are its runs of bytes other than a separator. Words and windows of words have
64-bit polynomial hashes (modulo 2**64, odd base), taken from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

#: Bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_FINAL = ((0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray, kind: int = 0) -> np.ndarray:
    a, b = _FINAL[kind]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(a)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(b)
    return x ^ (x >> np.uint64(31))


def powers(n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    got = _powers.get(kind)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[kind]
        steps = [np.full(size, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        got = _powers[kind] = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
        if size > 4 * SLICE_BYTES:
            _powers.pop(kind)
    return got[0][:n], got[1][:n]


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """A hash of values[start:end] for each pair, wherever the run stands."""
    up, down = powers(len(values) + 1, kind)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), kind)


class Texts:
    """Some texts: their bytes, the rows' offsets, and on demand their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        word = ~space[data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        before[edge] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        after[edge[edge > 0] - 1] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text, its first word

    def hashes(self, kind: int = 0) -> np.ndarray:
        return runs_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, kind)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def places(self) -> np.ndarray:
        """The place of each word in its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], np.diff(self.first))


def windows(hashes: np.ndarray, first: np.ndarray, n: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of n words that stay in one text start, and their hashes."""
    length = np.diff(first)
    left = np.repeat(first[1:], length) - np.arange(len(hashes))
    at = np.flatnonzero(left >= n)
    return at, runs_hash(hashes, at, at + n, kind)


P61 = (1 << 61) - 1
_LOW31 = np.uint64((1 << 31) - 1)
_LOW30 = np.uint64((1 << 30) - 1)
_P61 = np.uint64(P61)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def fold61(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime 2**61 - 1."""
    x = (x & _P61) + (x >> np.uint64(61))
    return np.where(x >= _P61, x - _P61, x)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = ah * bl + al * bh
    return fold61(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + al * bl)


def _powers61(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**61 - 1 for i below n."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, times61(out, np.full(len(out), pow(base, len(out), P61), np.uint64))))
    return out[:n]


def tables61(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse."""
    got = _tables.get(base)
    if got is None or len(got[0]) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 16)
        got = _powers61(base, size), _powers61(pow(base, -1, P61), size)
        _tables.clear()
        if size <= 4 * SLICE_BYTES:
            _tables[base] = got
    return got


def windows61(texts: Texts, at: np.ndarray, n: int, base: int, block: int = 1 << 22) -> np.ndarray:
    """For windows of n words from word at on: the polynomial of their bytes (words one symbol apart) at base, modulo 2**61 - 1.

    Two windows that differ have equal values for at most as many bases as they have bytes.
    """
    length = texts.ends - texts.starts
    edge = np.concatenate(([0], np.cumsum(length)))
    up, down = tables61(base, int(edge[-1]) + len(length) + 1)
    inside = np.zeros(len(texts.data) + 1, np.int8)
    inside[texts.starts] = 1
    inside[texts.ends] -= 1
    raw = texts.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    word = np.repeat(np.arange(len(length)), length)
    high, low = np.zeros(len(edge), np.uint64), np.zeros(len(edge), np.uint64)
    carry = [np.uint64(0), np.uint64(0)]
    for a in range(0, len(raw), block):  # sums of so many products stay below 2**64
        b = min(a + block, len(raw))
        value, power = raw[a:b].astype(np.uint64) + np.uint64(1), up[np.arange(a, b) + word[a:b]]
        ends = slice(*np.searchsorted(edge, (a + 1, b + 1)))
        for k, (out, part) in enumerate(((high, power >> np.uint64(31)), (low, power & _LOW31))):
            sums = np.cumsum(value * part)
            out[ends] = fold61(sums[edge[ends] - a - 1] + carry[k])
            carry[k] = fold61(sums[-1:] + carry[k])[0]
    total = fold61(times61(high, np.full(1, 1 << 31, np.uint64)) + low)
    span = fold61(total[at + n] + _P61 - total[at])
    return times61(span, down[edge[at] + at])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and offsets (from 0); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batch with about limit bytes of text together; a longer text stands alone."""
    raw, at = buffers(batch.column(batch.schema.get_field_index(column)))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        yield batch.slice(k, end - k), raw[at[k] : at[end]], at[k : end + 1] - at[k]
        k = end
