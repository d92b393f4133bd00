"""Vectorised words and hashes over the flat byte buffer of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are
polynomials modulo 2**64 of prefix sums, mixed at the end: the hash of any
slice costs two look-ups, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
IS_GAP = np.zeros(256, dtype=bool)
IS_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    have = _POWERS.get("p")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        out = []
        for b in (BASE, pow(BASE, -1, 2 ** 64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = tuple(out)
        if size <= 4 * CHUNK_BYTES:
            _POWERS["p"] = have
    return have


class SliceHash:
    """Hashes of slices of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        p, self.inverse = powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * p[:len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets into them; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = 1 << 13):
    """Ranges of rows of about ``most`` bytes (and ``rows`` rows) at most; a
    longer text is one range."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n, a + rows)
        yield a, b
        a = b


IS_NO_LETTER = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])


def find_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and for each row (n+1) the
    number of words before it. Words never cross rows."""
    solid = ~gap[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_GAP):
    """Starts, ends, words before each row, and a 64-bit hash per word."""
    starts, ends, before = find_words(data, offsets, gap)
    return starts, ends, before, SliceHash(BYTE_CODES[data]).of(starts, ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0)).astype(np.uint8)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours; length len(x) - w + 1."""
    n, have, m = len(x) - w + 1, 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[:n], m[w - have:w - have + n])
    return m[:n]


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, joined by one space."""
    if not len(starts):
        return b""
    sizes = ends - starts
    out = np.full(int(sizes.sum()) + len(sizes) - 1, 0x20, dtype=np.uint8)
    before = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    out[inner + np.repeat(before + np.arange(len(sizes)), sizes)] = data[inner + np.repeat(starts, sizes)]
    return out.tobytes()


def text_array(parts: list[bytes]) -> pa.Array:
    """UTF-8 pieces as a string column."""
    return pa.array(parts, pa.binary()).cast(pa.string())
