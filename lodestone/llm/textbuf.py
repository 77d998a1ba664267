"""Vectorised work on the UTF-8 bytes of whole Arrow batches of texts.

The Python operators see texts as one byte buffer with row offsets and run
numpy over it, so that no per-word Python objects are made.  Words are maximal
runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task (a longer text is handled alone).
CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Places in a run whose bytes' values are looked up rather than computed.
_TABLE_PLACES = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); x is left as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(_TABLE_PLACES << 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def places(n: int, starts: np.ndarray) -> np.ndarray:
    """Of n bytes, each one's place in its run; before the first run counted from 0."""
    at = np.arange(n, dtype=np.int64)
    first = np.zeros(n, dtype=np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    at -= first
    return at


def run_hashes(buf: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs that begin at `starts`; bytes where `keep` is false don't count.

    A hash sums up a random value of each byte at its place.  (A polynomial
    modulo 2**64 doesn't do: it maps long regular runs to the same hash.)
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    slot = places(len(buf), starts)
    slot <<= 8
    slot |= buf
    values = _TABLE[np.minimum(slot, len(_TABLE) - 1)]
    far = np.flatnonzero(slot >= len(_TABLE))
    if len(far):
        values[far] = mix(slot[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    values[~keep] = 0
    return mix(np.add.reduceat(values, starts))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each row's number of words."""
    rows = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    keep = IS_WORD[buf]
    fresh = np.empty(len(buf), dtype=bool)
    fresh[0] = True
    np.logical_not(keep[:-1], out=fresh[1:])
    inner = offsets[:-1]
    fresh[inner[inner < len(buf)]] = True
    starts = np.flatnonzero(keep & fresh)
    counts = np.diff(np.searchsorted(starts, offsets, side="left"))
    return run_hashes(LOWER[buf], keep, starts), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a row, and each shingle's row.

    A row of 1 to size - 1 words has one shingle, of all its words; a row
    without words has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    coeff = powers(size + 1)[1:]
    long = np.flatnonzero(np.arange(n) + size <= ends[row]) if n else np.zeros(0, np.int64)
    out = np.zeros(len(long), np.uint64)
    for j in range(size):
        out += hashes[long + j] * coeff[j]
    out = mix(out + np.uint64(size))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            extra[has] += hashes[begins[short[has]] + j] * coeff[j]
        extra = mix(extra + counts[short].astype(np.uint64))
        out, row_of = np.concatenate([out, extra]), np.concatenate([row[long], short])
        order = np.argsort(row_of, kind="stable")
        return out[order], row_of[order]
    return out, row[long] if n else np.zeros(0, np.int64)
