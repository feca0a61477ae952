"""Whole-text word and shingle hashing over Arrow string columns, in numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after lower-casing A-Z only.
Both act on single bytes of UTF-8, so texts never become Python strings: the functions read the
value buffer of an Arrow array directly.  A word's 64-bit hash is a polynomial in random per-byte
constants, obtained for every word at once from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time; longer texts are cut at white space, and the words joined again.
PIECE = 1 << 20
SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

_space = np.zeros(256, bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
_byte = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_byte[65:91] = _byte[97:123]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), wrapped; kept for the next call."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + 4096), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= PIECE + 4096:
            _powers[int(base)] = known
    return known


def _words_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in data; begins: bytes at which a text begins."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = ~_space[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    np.logical_not(letter[:-1], out=fresh[1:])
    inside = begins[(begins > 0) & (begins < len(data))]
    fresh[inside] = True
    starts = np.flatnonzero(letter & fresh)
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(letter[1:], out=last[:-1])
    last[inside - 1] = True
    ends = np.flatnonzero(letter & last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte[data] * _power(_BASE, len(data))[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * _STEP)), starts


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and the n+1 offsets of a string or binary Arrow array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may span bytes
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if not np.array_equal(sizes, np.diff(offsets)):
            data = np.concatenate([data[a : a + s] for a, s in zip(offsets[:-1], sizes, strict=True)] or [data[:0]])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data, offsets


def runs(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most limit bytes, or of one row."""
    first = 0
    for row in range(1, len(offsets)):
        if offsets[row] - offsets[first] > limit and row - 1 > first:
            yield first, row - 1
            first = row - 1
    if len(offsets) - 1 > first:
        yield first, len(offsets) - 1


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds): the words of row first + i are hashes[bounds[i]:bounds[i + 1]]."""
    data, offsets = buffers(column)
    for first, end in runs(offsets):
        low, high = int(offsets[first]), int(offsets[end])
        if end - first == 1 and high - low > 2 * PIECE:
            parts, at = [], low
            while at < high:
                stop = min(at + PIECE, high)
                while stop < high and not _space[data[stop]]:
                    gap = np.flatnonzero(_space[data[stop : stop + PIECE]])
                    stop = min(stop + (int(gap[0]) if len(gap) else PIECE), high)
                parts.append(_words_of(data[at:stop], np.zeros(0, np.int64))[0])
                at = stop
            hashes = np.concatenate(parts)
            yield first, end, hashes, np.array([0, len(hashes)])
            continue
        begins = offsets[first : end + 1] - low
        hashes, starts = _words_of(data[low:high], begins)
        yield first, end, hashes, np.searchsorted(starts, begins)


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """One sorted array of distinct 64-bit shingle hashes for each row.

    A text of fewer than ``width`` words has one shingle, its whole sequence; one without words has none.
    """
    for _, _, hashes, bounds in word_hashes(column):
        grams = np.zeros(0, np.uint64)
        if len(hashes) >= width:
            grams = hashes[: len(hashes) - width + 1].copy()
            for i in range(1, width):
                grams *= _BASE
                grams += hashes[i : len(hashes) - width + 1 + i]
            grams = mix(grams)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                out = np.sort(grams[a : b - width + 1])
                keep = np.empty(len(out), bool)
                keep[0] = True
                np.not_equal(out[1:], out[:-1], out=keep[1:])
                yield out[keep]
            elif b > a:
                x = np.array([b - a], np.uint64)
                for h in hashes[a:b]:
                    x = mix(x * _STEP + h)
                yield x
            else:
                yield grams[:0]
