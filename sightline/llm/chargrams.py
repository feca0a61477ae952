"""Hashed character n-grams of whole texts, for many rows at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters worked on at a time; longer texts come in pieces that overlap by the longest n-gram less one.
PIECE = 1 << 18
_MULTIPLIER = np.uint32(0x9E3779B1)


def _hashed(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each position; wraps round at the end."""
    out, state = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(orders) + 1):
        state = (state ^ np.roll(codes, 1 - n)) * _MULTIPLIER
        state ^= state >> np.uint32(15)
        if n in orders:
            x = (state ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            out.append((x >> np.uint32(32 - bits)).astype(np.int32))
    return out


def gram_buckets(texts: list[str | None], orders: tuple[int, ...] = (1, 2, 3), bits: int = 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each n-gram, bucket of each n-gram), piece by piece, rows ascending; texts are lower-cased, nulls empty.

    A text is taken between two spaces, so n-grams see word beginnings and ends; no n-gram spans two texts.
    """
    longest = max(orders)

    def emit(rows: list[int], parts: list[str], cut: bool = False):
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) for p in parts], np.int64)
        row = np.repeat(np.array(rows, np.int32), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the part's end
        found = _hashed(codes, orders, bits)
        least = np.ones(len(codes), np.int64)
        if cut:  # what begins in the overlap is the next piece's
            least[len(codes) - len(parts[-1]) :] = longest
        keep = [left >= np.maximum(least, n) for n in orders]
        r = np.concatenate([row[k] for k in keep])
        b = np.concatenate([x[k] for x, k in zip(found, keep, strict=True)])
        order = np.argsort(r, kind="stable")
        return r[order], b[order]

    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        at = 0
        while at < len(text):
            part = text[at : at + PIECE]
            if size + len(part) > PIECE and parts:
                yield emit(rows, parts)
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part)
            at += PIECE
            if at < len(text):  # the next piece begins with what n-grams across the cut need
                at -= longest - 1
                yield emit(rows, parts, cut=True)
                rows, parts, size = [], [], 0
    if parts:
        yield emit(rows, parts)


def sums_by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values over the ascending rows, as an array of n rows."""
    out = np.zeros((n, *values.shape[1:]), np.float64)
    if len(rows):
        cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[cuts]] = np.add.reduceat(values, cuts, axis=0)
    return out
