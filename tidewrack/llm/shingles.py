"""Word hashing on the bytes of Arrow string batches: what the set and seed operators build on.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial
of its bytes modulo 2**64, read off running sums, so a batch is hashed in a few array passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MUL = np.uint64(0xC2B2AE3D27D4EB4F)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
#: Texts are hashed this many bytes at a time; a longer text goes alone.
CHUNK_BYTES = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _ROLL
    x ^= x >> np.uint64(29)
    x *= _MUL
    x ^= x >> np.uint64(32)
    return x


def word_hashes(texts: pa.Array, lower: bool = True, marks: np.ndarray | None = None) -> Iterator[tuple]:
    """(first row, offsets, hashes): the word hashes of a few rows at a time, row after
    row; offsets has one more entry than rows. ``lower`` maps A-Z to a-z. Null: no words.
    With ``marks``, a value per byte, also the bitwise or of every word's bytes' marks and
    the words' lengths in bytes."""
    texts = texts.cast(pa.large_string())
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    valid = texts.is_valid().to_numpy(zero_copy_only=False) if texts.null_count else None
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, "right")) - 1
        stop = min(len(texts), max(row + 1, stop))
        a, b = int(ends[row]), int(ends[stop])
        at, *of = _hash(raw[a:b], ends[row:stop + 1] - a, lower, marks)
        if valid is not None and not valid[row:stop].all():  # a null's slot may hold bytes
            own = np.repeat(np.arange(stop - row), np.diff(at))
            keep = valid[row:stop][own]
            of, own = [x[keep] for x in of], own[keep]
            at = np.searchsorted(own, np.arange(stop - row + 1))
        yield row, at, *of
        row = stop


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, counted as :func:`word_hashes` finds them."""
    texts = texts.cast(pa.large_string())
    out = np.zeros(len(texts), np.int32)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return out
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw, row = np.frombuffer(data, np.uint8), 0
    while row < len(texts):
        stop = int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, "right")) - 1
        stop = min(len(texts), max(row + 1, stop))
        b, at = raw[ends[row]:ends[stop]], ends[row:stop + 1] - ends[row]
        first = ~((b == 32) | ((b >= 9) & (b <= 13)))
        border = np.zeros(len(b) + 1, bool)
        border[at] = True
        first[1:] &= ~first[:-1] | border[1:len(b)]
        starts = np.flatnonzero(first)
        out[row:stop] = np.diff(np.searchsorted(starts, at))
        row = stop
    if texts.null_count:
        out[~texts.is_valid().to_numpy(zero_copy_only=False)] = 0
    return out


def _hash(b: np.ndarray, ends: np.ndarray, lower: bool, marks: np.ndarray | None) -> tuple[np.ndarray, ...]:
    n = len(b)
    if not n:
        none = [np.zeros(0, np.int64)] * (0 if marks is None else 2)
        return np.zeros(len(ends), np.int64), np.zeros(0, np.uint64), *none
    seen = b
    if lower:
        b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    border = np.zeros(n + 1, bool)  # a text begins here
    border[ends] = True
    word = ~white
    first = word.copy()
    first[1:] &= white[:-1] | border[1:n]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= white[1:] | border[1:n]
    stops = np.flatnonzero(last) + 1
    power, inverse = _power(n)
    run = np.zeros(n + 1, np.uint64)
    run[1:] = b
    run[1:] += np.uint64(1)
    run[1:] *= power
    np.cumsum(run, out=run)
    h = (run[stops] - run[starts]) * inverse[starts]
    at = np.searchsorted(starts, ends).astype(np.int64)
    if marks is None:
        return at, mix64(h)
    of = np.bitwise_or.reduceat(marks[seen], starts) if len(starts) else np.zeros(0, marks.dtype)  # white space has no marks
    return at, mix64(h), of, stops - starts


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _ROLL + h[i:i + n]
    return mix64(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a text of fewer
    words gives its whole sequence as one, a text without words none."""
    for _, at, h in word_hashes(texts):
        g = grams(h, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                s = np.sort(g[a:b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
            elif b > a:
                yield grams(h[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)
