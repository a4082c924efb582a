"""Vectorised word hashing for the operators that run in Python workers.

A word is a run of bytes other than space and \\x09-\\x0D. Words, and runs of words, get 64-bit polynomial hashes
from prefix sums, so a batch costs a few numpy passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT, PIECE = 4 << 20, 1 << 19
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
TWIN = (0xF1357AEA2E62A9C5, 0xBB67AE8584CAA73B)  # bases of a second, independent hash
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n; kept up to a segment's length."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, U)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= SEGMENT:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash_runs(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(values)
    sums = np.zeros(n + 1, U)
    np.cumsum((values + U(1)) * _power(base, n), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return mix((sums[end] - sums[start]) * _power(inverse, n + 1)[start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in ``data`` (bytes), and for each document the number of words before it.

    ``bounds``: byte offsets of the documents, one more than there are documents; a word ends where its document does.
    """
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BYTE) -> np.ndarray:
    """One hash per word, in pieces of whole words so that memory follows the piece."""
    out = np.empty(len(start), U)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE, side="right")))
        at = start[lo]
        out[lo:hi] = _hash_runs(data[at : end[hi - 1]].astype(U), base, start[lo:hi] - at, end[lo:hi] - at)
        lo = hi
    return out


def gram_hashes(words: np.ndarray, k: int, base: int = _WORD) -> np.ndarray:
    """The hash of each run of k words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    at = np.arange(n)
    return _hash_runs(words, base, at, at + k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~x, w)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sized(batches: Iterator[pa.RecordBatch], column: str, limit: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each holds about ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
