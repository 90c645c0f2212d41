"""Words and their 64-bit hashes, computed for a whole Arrow batch at once on its bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial
over random 64-bit values of its bytes, scrambled at the end; equal words have equal hashes everywhere, and
different words among a billion collide with a probability of about three in a hundred.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

SEGMENT = 1 << 20
_random = np.random.default_rng(20240229)
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13 & ~7 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[_SPACE] = 0
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def scramble(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (one more entry for the end); null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _segment(data: np.ndarray, firsts: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """firsts: places in data at which a text begins."""
    inside = ~apart[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[firsts[firsts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power_table(_BASE, len(data))[: len(data)], out=sums[1:])
    return scramble((sums[ends] - sums[starts]) * _power_table(_INVERSE, len(data))[starts]), starts, ends


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the number of words before each text (one more entry for all).

    apart: for each byte, whether it stands between words.
    """
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):  # cut behind a space or between two texts; a longer word makes a longer segment
            text_end = offsets[np.searchsorted(offsets, end, "right") - 1]
            while True:
                spaces = np.flatnonzero(apart[data[max(at, end - 65536) : end]])
                cut = max(int(text_end) if at < text_end <= end else 0, max(at, end - 65536) + int(spaces[-1]) + 1 if len(spaces) else 0)
                if cut > at:
                    end = cut
                    break
                if end == len(data):
                    break
                nearer = np.flatnonzero(apart[data[end : end + SEGMENT]])
                following = int(offsets[np.searchsorted(offsets, end, "right")])
                space = end + int(nearer[0]) + 1 if len(nearer) else min(len(data), end + SEGMENT)
                if len(nearer) or following <= space:
                    end = min(space, following)
                    break
                end = space
        low, high = np.searchsorted(offsets[:-1], (at, end))
        hashes, starts, ends = _segment(data[at:end], offsets[low:high] - at, apart)
        found.append((hashes, starts + at, ends + at))
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of text; a longer text comes alone."""
    for batch in batches:
        sizes = np.array(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        at, total = 0, 0
        for k, size in enumerate(sizes):
            if k > at and total + size > most:
                yield batch.slice(at, k - at)
                at, total = k, 0
            total += size
        if at < len(sizes):
            yield batch.slice(at)
    release()
