"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Hashes are polynomials over
bytes (or over word hashes) modulo 2**64 taken from prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
PIECE_BYTES = 1 << 18  # texts worked on at once; a worker keeps what the largest piece needed
KEPT_POWERS = 1 << 19


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    name = "_tillroll_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    cache = worker_cache()
    have = cache.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, dtype=np.uint64)
            out[0] = 1
            both.append(np.cumprod(out, dtype=np.uint64))
        have = tuple(both)
        if size <= KEPT_POWERS:  # a very long text's are not kept
            cache[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Word hashes in order, their byte ranges in ``data`` and the row each belongs to."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row, the index of its first word; one more entry at the end
    data: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset : texts.offset + len(texts) + 1
    ]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range; ranges ascend and do not overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + PIECE_BYTES - 1, side="right")))
        low, high = int(start[at]), int(end[stop - 1])
        power, inverse = _powers(BYTE_BASE, high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        terms = data[low:high].astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: high - low]
        np.cumsum(terms, out=sums[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = (sums[e] - sums[s]) * inverse[s]
        at = stop
    return mix(out)


def words_of(texts: pa.Array) -> Words:
    offsets, data = buffers(texts)
    inside = np.ones(len(data) + 1, dtype=bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    inside[-1] = False
    edge = np.zeros(len(data) + 1, dtype=bool)  # positions at which a text starts or ends
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-2]
    start = np.flatnonzero(inside[:-1] & (~before | edge[:-1]))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    first = np.searchsorted(start, offsets, side="left")
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(_hash_ranges(data, start, end), start, end, row, first, data)


def range_hashes(
    hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = WORD_BASES[0]
) -> np.ndarray:
    """A hash of each range [start, end) of the word hashes."""
    power, inverse = _powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the row of each; repeats are kept.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    last = words.first[words.row + 1] if len(words.row) else np.zeros(0, np.int64)
    index = np.arange(len(words.row))
    full = index + size <= last
    lone = (index == words.first[words.row]) & ~full if len(index) else full
    start = np.flatnonzero(full | lone)
    end = np.minimum(start + size, last[start])
    return range_hashes(words.hashes, start, end), words.row[start]


def give_back() -> None:
    """Hands freed memory back to the system.

    A worker serves one operator after the other; without this it keeps what each of them needed
    at most, and a few workers of one executor add up.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, at least one row each."""
    offsets, _ = buffers(texts)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), len(texts))
        yield at, stop
        at = stop
    if len(texts) and offsets[-1] > limit:
        give_back()
