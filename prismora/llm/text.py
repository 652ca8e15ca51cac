"""Vectorised word kernels over Arrow text columns: no Python object per word.

A word is a maximal run of bytes other than space and \\x09-\\x0D; as all separators are ASCII, this
equals the code-point pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8. Hashes lower-case A-Z on request.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BASE = U(int(_rng.integers(1 << 62)) * 4 + 3)  # 3 mod 4: base - 1 has a single factor of two
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=U)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20
_powers: list[np.ndarray] = [np.ones(0, U), np.ones(0, U)]


def coefficients(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=U) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, HASH_BYTES + 1)
        for k, step in enumerate((_BASE, _INVERSE)):
            p = np.full(n, step, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; nulls count as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    docs: np.ndarray  # byte offset of each document, and the end
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def places(self) -> np.ndarray:
        """Places of the words' bytes."""
        return np.flatnonzero(~_SPACE[self.data])


def split_words(column: pa.Array) -> Words:
    data, docs = raw(column)
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[docs] = True
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, docs, starts, ends, np.searchsorted(starts, docs))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; empty spans are allowed."""
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    if len(data):
        np.cumsum((_BYTES[_LOWER] if lower else _BYTES)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def word_hashes(words: Words, lower: bool = False) -> np.ndarray:
    """Hashes of all words, a stretch of HASH_BYTES at a time."""
    out, lo = np.empty(len(words.starts), U), 0
    while lo < len(out):
        begin = words.starts[lo]
        hi = max(lo + 1, int(np.searchsorted(words.ends, begin + HASH_BYTES, "right")))
        out[lo:hi] = span_hashes(words.data[begin : words.ends[hi - 1]], words.starts[lo:hi] - begin, words.ends[lo:hi] - begin, lower)
        lo = hi
    return out


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are left out."""
    if len(h) < n:
        return np.zeros(0, U)
    r = coefficients(n, 7919 + n)
    out = h[: len(h) - n + 1] * r[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * r[j]
    return mix(out)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one document's word hashes; fewer words count whole, as one."""
    if not len(h):
        return np.zeros(0, U)
    return np.unique(ngram_hashes(h, min(n, len(h))))


#: By operator: frees what it holds in this worker process between tasks.
HELD: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return memory that is free to the system; workers are used again, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], own: str = "") -> Callable[[Iterator], Iterator]:
    """A task's function that first frees what other operators hold in its worker process, and gives back memory when it ends."""

    def whole(batches: Iterator) -> Iterator:
        others = [free for name, free in HELD.items() if name != own]
        for free in others:
            free()
        if others:
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of text; one longer text stays whole, alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
