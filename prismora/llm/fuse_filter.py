"""Binary-fuse filters (Graf and Lemire 2022): static 3-wise filters with 8-bit fingerprints, about 9 bits a key.

Peeling and assignment run in vectorised rounds: keys peeled in one round own slots that no other remaining key
touches, so the reverse assignment of a round is one array operation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .text import U, mix


@dataclass
class FuseFilter:
    seed: int
    segment: int  # slots in a segment, a power of two
    segments: int
    slots: bytes  # fingerprints

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.int64).view(U))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was added, and for about 1 of 256 others."""
        if not self.slots:
            return np.zeros(len(keys), bool)
        table = np.frombuffer(self.slots, np.uint8)
        h, at = _places(keys, self.seed, self.segment, self.segments)
        return table[at[0]] ^ table[at[1]] ^ table[at[2]] == _fingerprint(h)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U(32))).astype(np.uint8)


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + U(seed))
    first = (h >> U(32)) * U(segment * (segments - 2)) >> U(32)
    mask = U(segment - 1)
    return h, np.stack([first, (first + U(segment)) ^ (h >> U(18) & mask), (first + U(2 * segment)) ^ (h & mask)]).astype(np.int64)


def build(keys: np.ndarray, max_tries: int = 100) -> FuseFilter:
    """The filter of a set of unsigned 64-bit keys; repeats are dropped, no keys give a filter without slots."""
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return FuseFilter(0, 4, 3, b"")
    segment = 1 << min(18, max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    capacity = n * max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(max(n, 2)))
    for attempt in range(max_tries):
        segments = max(3, int(np.ceil(capacity * (1 + 0.02 * attempt) / segment)) + 2)
        seed = int(mix(np.array([attempt + 1], U))[0])
        h, at = _places(keys, seed, segment, segments)
        order = _peel(at, segment * segments)
        if order is None:
            continue
        table = np.zeros(segment * segments, np.uint8)
        want = _fingerprint(h)
        for who, where in reversed(order):
            # the owned slot is still 0, so the three slots xor to the other two
            table[where] = want[who] ^ table[at[0, who]] ^ table[at[1, who]] ^ table[at[2, who]]
        return FuseFilter(seed, segment, segments, table.tobytes())
    raise RuntimeError("no seed peels this key set")


def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    n = at.shape[1]
    degree = np.bincount(at.ravel(), minlength=size)
    # sum of key indices in a slot: with degree 1 it is the key itself
    owner = np.zeros(size, np.int64)
    for row in at:
        np.add.at(owner, row, np.arange(n))
    rounds, left = [], n
    alone = np.flatnonzero(degree == 1)
    while len(alone):
        who, pick = np.unique(owner[alone], return_index=True)
        rounds.append((who, alone[pick]))
        left -= len(who)
        touched = at[:, who].ravel()
        np.subtract.at(degree, touched, 1)
        np.subtract.at(owner, touched, np.tile(who, 3))
        alone = np.unique(touched)
        alone = alone[degree[alone] == 1]
    return None if left else rounds
