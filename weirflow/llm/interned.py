"""Numbers for byte strings, given out in bulk and kept from call to call.

Strings of up to 16 bytes are compared whole, as two 64-bit words; longer ones
by 128 bits of a hash.  What is kept is bounded by a number of entries, each of
a fixed size.
"""

from __future__ import annotations

import numpy as np
import xxhash

from weirflow.llm.shingles import mix

_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words that, with the size, stand for each string data[start:end]."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(len(data) + 8, dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    low = words[start] & _MASK[np.minimum(size, 8)]
    high = words[np.minimum(start + 8, len(data))] & _MASK[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = data.tobytes()
        digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        low[long], high[long] = np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T
    return low, high


class Interned:
    """Equal strings get equal numbers, from 0 on."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        """Forget everything; numbers begin anew."""
        self.salt = np.uint64(0)
        self.hash, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.low, self.high, self.size = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.size) > self.most

    def _hashed(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(low ^ mix(high + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.salt))

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each string data[start:end], and which strings are the first of theirs, by number."""
        low, high = keys(data, start, end)
        size = end - start
        while True:
            hashes = self._hashed(low, high, size)
            distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
            old = self.hash[at] == distinct if len(self.hash) else np.zeros(len(distinct), dtype=bool)
            known = self.number[at[old]]
            same = (low[first][which] == low) & (high[first][which] == high) & (size[first][which] == size)
            kept = (self.low[known] == low[first[old]]) & (self.high[known] == high[first[old]]) & (self.size[known] == size[first[old]])
            if same.all() and kept.all():
                break
            # Two different strings have one hash: hash all of them in another way.
            self.salt = mix(np.array([self.salt + np.uint64(1)]))[0]
            fresh = self._hashed(self.low, self.high, self.size)
            order = np.argsort(fresh)
            self.hash, self.number = fresh[order], order
        new = first[~old]
        given = np.empty(len(distinct), dtype=np.int64)
        given[old] = known
        given[~old] = len(self.size) + np.arange(len(new))
        self.low, self.high, self.size = (np.concatenate(x) for x in ((self.low, low[new]), (self.high, high[new]), (self.size, size[new])))
        spot = np.searchsorted(self.hash, distinct[~old])
        self.hash, self.number = np.insert(self.hash, spot, distinct[~old]), np.insert(self.number, spot, given[~old])
        return given[which], new


class Lists:
    """Lists of numbers in one growing array: list k is pool[start[k]:start[k + 1]]."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.pool, self.used = np.empty(1024, self.kind), 0
        self.start = np.zeros(1, dtype=np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Add lists, one behind the other in ``flat``."""
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes)])
        self.used += len(flat)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the given numbers, one behind the other, and their sizes."""
        return gathered(self.pool, self.start[numbers], self.start[numbers + 1] - self.start[numbers])


def gathered(pool: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[start:start + size] of all, one behind the other, and the sizes."""
    ends = np.cumsum(sizes)
    at = np.repeat(start - (ends - sizes), sizes)
    at += np.arange(len(at))
    return pool[at], sizes
