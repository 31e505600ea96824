"""Sets of hashed word shingles, for whole batches of texts at a time in numpy.

Words are the runs of bytes other than ASCII white space, with A-Z lower-cased.
A word's hash is a polynomial over its bytes, taken as a difference of running
sums, so that no word becomes a Python object; a shingle's is a weighted sum of
its words' hashes, mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

STEP = 1 << 16  #: bytes hashed at a time (what stays in cache), but for longer words

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_CODE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, on whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def _segments(data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of ``data`` at blanks or ends of texts, about STEP apart."""
    out, lo = [], 0
    while lo < len(data):
        hi = min(lo + STEP, len(data))
        if hi < len(data):
            at = int(ends[np.searchsorted(ends, hi, side="right") - 1]) if len(ends) and ends[0] <= hi else 0
            if at > lo:
                hi = at
            else:
                blanks = np.flatnonzero(_BLANK[data[lo:hi]])
                if len(blanks) and blanks[-1]:
                    hi = lo + int(blanks[-1])
                else:  # one long word: up to the next blank or end
                    rest = np.flatnonzero(_BLANK[data[hi:]])[:1]
                    stop = int(ends[np.searchsorted(ends, hi, side="left")])
                    hi = min(stop, hi + int(rest[0])) if len(rest) else stop
        out.append((lo, hi))
        lo = hi
    return out


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and their hashes; texts begin and end at ``starts`` and ``ends`` within ``data``."""
    solid = ~_BLANK[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[starts[starts < len(data)]] = False
    after[ends[ends > 0] - 1] = False
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[data] * power[: len(data)], out=sums[1:])
    hashes = (sums[last] - sums[first]) * inverse[first]
    return first, mix(hashes + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and how many each text has (null: none)."""
    n = len(texts)
    texts = texts.cast(pa.large_string()) if n else pa.array([], pa.large_string())
    _, offsets, raw = texts.buffers()
    if raw is None or not n:
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    found, at = [], []
    for lo, hi in _segments(data, bounds[1:]):
        inside = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, side="right")] - lo
        first, hashes = _words(data[lo:hi], inside, inside)
        at.append(first + lo)
        found.append(hashes)
    at, found = np.concatenate([np.empty(0, np.int64), *at]), np.concatenate([np.empty(0, np.uint64), *found])
    counts = np.diff(np.searchsorted(at, bounds))
    if texts.null_count:
        # A null slot may cover bytes, which count for nothing.
        gone = texts.is_null().to_numpy(zero_copy_only=False)
        found, counts = found[~np.repeat(gone, counts)], np.where(gone, 0, counts)
    return found, counts


def _combined(words: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at ``starts``."""
    out = np.full(len(starts), size * 0x2545F4914F6CDD1D % 2**64, dtype=np.uint64)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)  # unrelated to each other: (a, b, b, a) is not (b, a, a, b)
    for k in range(size):
        out += words[starts + k] * weights[k]
    return mix(out)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sorted hashes of its distinct shingles of ``size`` words, one text behind the other, and their numbers.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    words, counts = word_hashes(texts)
    begin = np.cumsum(counts) - counts
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), many)
    starts = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    out = np.empty(len(owner), dtype=np.uint64)
    for k in range(1, size + 1):
        own = counts[owner] >= size if k == size else counts[owner] == k
        if own.any():
            out[own] = _combined(words, k, starts[own])
    ends = np.cumsum(many).tolist()
    for a, b in zip([0, *ends], ends):  # noqa: B905 - the last end has no successor
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.bincount(owner[fresh], minlength=len(counts)).astype(np.int64)


def runs(texts: pa.Array, most: int = 1 << 22) -> list[tuple[int, int]]:
    """Cuts of an array of texts into runs of at most so many bytes, but for single longer texts."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right")))
        out.append((at, stop))
        at = stop
    return out


def names_of(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The 128-bit name of each set: a hash of its sorted shingles."""
    ends = np.cumsum(sizes).tolist()
    return [xxhash.xxh3_128_digest(flat[b - n : b].data) if n else b"" for b, n in zip(ends, sizes.tolist(), strict=True)]


def short_names(names: list[bytes]) -> np.ndarray:
    """The first 64 bits of names, as signed numbers (0 for an empty set)."""
    return np.frombuffer(b"".join(n[:8] if n else bytes(8) for n in names), dtype="<i8")
