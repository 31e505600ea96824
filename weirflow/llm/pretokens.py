"""Cutting texts into pretokens with numpy, by runs of letters, numbers, white space and the rest.

This is what the common pretoken patterns do that consist of contractions, runs
of one class, and a rule for spaces: code points are looked up in a table of
classes, a piece begins where the class changes, and the few exceptions
(contractions, the space that goes with what follows it) move beginnings.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)

#: The pretoken patterns that these functions stand for.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BARE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The contractions in them, behind the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, as the regular expression engine sees it."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    out = np.zeros(len(points), dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    return np.concatenate([out[:0xD800], np.zeros(0x800, np.uint8), out[0xD800:]])


class Points:
    """Code points of several texts, one behind the other, given as UTF-8 and the places where they begin."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        raw = data.tobytes()
        self.point = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.kind = classes()[self.point]
        self.at: np.ndarray | None = None  # where each begins in the bytes; None: one byte each
        if len(self.point) != len(data):
            self.at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.first = np.zeros(len(self.point) + 1, dtype=bool)
        self.first[starts if self.at is None else np.searchsorted(self.at, starts)] = True
        self.first[-1] = True

    def bytes_at(self, index: np.ndarray) -> np.ndarray:
        return index if self.at is None else self.at[index]

    def runs(self) -> np.ndarray:
        """Flags: a run of one class, or a text, begins here."""
        out = self.first.copy()
        out[1:-1] |= self.kind[1:] != self.kind[:-1]
        return out

    def contract(self, begin: np.ndarray) -> None:
        """Move beginnings so that contractions are pieces, where the apostrophe begins one."""
        n = len(self.point)
        at = np.flatnonzero(begin[:n] & (np.append(self.point, 0)[:n] == ord("'")))
        at = at[at + 1 < n]
        at = at[~self.first[at + 1]]
        second = self.point[at + 1]
        third = np.where((at + 2 < n) & ~self.first[np.minimum(at + 2, n)], self.point[np.minimum(at + 2, n - 1)], 0)
        for letters in CONTRACTIONS:
            hit = second == ord(letters[0])
            if len(letters) == 2:
                hit &= third == ord(letters[1])
            begin[at[hit] + 1] = False
            begin[at[hit] + 1 + len(letters)] = True


def spaced(points: Points) -> np.ndarray:
    """Where the pieces of the pattern SPACED begin, as numbers of code points, with the end."""
    begin, n = points.runs(), len(points.point)
    # A run of white space gives its last character away if more follows: a blank to what follows, others to themselves.
    after = np.flatnonzero((points.kind[1:] != SPACE) & (points.kind[:-1] == SPACE) & ~points.first[1:n]) + 1 if n else np.empty(0, np.int64)
    begin[after - 1] = True
    begin[after[points.point[after - 1] == ord(" ")]] = False
    points.contract(begin)
    return np.flatnonzero(begin)


def cuttable(data: np.ndarray, most: int) -> list[int]:
    """Places in one text about ``most`` bytes apart where a piece of SPACED is sure to begin: single blanks between visible ASCII characters."""
    out, lo = [0], 0
    while len(data) - lo > most:
        part = data[lo : lo + most]
        dark = (part > 0x20) & (part < 0x7F)
        found = np.flatnonzero((part[1:-1] == 0x20) & dark[:-2] & dark[2:])
        if not len(found):
            most *= 2
            continue
        lo += int(found[-1]) + 1
        out.append(lo)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, one behind the other, and where each begins, with the end (null: empty)."""
    n = len(texts)
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    _, offsets, raw = texts.buffers()
    if raw is None or not n:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    return np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
