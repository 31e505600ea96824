"""SentencePiece encoding that keeps, for every piece, the bytes of the text that it came from.

A text is normalised by longest prefixes: the model's compiled character map is a
double array over bytes, and all places of a batch walk it together, one byte a
step.  Every normalised character records where in the source its rule began, so
that pieces, which are runs of normalised characters, project to spans of source
bytes.

Merging goes on within chunks.  Two neighbouring characters that stand side by
side in no piece of the vocabulary can never end up in one piece; texts are cut
there, equal chunks are merged once (:mod:`weirflow.llm.interned`), short ones as
rows of a matrix, long ones by a heap.  A merge takes the pair whose piece has
the highest score, the leftmost among equals.

Defined results: a null text counts as empty; an empty text has no pieces but the
begin and end ids that are asked for; very long texts are taken whole, in parts
where the model allows a cut; rows are independent (repeated rows, null ids,
ties); empty tables give empty tables; only the columns named are read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import pretokens
from weirflow.llm.interned import Interned, Lists, gathered

#: The mark that stands for a blank, what an unknown piece decodes to, and what a broken byte decodes to.
MARK, UNKNOWN_TEXT, BROKEN = "▁", " ⁇ ", "�"
#: Kinds of pieces and of models in the model's file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

NEVER = np.int32(2**31 - 1)  #: the rank of a pair that does not merge
MATRIX = 32  #: chunks of up to so many characters are merged as rows of a matrix
CELLS = 1 << 17  #: characters in one matrix
KEPT, KEPT_IDS = 600_000, 4_000_000  #: chunks that a worker keeps, and ids of them: about 70 MB
GROUP = 1 << 21  #: bytes of text encoded at a time, but for longer chunks


# -- the model's file ----------------------------------------------------------


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        wire = key & 7
        if wire == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(wire) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class CharMap:
    """A compiled character map: the longest rule that is a prefix of what follows, and what it writes instead."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4 if compiled else 0).astype(np.int64)
        self.blob = compiled[4 + size :]
        self._written: dict[int, tuple[list[int], int]] = {}

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rules that fit the bytes from each place on, the longest one's size (0: none) and its offset in the blob."""
        size, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        jump = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        live = np.arange(len(at))
        node, depth = np.full(len(at), jump(self.units[0])), 0
        while len(live):
            more = at[live] + depth < end[live]
            live, node = live[more], node[more]
            byte = data[at[live] + depth].astype(np.int64)
            node = node ^ byte
            known = node < len(self.units)
            unit = self.units[np.where(known, node, 0)]
            fits = known & ((unit & ((1 << 31) | 255)) == byte)
            live, unit, depth = live[fits], unit[fits], depth + 1
            node = node[fits] ^ jump(unit)
            leaf = ((unit >> 8) & 1).astype(bool)
            size[live[leaf]] = depth
            value[live[leaf]] = self.units[node[leaf]] & ((1 << 31) - 1)
        return size, value

    def written(self, offset: int) -> tuple[list[int], int]:
        """The characters of a rule's right side, and how many blanks they begin with."""
        if offset not in self._written:
            text = self.blob[offset : self.blob.index(b"\0", offset)].decode()
            self._written[offset] = ([ord(c) for c in text], len(text) - len(text.lstrip(" ")))
        return self._written[offset]


class Model:
    """Vocabulary and normalisation of one model."""

    def __init__(self, raw: bytes) -> None:
        self.piece: list[str] = []
        self.kind: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.piece.append(f.get(1, b"").decode())
                self.kind.append(f.get(3, NORMAL))
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            elif number in (2, 3):
                (trainer if number == 2 else rules).update(_fields(value))
        if trainer.get(3, 1) != BPE or USER in self.kind or UNUSED in self.kind or trainer.get(24, 0):
            raise ValueError("only merging models with marks before words, without pieces of the user's, are understood")
        self.chars = CharMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        self.fallback = bool(trainer.get(35, 0))
        self.unknown = self.kind.index(UNKNOWN)
        named = {p: i for i, p in enumerate(self.piece) if self.kind[i] == CONTROL}
        self.begin, self.end = (named.get(trainer.get(k, d).decode(), self.unknown) for k, d in ((46, b"<s>"), (47, b"</s>")))
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.piece) if self.kind[i] == BYTE}
        self._merges(scores)
        self._surfaces()

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as file:
            return cls(file.read())

    def _merges(self, scores: list[float]) -> None:
        """Pairs of symbols that merge, and characters that may stand side by side in a piece."""
        pieces = {p: i for i, p in enumerate(self.piece) if self.kind[i] == NORMAL}
        # Characters of pieces that are no pieces themselves get numbers behind the vocabulary.
        extra = sorted({c for p in pieces if len(p) > 1 for c in p if c not in pieces})
        self.symbols = pieces | {c: len(self.piece) + k for k, c in enumerate(extra)}
        self.extra = extra
        rank = {s: r for r, s in enumerate(sorted({scores[i] for i in pieces.values()}, reverse=True))}
        self.base = len(self.piece) + len(extra)
        self.pairs: dict[int, tuple[int, int]] = {}
        sides: set[tuple[str, str]] = set()
        for text, i in pieces.items():
            for cut in range(1, len(text)):
                left, right = self.symbols.get(text[:cut]), self.symbols.get(text[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.base + right] = (rank[scores[i]], i)
                sides.add((text[cut - 1], text[cut]))
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.pair_key = np.append(keys, np.int64(2**62))
        self.pair_rank = np.array([*(self.pairs[k][0] for k in keys.tolist()), NEVER], dtype=np.int32)
        self.pair_to = np.array([*(self.pairs[k][1] for k in keys.tolist()), -1], dtype=np.int32)
        # Characters by class: those that stand beside others in pieces, the rest being 0.
        beside = sorted({c for pair in sides for c in pair})
        self.klass = np.zeros(0x110000, dtype=np.int32)
        self.klass[[ord(c) for c in beside]] = np.arange(1, len(beside) + 1)
        width = len(beside) + 1
        self.joined = np.zeros(width * width, dtype=bool)
        self.width = width
        for a, b in sides:
            self.joined[self.klass[ord(a)] * width + self.klass[ord(b)]] = True
        self.cuttable = not self.chars and not self.squeeze and self.escape and not any(b == MARK and a != MARK for a, b in sides)
        self.char_symbol = np.full(0x110000, -1, dtype=np.int32)
        for text, i in self.symbols.items():
            if len(text) == 1:
                self.char_symbol[ord(text)] = i

    def _surfaces(self) -> None:
        """What each id decodes to, as bytes; bytes stand for themselves."""
        plain = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNKNOWN: lambda p: UNKNOWN_TEXT.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        raw = [plain[k](p) for p, k in zip(self.piece, self.kind, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.is_byte = np.array([k == BYTE for k in self.kind])
        self.is_control = np.array([k == CONTROL for k in self.kind])
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(self.piece, self.kind, strict=True)])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair in the table of merges; the last one is that of pairs that do not merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_key, key)
        return np.where((left >= 0) & (right >= 0) & (self.pair_key[at] == key), at, len(self.pair_key) - 1)


# -- normalisation -------------------------------------------------------------


class Normalised:
    """Normalised characters of several texts, one behind the other, and where in the source each began."""

    def __init__(self, model: Model, data: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> None:
        """``bounds``: where texts begin in the bytes, with the end; ``whole``: flags of those that begin a text and not a later part of one."""
        text = data.tobytes().decode("utf-8", "surrogatepass")
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ascii_only = len(point) == len(data)
        # Where each character begins in the bytes, with the end.
        at = np.arange(len(data) + 1, dtype=np.int32) if ascii_only else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int32)
        first = bounds if ascii_only else np.searchsorted(at, bounds)
        heading = point == 32
        lead = bounds[:-1]  # where what is left of a text begins
        if model.chars:
            point, at, first, heading, other = self._mapped(model, data, point, at, first)
        else:
            other = at[:-1][~heading]
        if model.squeeze:
            point, at, first = self._squeezed(point, at, first, heading)
            lead = np.append(other, len(data))[np.searchsorted(other, lead)]
        if model.prefix:
            filled = np.flatnonzero((lead < bounds[1:]) & whole)
            put = first[filled]
            first = first + np.searchsorted(filled, np.arange(len(first)))
            point, at = np.insert(point, put, ord(" ")), np.insert(at, put, lead[filled])
        if model.escape:
            point = np.where(point == ord(" "), np.uint32(ord(MARK)), point)
        stop = bounds[1:]
        if model.squeeze:
            point, at, first, stop = self._trimmed(point, at, first, stop, ord(MARK) if model.escape else 32)
        self.point, self.at, self.first, self.stop = point, at, first, stop

    @staticmethod
    def _mapped(model: Model, data: np.ndarray, point: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Apply the character map: (characters, where each began, first of each text, blanks that head what a rule writes, where all but blanks begin)."""
        start, n = at[:-1].astype(np.int64), len(point)
        bounds = at[first].astype(np.int64)
        size, value = model.chars.longest(data, start, bounds[np.searchsorted(bounds, start, side="right")])
        after = np.arange(1, n + 1)
        hit = np.flatnonzero(size)
        after[hit] = np.searchsorted(at, start[hit] + size[hit])
        # What a rule before has taken begins nothing; only rules over several characters take some.
        taken = np.zeros(n + 1, dtype=bool)
        for i in hit[after[hit] > hit + 1].tolist():
            if not taken[i]:
                taken[i + 1 : after[i]] = True
        kept = np.flatnonzero(~taken[:n])
        ruled = size[kept] > 0
        spots = kept[ruled]
        distinct, which = np.unique(value[spots], return_inverse=True)
        written = [model.chars.written(int(v)) for v in distinct]
        length = np.ones(len(kept), dtype=np.int64)
        own = np.array([len(w) for w, _ in written], dtype=np.int64)
        length[ruled] = own[which] if len(own) else 0
        ends = np.cumsum(length)
        out, src = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32), np.repeat(at[:-1][kept], length)
        plain = ends[~ruled] - 1
        out[plain] = point[kept[~ruled]]
        heading = np.zeros(len(out), dtype=bool)
        heading[plain] = out[plain] == 32
        if len(written):
            pool = np.array([c for w, _ in written for c in w], dtype=np.uint32)
            head = np.array([k < h for w, h in written for k in range(len(w))], dtype=bool)
            begin = np.cumsum(own) - own
            to, _ = gathered(np.arange(len(out)), (ends - length)[ruled], length[ruled])
            out[to], heading[to] = gathered(pool, begin[which], own[which])[0], gathered(head, begin[which], own[which])[0]
        before = np.concatenate([[0], ends])
        blank = (length == 1) & (np.append(out, 0)[ends - length] == 32)
        return out, np.append(src, at[-1]), before[np.searchsorted(kept, first)], heading, at[kept[~blank]]

    @staticmethod
    def _squeezed(point: np.ndarray, at: np.ndarray, first: np.ndarray, heading: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without blanks that head a rule's writing behind another blank or at the beginning of a text."""
        opens = np.zeros(len(point) + 1, dtype=bool)
        opens[first] = True
        gone = heading & (opens[:-1] | np.concatenate([[False], point[:-1] == 32])[: len(point)])
        return Normalised._without(point, at, first, gone)

    @staticmethod
    def _without(point: np.ndarray, at: np.ndarray, first: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = np.concatenate([[0], np.cumsum(~gone)])
        return point[~gone], np.append(at[:-1][~gone], at[-1]), before[first]

    @staticmethod
    def _trimmed(point: np.ndarray, at: np.ndarray, first: np.ndarray, stop: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Without the blanks at the end of each text; ``stop``: where in the source the last piece of each text ends."""
        if not len(point):
            return point, at, first, stop
        dark = np.maximum.accumulate(np.where(point != blank, np.arange(len(point)), -1))
        filled = first[1:] > first[:-1]
        final = np.where(filled, np.maximum(dark[np.maximum(first[1:] - 1, 0)], first[:-1] - 1), first[:-1] - 1)
        stop = np.where(final + 1 < first[1:], at[np.minimum(final + 1, len(point))], stop)
        text = np.searchsorted(first, np.arange(len(point)), side="right") - 1
        return *Normalised._without(point, at, first, np.arange(len(point)) > final[text]), stop


# -- merging -------------------------------------------------------------------


def merge_matrix(symbols: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Merge rows of symbols (-1: none) until nothing merges: the symbols that are left, and how many characters each has."""
    tok = symbols.copy()
    m, width = tok.shape
    span = (tok >= 0).astype(np.int32)
    pair = model.pair(tok[:, :-1], tok[:, 1:])
    rank = model.pair_rank[pair]
    live = np.flatnonzero((rank != NEVER).any(axis=1))
    column = np.arange(width)
    while len(live):
        t, s, r, p = tok[live], span[live], rank[live], pair[live]
        row = np.arange(len(live))
        i = r.argmin(axis=1)
        t[row, i] = model.pair_to[p[row, i]]
        s[row, i] += s[row, i + 1]
        # What stands behind the pair moves up by one.
        source = np.minimum(column + (column > i[:, None]), width - 1)
        t, s = np.take_along_axis(t, source, 1), np.take_along_axis(s, source, 1)
        t[:, -1], s[:, -1] = -1, 0
        p = np.take_along_axis(p, np.minimum(source[:, :-1], width - 2), 1)
        p[:, -1] = len(model.pair_key) - 1
        p[row, i] = model.pair(t[row, i], t[row, i + 1])
        has = np.flatnonzero(i > 0)
        p[has, i[has] - 1] = model.pair(t[has, i[has] - 1], t[has, i[has]])
        r = model.pair_rank[p]
        tok[live], span[live], rank[live], pair[live] = t, s, r, p
        live = live[(r != NEVER).any(axis=1)]
    return tok, span


def merge_long(symbols: list[int], model: Model) -> list[tuple[int, int]]:
    """(symbol, characters) of one long chunk, by a heap of pairs; an entry that a merge has outdated is passed over."""
    n, pairs, base = len(symbols), model.pairs, model.base
    token, span = list(symbols), [1] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            found = pairs.get(token[i] * base + token[j])
            if found is not None:
                heapq.heappush(heap, (found[0], i, found[1], token[i], token[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to, left, right = heapq.heappop(heap)
        j = after[i]
        if span[i] == 0 or j >= n or token[i] != left or token[j] != right:
            continue
        token[i], span[i], span[j] = to, span[i] + span[j], 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append((token[i], span[i]))
        i = after[i]
    return out


class Codec:
    """Encodes and decodes by one model; keeps the pieces of chunks."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known, self.ids, self.spans = Interned(KEPT), Lists("int32"), Lists("int32")

    def encode(self, data: np.ndarray, bounds: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of texts, one behind the other, how many each has, and the source bytes at which each piece begins and ends."""
        model, texts = self.model, len(bounds) - 1
        if self.known.full or self.ids.used > KEPT_IDS:
            for x in (self.known, self.ids, self.spans):
                x.clear()
        normal = Normalised(model, data, bounds, np.ones(texts, dtype=bool) if whole is None else whole)
        point, first = normal.point, normal.first
        if not len(point):
            return np.empty(0, np.int32), np.zeros(texts, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        klass = model.klass[point]
        opens = np.ones(len(point) + 1, dtype=bool)
        opens[1:-1] = ~model.joined[klass[:-1] * model.width + klass[1:]]
        opens[first] = True
        chunk = np.flatnonzero(opens)
        size = 1 + (point >= 0x80).astype(np.int32) + (point >= 0x800) + (point >= 0x10000)
        place = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(point.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        number, new = self.known.numbers(raw, place[chunk[:-1]], place[chunk[1:]])
        self._learn(point, chunk[new], chunk[new + 1])
        ids, sizes = self.ids.gather(number)
        spans, _ = self.spans.gather(number)
        ends = np.cumsum(spans, dtype=np.int64)
        begin, end = normal.at[ends - spans], normal.at[ends]
        before = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(before[np.searchsorted(chunk, first)])
        end[np.cumsum(counts)[counts > 0] - 1] = normal.stop[counts > 0]
        if not model.fallback:  # unknown characters side by side are one piece
            lost = ids == model.unknown
            open_text = np.zeros(len(ids) + 1, dtype=bool)
            open_text[np.concatenate([[0], np.cumsum(counts)])] = True
            more = lost & np.concatenate([[False], lost[:-1]]) & ~open_text[:-1]
            kept = np.flatnonzero(~more)
            last = np.append(kept[1:], len(ids)) - 1
            counts = np.diff(np.concatenate([[0], np.cumsum(~more)])[np.concatenate([[0], np.cumsum(counts)])])
            ids, begin, end = ids[kept], begin[kept], end[last]
        return ids, counts, begin, end

    def _learn(self, point: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Merge new chunks and keep their pieces, in the order of their numbers."""
        model, count = self.model, len(start)
        length = end - start
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # (chunk, size, ids, characters)
        for i in np.flatnonzero(length > MATRIX).tolist():
            got = self._bytes(*map(np.array, zip(*merge_long(model.char_symbol[point[start[i] : end[i]]].tolist(), model), strict=True)), point[start[i] : end[i]])
            done.append((np.array([i]), np.array([len(got[0])]), *got[:2]))
        one = np.flatnonzero(length == 1)
        own = point[start[one]]
        ids, chars, sizes = self._bytes(model.char_symbol[own], np.ones(len(one), np.int32), own)
        done.append((one, sizes, ids, chars))
        width = 2
        while width <= MATRIX:
            part_of = np.flatnonzero((length <= width) & (length > width // 2) & (length > 1))
            step = max(1, CELLS // width)
            for lo in range(0, len(part_of), step):
                part = part_of[lo : lo + step]
                spot = np.arange(width)
                inside = spot < length[part, None]
                grid = np.where(inside, model.char_symbol[point[np.minimum(start[part, None] + spot, len(point) - 1)]], -1)
                tok, span = merge_matrix(grid, model)
                live = span > 0
                flat = gathered(point, start[part], length[part])[0]
                ids, chars, sizes = self._bytes(tok[live], span[live], flat)
                row = np.repeat(np.arange(len(part)), live.sum(axis=1))
                done.append((part, np.bincount(row, sizes, len(part)).astype(np.int64), ids, chars))
            width *= 2
        sizes = np.zeros(count, dtype=np.int64)
        for part, own_sizes, _, _ in done:
            sizes[part] = own_sizes
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if count else 0
        all_ids, all_chars = np.empty(total, np.int32), np.empty(total, np.int32)
        for part, own_sizes, ids, chars in done:
            to, _ = gathered(np.arange(total), ends[part] - own_sizes, own_sizes)
            all_ids[to], all_chars[to] = ids, chars
        self.ids.extend(all_ids, sizes)
        self.spans.extend(all_chars, sizes)

    def _bytes(self, token: np.ndarray, span: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, characters, ids for each symbol): what is no piece as bytes, the last of which has the character, or as unknown."""
        model = self.model
        lost = np.flatnonzero((token < 0) | (token >= len(model.piece)))
        sizes = np.ones(len(token), dtype=np.int64)
        if not len(lost):
            return token.astype(np.int32), span.astype(np.int32), sizes
        char = point[np.cumsum(span)[lost] - 1]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in char.tolist()]
        if model.fallback:
            sizes[lost] = [len(r) for r in raw]
        ends = np.cumsum(sizes)
        ids, chars = np.full(int(ends[-1]), model.unknown, np.int32), np.zeros(int(ends[-1]), np.int32)
        chars[ends - 1] = span
        found = np.ones(len(token), dtype=bool)
        found[lost] = False
        ids[ends[found] - 1] = token[found]
        if model.fallback:
            to, _ = gathered(np.arange(len(ids)), (ends - sizes)[lost], sizes[lost])
            ids[to] = [model.byte.get(b, model.unknown) for r in raw for b in r]
        return ids, chars, sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of lists of ids, one behind the other, and how many each has."""
        model = self.model
        ids, sizes = np.asarray(ids, dtype=np.int64), np.asarray(sizes, dtype=np.int64)
        at, own = model.raw_at[ids], model.raw_size[ids].copy()
        opens = np.concatenate([[0], np.cumsum(sizes)])
        if (model.prefix or model.squeeze) and len(ids):
            # The blank of the first piece that writes anything goes; a squeezing model lets go of those of all first marks.
            heard = np.concatenate([[0], np.cumsum(own > 0)])
            lead = (own > 0) & (heard[:-1] == heard[opens[:-1]].repeat(sizes)) & model.marked[ids]
            at, own = at + lead, own - lead
            if model.squeeze:
                while True:
                    heard = np.concatenate([[0], np.cumsum(own > 0)])
                    more = (own > 0) & (heard[:-1] == heard[opens[:-1]].repeat(sizes)) & model.marked[ids] & (at == model.raw_at[ids])
                    if not more.any():
                        break
                    at, own = at + more, own - more
        raw, _ = gathered(model.raw, at, own) if len(ids) else (np.empty(0, np.uint8), own)
        pos = np.concatenate([[0], np.cumsum(own)])
        place = pos[opens]
        if not model.is_byte[ids].any():
            return raw, np.diff(place)
        # Runs of bytes end with a list and at pieces that write nothing: no character may reach over those places.
        breaks = np.concatenate([place[:-1], pos[1:][own == 0]])
        whole = not ((raw[breaks[breaks < len(raw)]] & 0xC0) == 0x80).any()
        try:
            raw.tobytes().decode()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return raw, np.diff(place)
        fixed = [self._mended(ids[a:b], raw[p:q].tobytes(), own[a:b]) for a, b, p, q in zip(opens[:-1].tolist(), opens[1:].tolist(), place[:-1].tolist(), place[1:].tolist(), strict=True)]
        return np.frombuffer(b"".join(fixed), dtype=np.uint8), np.array([len(x) for x in fixed], dtype=np.int64)

    def _mended(self, ids: np.ndarray, raw: bytes, own: np.ndarray) -> bytes:
        """Runs of byte pieces decoded each on its own; a byte that is no part of a character becomes a sign of its own."""
        out, at, i = [], 0, 0
        while i < len(ids):
            j = i
            while j < len(ids) and self.model.is_byte[ids[j]]:
                j += 1
            if j == i:
                out.append(raw[at : at + int(own[i])])
                at, i = at + int(own[i]), i + 1
                continue
            run = raw[at : at + j - i]
            at, i, k = at + j - i, j, 0
            while k < len(run):
                size = next((n for n in (1, 2, 3, 4) if k + n <= len(run) and _valid(run[k : k + n])), 0)
                out.append(run[k : k + size] if size else BROKEN.encode())
                k += max(size, 1)
        return b"".join(out)


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process, with the chunks that it has seen."""
    if path not in _CODECS:
        _CODECS[path] = Codec(Model.load(path))
    return _CODECS[path]


# -- frames --------------------------------------------------------------------


def _groups(texts: pa.Array, cut: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, row, whole): runs of texts of about GROUP bytes; with ``cut``, long texts in parts that begin at a blank."""
    data, ends = pretokens.text_bytes(texts)
    at, rows, whole = [], [], []
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        parts = [a + x for x in pretokens.cuttable(data[a:b], GROUP)] if cut and b - a > GROUP else [a]
        at += parts
        rows += [i] * len(parts)
        whole += [True, *[False] * (len(parts) - 1)]
    bounds, rows, whole = np.array([*at, len(data)], dtype=np.int64), np.array(rows, dtype=np.int64), np.array(whole, dtype=bool)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + GROUP, side="right")) - 1)
        yield data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], rows[lo:hi], whole[lo:hi]
        lo = hi


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_many(own: Codec, texts: Sequence[str | None], begin: bool = False, end: bool = False) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """Per text its ids and the source bytes (begin, end) of each."""
    data, bounds = pretokens.text_bytes(pa.array(texts, pa.string()))
    ids, sizes, a, b = own.encode(data, bounds)
    ends, out = np.cumsum(sizes), []
    for k, n in enumerate(sizes.tolist()):
        part, base = slice(int(ends[k]) - n, int(ends[k])), int(bounds[k])
        spans = [(x - base, y - base) for x, y in zip(a[part].tolist(), b[part].tolist(), strict=True)]
        last = int(bounds[k + 1]) - base
        out.append(([*[own.model.begin] * begin, *ids[part].tolist(), *[own.model.end] * end], [*[(0, 0)] * begin, *spans, *[(last, last)] * end]))
    return out


def encode(docs: DataFrame, model_path: str, begin: bool = False, end: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, its ids, and the bytes of its UTF-8 text at which each piece begins and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = encode_many(codec(model_path), batch.column(1).to_pylist(), begin, end)
            lists = [pa.array([x for x, _ in found], pa.list_(pa.int32())), *(pa.array([[s[k] for s in spans] for _, spans in found], pa.list_(pa.int32())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "ids", "begins", "ends"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``encoded``: doc_id and the text of its ids (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            lists = [x.as_py() or [] for x in batch.column(1)]
            raw, sizes = own.decode(np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64))
            ends = np.cumsum(sizes).tolist()
            texts = [raw[b - n : b].tobytes().decode() for b, n in zip(ends, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    slim = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, "doc_id long, text string")


def _digests(own: Codec, texts: pa.Array) -> list[tuple[int, str, str, str]]:
    """Per text: number of ids with begin and end, SHA-256 of the ids, of the decoded text, and of the pieces' spans."""
    model, count = own.model, [2] * len(texts)
    hashes = [tuple(hashlib.sha256() for _ in range(3)) for _ in range(len(texts))]
    word = lambda *x: np.array(x, dtype="<u4").tobytes()
    open_row = [0] * len(texts)  # bytes of a row that earlier parts had
    for h in hashes:
        h[0].update(word(model.begin))
    for data, bounds, rows, whole in _groups(texts, model.cuttable):
        ids, sizes, a, b = own.encode(data, bounds, whole)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        listed = ids.astype("<u4").data.cast("B") if len(ids) else b""
        # Parts of one text go on with its ids: what begins a part has a mark that must stay.
        raw, lengths = own.decode(ids, sizes) if whole.all() else _decoded_parts(own, ids, sizes, whole)
        raw_ends = np.concatenate([[0], np.cumsum(lengths)])
        raw = raw.data
        for k, row in enumerate(rows.tolist()):
            lo, hi = int(ends[k]), int(ends[k + 1])
            if lo < hi:
                hashes[row][0].update(listed[4 * lo : 4 * hi])
                hashes[row][1].update(raw[int(raw_ends[k]) : int(raw_ends[k + 1])])
                spans = np.stack([a[lo:hi], b[lo:hi]], axis=1).astype("<i8") + (open_row[row] - bounds[k])
                hashes[row][2].update(spans.tobytes())
                count[row] += hi - lo
            open_row[row] += int(bounds[k + 1] - bounds[k])
    for h in hashes:
        h[0].update(word(model.end))
    return [(n, *(x.hexdigest() for x in h)) for n, h in zip(count, hashes, strict=True)]


def _decoded_parts(own: Codec, ids: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``decode``, where only some lists begin a text: the others keep their first blank."""
    ends = np.cumsum(sizes)
    out = []
    for k, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        part = ids[end - n : end]
        raw = own.decode(part, np.array([n]))[0].tobytes()
        out.append(b" " + raw if not whole[k] and n and own.model.marked[part[0]] and own.model.prefix else raw)
    return np.frombuffer(b"".join(out), dtype=np.uint8), np.array([len(x) for x in out], dtype=np.int64)


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode with begin and end ids and decode every text; counts and digests instead of ids, text and spans.

    ``spans_sha256`` digests, piece by piece, begin and end as little-endian 64-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            found = _digests(own, batch.column(1))
            columns = [batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op11_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
