"""Byte-level BPE with a segment tree over byte positions.

A leaf of the tree belongs to a byte position at which a token starts and holds
``rank * width + position`` of the pair that this token forms with its right
neighbour.  The root is then the smallest rank, leftmost among equals.  A merge
kills one leaf and renews at most two: its own and its left neighbour's, each in
logarithmic time.  Short pieces go through the tree in batches (one tree per
row of a matrix, all rows advance together); long pieces get a tree of their
own.

Texts are cut into pieces and pieces into numbers by whole arrays
(:mod:`weirflow.llm.pretokens`, :mod:`weirflow.llm.interned`); a piece that a
worker has merged is kept, up to a bound on what is kept.  Under another pattern
than the one that the arrays stand for, texts are cut by regular expression.

Defined results: a null text counts as empty, an empty text has no tokens, very
long texts are encoded whole (in parts that begin where a piece does), rows are
independent (repeated rows and ids, null ids), equal ranks merge leftmost first,
empty tables give empty tables, only the columns named are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import pretokens
from weirflow.llm.interned import Interned, Lists, gathered

NONE = np.int64(1) << 40  #: the rank of a pair that does not merge
BATCHED = 64  #: pieces of up to so many bytes go through the trees of a batch
CELLS = 1 << 15  #: leaves in one batch
KEPT, KEPT_IDS = 1_200_000, 8_000_000  #: pieces that a worker keeps, and ids of them: about 100 MB
GROUP = 1 << 22  #: bytes of text encoded at a time, but for longer pieces


class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of ranks that merges."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: raw for raw, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.base = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}
        for raw, rank in ranks.items():
            for cut in range(1, len(raw)):
                left, right = ranks.get(raw[:cut]), ranks.get(raw[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.base + right] = rank
        self._fill()
        # Tokens by rank: their bytes, and their ranks in decimal with a blank behind.
        known = [self.token.get(rank, b"") for rank in range(self.base)]
        self.raw = np.frombuffer(b"".join(known), dtype=np.uint8)
        self.raw_size = np.array([len(t) for t in known], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        width = len(str(self.base)) + 1
        self.decimal = np.frombuffer(b"".join(b"%d " % rank + bytes(width - 1 - len(str(rank))) for rank in range(self.base)), dtype=np.uint8).reshape(-1, width)
        # Pairs of single bytes, by their ranks' places in the table of bytes.
        one = np.arange(256)
        self.two_bytes = self.pair_ranks(np.repeat(self.byte, 256), np.tile(self.byte[one], 256))

    def _fill(self) -> None:
        """An open-addressing table of the pairs, at most a quarter full."""
        self.bits = max(4, (4 * len(self.pairs)).bit_length())
        self.slots, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        key, value = np.array(list(self.pairs), dtype=np.int64), np.array(list(self.pairs.values()), dtype=np.int64)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.slots[slot[put]], self.values[slot[put]] = key[put], value[put]
            rest = np.ones(len(key), dtype=bool)
            rest[put] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a file of lines with a base64 token and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(raw): int(rank) for raw, rank in (line.split() for line in lines if line.strip())})

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it does not merge or a side is -1."""
        key = left * self.base + right
        out = np.full(len(key), NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            there = self.slots[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out


def merge_long(raw: bytes, vocab: Vocabulary) -> list[int]:
    """The tokens of one piece, by one tree over its bytes."""
    n = len(raw)
    width = 1 << max(1, (n - 1).bit_length())
    dead, pairs, base = int(NONE) * width, vocab.pairs, vocab.base
    token = [int(vocab.byte[b]) for b in raw]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [dead] * (2 * width)
    for i in range(n - 1):
        rank = pairs.get(token[i] * base + token[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a < b else b
            if tree[node] == low:
                break
            tree[node] = low

    def renew(i: int) -> None:
        j = after[i]
        rank = pairs.get(token[i] * base + token[j]) if j < n else None
        put(i, dead if rank is None else rank * width + i)

    while tree[1] < dead:
        rank, i = divmod(tree[1], width)
        gone = after[i]
        token[i], after[i] = rank, after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, dead)
        renew(i)
        if before[i] >= 0:
            renew(before[i])
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return out


def merge_batch(pieces: Sequence[bytes], width: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of pieces of at most ``width`` bytes, a power of two, one behind the other, and how many each has."""
    m = len(pieces)
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
    raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(m, width)
    spot = np.arange(width, dtype=np.int64)
    grid = np.where(spot < size[:, None], vocab.byte[raw], -1)
    dead = NONE * width
    trees = np.full((m, 2 * width), dead, dtype=np.int64)
    pairs = vocab.two_bytes[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]]
    trees[:, width : 2 * width - 1] = np.where(spot[1:] < size[:, None], pairs, NONE) * width + spot[:-1]
    level = width
    while level > 1:
        half = level // 2
        trees[:, half:level] = np.minimum(trees[:, level : 2 * level : 2], trees[:, level + 1 : 2 * level : 2])
        level = half
    # From here on all is flat: piece r has positions r * width + i, and its tree begins at 2 * r * width.
    token, tree = grid.ravel(), trees.ravel()
    after = np.tile(spot + 1, m)
    before = np.tile(spot - 1, m)
    rows = np.flatnonzero(trees[:, 1] < dead)
    while len(rows):
        first, root = rows * width, 2 * rows * width
        rank, i = np.divmod(tree[root + 1], width)
        here = first + i
        gone = after[here]
        nxt = after[first + gone]
        token[here] = rank
        token[first + gone] = -1
        after[here] = nxt
        inside = nxt < size[rows]
        before[(first + nxt)[inside]] = i[inside]
        right = np.where(inside, token[first + np.minimum(nxt, width - 1)], -1)
        prev = before[here]
        has = prev >= 0
        left = token[(first + prev)[has]]
        value = vocab.pair_ranks(np.concatenate([rank, left]), np.concatenate([right, rank[has]])) * width
        value += np.concatenate([i, prev[has]])
        # The three leaves of a merge are renewed together, level by level.
        base = np.concatenate([root, root, root[has]])
        node = np.concatenate([gone, i, prev[has]]) + width
        tree[base + node] = np.concatenate([np.full(len(rows), dead), value])
        for _ in range(width.bit_length() - 1):
            node >>= 1
            child = base + 2 * node
            tree[base + node] = np.minimum(tree[child], tree[child + 1])
        rows = rows[tree[root + 1] < dead]
    live = grid >= 0
    return grid[live], live.sum(axis=1)


class Codec:
    """Encodes texts and decodes ids; keeps the ids of pieces."""

    def __init__(self, vocab: Vocabulary, pattern: str) -> None:
        self.vocab = vocab
        self.finditer = None if pattern == pretokens.SPACED else regex.compile(pattern).finditer
        self.known, self.ids = Interned(KEPT), Lists("int32")

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin and end in their bytes; ``bounds``: where texts begin, with the end."""
        if self.finditer is None:
            points = pretokens.Points(data, bounds[:-1])
            at = points.bytes_at(pretokens.spaced(points))
            return at[:-1], at[1:]
        start, end = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            text = data[a:b].tobytes().decode()
            at = np.cumsum([a, *(len(c.encode()) for c in text)])
            for m in self.finditer(text):
                start.append(at[m.start()])
                end.append(at[m.end()])
        return np.array(start, dtype=np.int64), np.array(end, dtype=np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one behind the other, and how many each has."""
        if self.known.full or self.ids.used > KEPT_IDS:
            self.known.clear()
            self.ids.clear()
        start, end = self._pieces(data, bounds)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(bounds) - 1, dtype=np.int64)
        number, new = self.known.numbers(data, start, end)
        raw = data.tobytes()
        self.ids.extend(*self._merged([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
        flat, sizes = self.ids.gather(number)
        before = np.concatenate([[0], np.cumsum(sizes)])
        return flat, np.diff(before[np.searchsorted(start, bounds)])

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one behind the other, and how many each has."""
        whole, sizes = np.array([self.vocab.ranks.get(p, -1) for p in pieces], dtype=np.int64), np.ones(len(pieces), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        rest = np.flatnonzero(whole < 0)
        length = np.array([len(pieces[i]) for i in rest.tolist()], dtype=np.int64)
        for i in rest[length > BATCHED].tolist():
            ids = np.array(merge_long(pieces[i], self.vocab), dtype=np.int64)
            sizes[i] = len(ids)
            done.append((np.array([i]), ids))
        width = 2
        while width <= BATCHED:
            own = rest[(length <= width) & (length > (width // 2 if width > 2 else 0))]
            step = max(1, CELLS // width)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                flat, sizes[part] = merge_batch([pieces[i] for i in part.tolist()], width, self.vocab)
                done.append((part, flat))
            width *= 2
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for part, flat in done:
            to, _ = gathered(np.arange(len(out)), ends[part] - sizes[part], sizes[part])
            out[to] = flat
        return out, sizes

    def encode_many(self, texts: Sequence[str]) -> list[list[int]]:
        """The ids of each text."""
        data, bounds = pretokens.text_bytes(pa.array(texts, pa.string()))
        flat, sizes = self.encode(data, bounds)
        ends = np.cumsum(sizes).tolist()
        return [flat[b - n : b].tolist() for b, n in zip(ends, sizes.tolist(), strict=True)]

    def decode(self, ids: np.ndarray | Sequence[int]) -> np.ndarray:
        """The bytes that ids stand for."""
        ids = np.asarray(ids, dtype=np.int64)
        return gathered(self.vocab.raw, self.vocab.raw_at[ids], self.vocab.raw_size[ids])[0]

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id in decimal with a blank behind, as bytes, and their sizes."""
        grid = self.vocab.decimal[ids]
        used = grid > 0
        return grid[used], used.sum(axis=1)


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, with the pieces it has seen."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(Vocabulary.load(path), pattern)
    return _CODECS[path, pattern]


def _groups(texts: pa.Array, cut: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, row): runs of texts of about GROUP bytes; with ``cut``, long texts in parts that begin where a piece does."""
    data, ends = pretokens.text_bytes(texts)
    at, rows = [], []
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        parts = [a + x for x in pretokens.cuttable(data[a:b], GROUP)] if cut and b - a > GROUP else [a]
        at += parts
        rows += [i] * len(parts)
    if not rows:
        return
    bounds, rows = np.array([*at, len(data)], dtype=np.int64), np.array(rows)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + GROUP, side="right")) - 1)
        yield data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], rows[lo:hi]
        lo = hi


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and its token ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab_path, pattern)
        for batch in batches:
            for data, bounds, rows in _groups(batch.column(1), False):
                flat, sizes = codec.encode(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=["doc_id", "ids"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``encoded``: doc_id and the bytes of its ids (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab_path, pretokens.SPACED)
        for batch in batches:
            raw = [codec.decode(x.as_py() or []).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    slim = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, "doc_id long, raw binary")


def _digests(codec: Codec, texts: pa.Array) -> list[tuple[int, str, str]]:
    """Per text: number of ids, SHA-256 of the ids' decimal list, SHA-256 of the decoded bytes."""
    count = [0] * len(texts)
    hashes: list = [None] * len(texts)
    for data, bounds, rows in _groups(texts, codec.finditer is None):
        ids, sizes = codec.encode(data, bounds)
        listed, widths = codec.decimals(ids)
        raw = codec.decode(ids)
        ends = np.cumsum(sizes)
        listed_at = np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], ends])].tolist()
        raw_at = np.concatenate([[0], np.cumsum(codec.vocab.raw_size[ids])])[np.concatenate([[0], ends])].tolist()
        listed, raw = listed.data, raw.data
        for k, row in enumerate(rows.tolist()):
            if hashes[row] is None:
                hashes[row] = (hashlib.sha256(), hashlib.sha256())
            if sizes[k]:
                if count[row]:
                    hashes[row][0].update(b" ")
                hashes[row][0].update(listed[listed_at[k] : listed_at[k + 1] - 1])
                hashes[row][1].update(raw[raw_at[k] : raw_at[k + 1]])
                count[row] += int(sizes[k])
    return [(n, a.hexdigest(), b.hexdigest()) for n, (a, b) in zip(count, hashes, strict=True)]


def round_trip_digests(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; return counts and digests instead of the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab_path, pattern)
        for batch in batches:
            found = _digests(codec, batch.column(1))
            columns = [batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
