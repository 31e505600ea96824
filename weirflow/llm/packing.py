"""Packing token sequences by linear grouping and best fit.

1. Large lengths are sorted and cut into groups of equal cardinality; within a
   group every length counts as the group's largest.
2. Over these few sizes a configuration program (how often each way of filling
   a sequence is used) is solved by column generation: the duals of a basis
   price new configurations with a knapsack, and the basis is exchanged until
   none improves.  Fractions are rounded down, what remains of each group is
   placed by best fit.
3. The actual lengths take the places of their group's size, longest first.
4. Small lengths go, longest first, to the fullest sequence that still has room.

The plan is made from the histogram of lengths alone.  It has at most
``capacity`` entries whatever the number of rows, and runs of equal sequences
are held once with their multiplicity, so the driver's memory does not grow
with the data.  Rows then learn their rank within their length by a window over
(length, salt), salted so that no length gathers in one task, and look up their
place.

Defined results: a null text counts as empty (only the end id); texts of any
length are cut into pieces of at most a sequence; an empty table gives an empty
table; rows are independent, so repeated rows and ids, and null ids, are packed
each on its own; equal lengths take their places by id, piece and checksum, and
rows equal in these too by chance, which changes no sequence's fill; further
columns of ``pack`` are kept whatever their names, but for ``sequence_id`` and
``offset``, which are new.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weirflow.llm import pretokens
from weirflow.llm.interned import Interned, Lists
from weirflow.llm.workspace import materialise

CAPACITY = 2048
GROUPS = 192  #: groups of large lengths
SMALL = 3  #: a length is small if so many of it fit into a sequence
ROWS_A_SALT = 50_000  #: rows of one length that a task ranks, about
MARK, LINE = " ~ ", 4000  #: what parts words that are encoded together, and how many are
KEPT, KEPT_IDS = 800_000, 5_000_000  #: pieces that a worker keeps, and ids of them: about 65 MB
GROUP = 1 << 21  #: bytes of text encoded at a time, but for longer texts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Code points that neither composition nor lower-casing turns into others in number or kind: what lies before the combining
#: marks, but for the dotted capital I.
_PLAIN = np.ones(0x301, dtype=bool)
_PLAIN[[0x130, 0x300]] = False


# -- tokens ------------------------------------------------------------------


class WordIds:
    """Ids of texts under a tokenizer that lower-cases and encodes each piece of the pattern BARE by itself.

    Pieces of plain words are told apart by whole arrays, and those that are new are encoded by the tokenizer, many in one
    call; their ids are kept, up to a bound.  A word with a code point that normalisation may change in number or kind goes
    to the tokenizer whole, and so does a text that holds an added token (matched before anything else, case and all).
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # for pieces alone: lower-casing must not make an added token of one
        self.known, self.ids = Interned(KEPT), Lists("<u4")

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers; ``bounds``: where texts begin, with the end."""
        if self.known.full or self.ids.used > KEPT_IDS:
            self.known.clear()
            self.ids.clear()
        raw = data.tobytes()
        low = _LOWER[data]
        start, end = self._pieces(low, bounds)
        number, new = self.known.numbers(low, start, end)
        text = low.tobytes()
        fresh = self._encode([text[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        self.ids.extend(np.frombuffer(b"".join(fresh), dtype="<u4"), np.array([len(f) // 4 for f in fresh], dtype=np.int64))
        flat, sizes = self.ids.gather(number)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, bounds)].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if any(a in raw for a in self.added):
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if any(x in raw[a:b] for x in self.added):
                    out[k] = np.array(self.whole.encode(raw[a:b].decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    @staticmethod
    def _pieces(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and end: of plain words those of the pattern, other words whole."""
        if not len(low):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = pretokens.Points(low, bounds[:-1])
        begin = points.runs()
        begin[1:-1] |= points.kind[1:] == pretokens.NUMBER
        points.contract(begin)
        dark = points.kind != pretokens.SPACE
        odd = ~(_PLAIN[np.minimum(points.point, len(_PLAIN) - 1)])
        if odd.any():
            edge = points.first.copy()
            edge[1:-1] |= dark[1:] != dark[:-1]
            words = np.flatnonzero(edge)
            number = np.cumsum(edge)[:-1] - 1
            strange = np.bincount(number, odd & dark, len(words) - 1) > 0
            begin[:-1] &= ~strange[number] | edge[:-1]
        at = np.flatnonzero(begin)
        kept = dark[at[:-1]]
        at = points.bytes_at(at)
        return at[:-1][kept], at[1:][kept]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of single pieces: many at once with a mark between them, each alone where one holds the mark."""
        encode = self.tokenizer.encode_batch_fast
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        plain = [w for w in words if MARK.strip() not in w] if len(mark) == 1 else []
        lines = [MARK.join(["", *plain[at : at + LINE], ""]) for at in range(0, len(plain), LINE)]
        flat = np.array([i for e in encode(lines, add_special_tokens=False) for i in e.ids], dtype="<u4")
        at = np.flatnonzero(flat == mark[0])
        if len(at) != len(plain) + len(lines):
            raise ValueError("the tokenizer makes the mark's id of something else")
        first = np.ones(len(at), dtype=bool)  # of the marks, those behind which a word begins
        if len(at):
            first[np.append(np.arange(LINE, len(at), LINE + 1), len(at) - 1)] = False
        starts = np.flatnonzero(first)
        raw, ends = flat.tobytes(), 4 * at
        found = dict(zip(plain, (raw[a:b] for a, b in zip((ends[starts] + 4).tolist(), ends[starts + 1].tolist(), strict=True)), strict=True))
        odd = [w for w in words if w not in found]
        found |= {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(odd, encode(odd, add_special_tokens=False), strict=True)}
        return [found[w] for w in words]


_TOKENIZERS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its ids and ``end_id``, cut at ``capacity``; ids as their CRC-32."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _TOKENIZERS.get(tokenizer_path) or _TOKENIZERS.setdefault(tokenizer_path, WordIds(tokenizer_path))
        end, most = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

        def cut(ids: list, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            out: list[tuple] = []
            for doc, raw in zip(ids, words(data, bounds), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), most)):
                    part = raw[at : at + most]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, bounds = pretokens.text_bytes(batch.column(1))
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + GROUP, side="right")) - 1)
                yield cut(ids[lo:hi], data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                lo = hi

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# -- the plan ----------------------------------------------------------------


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, and how many of each it has."""
    best = np.zeros(capacity + 1)
    count = np.zeros((len(sizes), capacity + 1), dtype=np.int16)
    for k, size in enumerate(sizes):
        if worth[k] <= 1e-12:
            continue
        base = best.copy()
        for n in range(1, capacity // size + 1):
            with_n = np.full(capacity + 1, -1.0)
            with_n[n * size :] = base[: capacity + 1 - n * size] + n * worth[k]
            better = with_n > best + 1e-12
            best[better] = with_n[better]
            count[k][better] = n
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        counts[k] = count[k][c]
        c -= int(counts[k]) * sizes[k]
    return best[capacity], counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Whole multiplicities of ways to fill a sequence that meet ``demand`` but for a rest of fewer than len(sizes) sequences."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, dtype=float)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, fresh = _knapsack(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        use, move = np.linalg.solve(basis, need), np.linalg.solve(basis, fresh.astype(float))
        ratio = np.where(move > 1e-9, np.maximum(use, 0) / np.where(move > 1e-9, move, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(np.argmin(ratio))] = fresh
    use = np.maximum(np.floor(np.linalg.solve(basis, need) + 1e-9), 0).astype(np.int64)
    return [(basis[:, j].astype(np.int64), int(n)) for j, n in enumerate(use) if n]


def grouped(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, cut into groups of equal cardinality."""
    total = sum(histogram.values())
    out: list[list[tuple[int, int]]] = []
    left = 0
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            if not left:
                out.append([])
                left = max(1, -(-total // groups))
            take = min(count, left)
            out[-1].append((length, take))
            count, left = count - take, left - take
    return [g for g in out if g]


Bins = list[tuple[tuple[tuple[int, int], ...], int]]  #: (contents as (length, count) ..., how many such sequences)


def _substitute(found: list[tuple[np.ndarray, int]], groups: list[list[tuple[int, int]]]) -> tuple[Bins, Counter]:
    """Give the places of each configuration to actual lengths; what is over comes second."""
    runs = [[list(r) for r in g] for g in groups]
    bins: Bins = []
    for counts, times in found:
        while times:
            # As many equal sequences as the run at hand of every group allows.
            most, contents, part = times, [], []
            for g, c in enumerate(counts.tolist()):
                if not c:
                    continue
                there = sum(r[1] for r in runs[g])
                c = min(c, there)
                if not c:
                    continue
                head = runs[g][0]
                if head[1] >= c:
                    part.append((g, c))
                    contents.append((head[0], c))
                    most = min(most, head[1] // c)
                else:
                    most, rest = 1, c
                    for r in runs[g]:
                        take = min(rest, r[1])
                        contents.append((r[0], take))
                        rest -= take
                        if not rest:
                            break
                    part.append((g, c))
            if not contents:
                break
            for g, c in part:
                take = c * most
                while take:
                    head = runs[g][0]
                    n = min(take, head[1])
                    head[1] -= n
                    take -= n
                    if not head[1]:
                        runs[g].pop(0)
            bins.append((tuple(contents), most))
            times -= most
    rest: Counter = Counter()
    for g in runs:
        for length, n in g:
            rest[length] += n
    return bins, rest


def best_fit(bins: Bins, lengths: dict[int, int], capacity: int) -> Bins:
    """Add lengths, longest first, each to the fullest sequence with room; sequences in runs."""
    by_room: dict[int, list[list]] = defaultdict(list)  # room -> [contents, multiplicity]
    for contents, times in bins:
        by_room[capacity - sum(a * n for a, n in contents)].append([contents, times])
    rooms = sorted(by_room)
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                if n >= fit:
                    made, contents = n // fit, ((length, fit),)
                    n -= made * fit
                else:
                    made, contents, n = 1, ((length, n),), 0
                room = capacity - sum(a * c for a, c in contents)
            else:
                room = rooms[at]
                old, times = by_room[room].pop()
                fit = min(room // length, n)
                made = min(times, n // fit)
                contents = (*old, (length, fit))
                n -= made * fit
                if times > made:
                    by_room[room].append([old, times - made])
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                room -= fit * length
            if room not in by_room:
                bisect.insort(rooms, room)
            by_room[room].append([contents, made])
    return [(contents, times) for group in by_room.values() for contents, times in group]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> Bins:
    """Contents and multiplicities of sequences that hold every length of ``histogram``."""
    whole = {capacity: histogram[capacity]} if histogram.get(capacity) else {}
    large = {a: n for a, n in histogram.items() if capacity // small < a < capacity}
    rest = Counter({a: n for a, n in histogram.items() if a <= capacity // small})
    bins: Bins = [(((capacity, 1),), n) for n in whole.values()]
    if large:
        cut = grouped(large, groups)
        found = configurations([g[0][0] for g in cut], [sum(n for _, n in g) for g in cut], capacity)
        filled, over = _substitute(found, cut)
        bins += filled
        rest.update(over)
    return best_fit(bins, rest, capacity)


def lookup(bins: Bins) -> np.ndarray:
    """Rows (length, first rank, sequences' first number, copies in a sequence, offset), sorted: where each rank of a length goes."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for contents, times in bins:
        offset = 0
        for length, copies in contents:
            rows.append((length, rank[length], sequence, copies, offset))
            rank[length] += copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# -- rows --------------------------------------------------------------------


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """``pieces_df`` (doc_id, piece, length between 1 and capacity, ...) with sequence_id and offset."""
    kept = [c for c in pieces_df.columns if c not in ("sequence_id", "offset")]
    # A row travels as one struct, so none of its names can clash with ours.
    saved = materialise(pieces_df.select("doc_id", "piece", "length", "ids_crc32", F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")), "pieces")
    histogram = {int(a): int(n) for a, n in saved.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = lookup(pack_histogram(histogram, capacity, groups, small))
    salts = max(1, -(-max(histogram.values(), default=1) // ROWS_A_SALT), 16)
    keyed = saved.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    within = Window.partitionBy("length", "_salt")
    ranked = keyed.withColumn("_rank", F.row_number().over(within.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    # Ranks of earlier salts of the same length: at most capacity * salts rows, joined on the window's own partitioning.
    sizes = keyed.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    placed = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_salt")
    span = int(table[:, 1].max(initial=0)) + max(histogram.values(), default=0) + 1
    keys = table[:, 0] * span + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            _, first, sequence, copies, offset = table[at].T
            nth, slot = np.divmod(rank - first, copies)
            row = batch.column(batch.schema.get_field_index("row"))
            yield pa.RecordBatch.from_arrays([row, pa.array(sequence + nth), pa.array(offset + slot * length)], names=["row", "sequence_id", "offset"])

    out = StructType([placed.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return placed.select("length", "_rank", "row").mapInArrow(place, out).select("row.*", "sequence_id", "offset")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
