"""Exact Jaccard join of word shingles in the metric space of sets.

Jaccard distance is a metric, so pivots cut the space into Voronoi regions and
the triangle inequality says which sets must also be copied into a neighbouring
region.

1. Most texts are at distance 1 from all others; no pivot divides them.  An exact
   index finds who can have a partner at all.  The hashed universe of shingles is
   cut into K parts, where K depends on a set's size alone and exceeds the largest
   symmetric difference that two linked sets of that size can have.  So two linked
   sets have a part in which they are equal: they share a key, the hash of what
   they have in that part.  A set has keys for its own class of sizes and for the
   next one, in which a linked set may be.  Unrelated sets share no key, however
   frequent the words, lines or passages are that they have in common.  Linked sets
   agree in more parts than one, so a set must share a number of keys to go on.
2. Each key names a pivot, of its sets the one with the most shared keys.  All sets
   of the key go to the pivot's cell, or to that of a better pivot to which it hands
   its own; a linked pair meets in a cell.
3. A cell is joined recursively and exactly (:mod:`weirflow.llm.regions`): sets go
   to the Voronoi region of their nearest pivot and, where the triangle inequality
   admits a partner there, to others.  Cells that are too large for a task are first
   split in the same way by whole jobs: a few pivots of the cell are sent to all of
   its blocks, each block deals its sets to regions, the next round deals those;
   cells whose regions save nothing are joined block by block.

Empty parts need care: sets that are both empty in a part agree in it without being
alike.  K therefore has a margin, more than the number of parts that a set of that
size is likely to have empty, and empty parts give no key; a set with more empty
parts than the margin has keys for them, too, so that the join stays exact.

Skew: equal sets collapse within a task before anything is shuffled, and a key that
many sets of a batch share is sent to the index twice, its sets directly; pivots of
keys are partial aggregates; joins on keys are equi-joins that adaptive execution
may split; a hot cell is split by pivots and blocks.  What is returned of a region
is a spanning forest of its links.

Sets are named by 128 bits of a hash of their sorted 64-bit shingle hashes.  The
index uses 64 of them; where two sets share these, a few more are compared.

Defined results: null and empty texts have an empty set and link with nothing;
repeated rows are linked like any equal texts; null ids take part, a component is
named by its smallest non-null id; a text of any length is one set, cut whole; an
empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import regions
from weirflow.llm.components import components
from weirflow.llm.shingles import mix, names_of, runs, shingle_sets, short_names
from weirflow.llm.workspace import Scratch

WORDS = 4  #: words in a shingle of the registered query
PERCENT = 85  #: of the union that the intersection must have
SEEN = 1_000_000  #: names that a task remembers to skip copies
HANDED = 2  #: doublings of the steps by which a cell goes to a better pivot
OFTEN = 8  #: a key of more sets of a batch is sent to the index twice only
ENTRIES = 4_000_000  #: entries of the index in a partition, about
BITS = 25  #: a bit map has 2 ** BITS bits
TASK = 2_000_000  #: weight of a cell that one task joins, and of a block
WEIGHT = "n + 50"  #: of a set: its shingles and something for itself
SPLIT = 12  #: pivots of a cell that whole jobs split

_ROW = "doc_id long, n long, name binary, s long"


# -- keys --------------------------------------------------------------------


class Classes:
    """Classes of sizes: linked sets are of one class or of neighbours."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.upper = [0, 1]

    def of(self, n: np.ndarray) -> np.ndarray:
        """The class of each size (from 1)."""
        while self.upper[-1] < n.max(initial=0):
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * 100 // self.percent))
        return np.searchsorted(np.array(self.upper), n)

    def parts(self, k: int) -> tuple[int, int]:
        """Number of parts of class ``k``, and its margin: how many parts a set may have empty; (0, 0) where only equal sets link."""
        while len(self.upper) <= k:
            self.of(np.array([self.upper[-1] + 1]))
        apart = 2 * self.upper[k] * (100 - self.percent) // (100 + self.percent)
        if not apart:
            return 0, 0
        least, margin = self.upper[max(k - 2, 0)] + 1, 1
        for _ in range(8):
            mean = (apart + 1 + margin) * math.exp(-least / (apart + 1 + margin))
            margin = max(margin, math.ceil(mean + 5 * math.sqrt(mean)))
        return apart + 1 + margin, margin


def keys_of(flat: np.ndarray, sizes: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of sets (one behind the other, sorted), the set that each belongs to, and how many of its set's keys must be shared.

    Linked sets agree in one part more than the margin at least, so they share as many keys of one class, less the parts
    that both have empty.  A key's lowest bit tells its class from the set's other one.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = classes.of(sizes)
    out, owners, needs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(sums: np.ndarray, who: np.ndarray, part: np.ndarray, need: np.ndarray) -> None:
        kind = (own[who] + step).astype(np.uint64)
        key = mix(sums + mix(kind * np.uint64(0x9E3779B97F4A7C15) + part))
        out.append(key & ~np.uint64(1) | kind & np.uint64(1))
        owners.append(who)
        needs.append(need)

    for step in (0, 1):
        kinds, number = np.unique(own + step, return_inverse=True)
        table = np.array([classes.parts(int(k)) for k in kinds], dtype=np.int64).reshape(-1, 2)
        parts, margin = table[number].T
        used = parts[owner] > 0
        who, shingle = owner[used], flat[used]
        if not len(who):
            continue
        part = ((shingle >> np.uint64(32)) * parts[who].astype(np.uint64)) >> np.uint64(32)
        first = np.ones(len(who), dtype=bool)
        first[1:] = (who[1:] != who[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        sums = np.add.reduceat(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), at)
        who, part = who[at], part[at]
        empty = parts - np.bincount(who, minlength=len(sizes))
        add(sums, who, part, np.maximum(1 + margin - empty, 1)[who])
        # Sets with more empty parts than the margin, which are very few, have keys for these.
        for i in np.flatnonzero((parts > 0) & (empty > margin)).tolist():
            blank = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), part[who == i])
            add(np.zeros(len(blank), np.uint64), np.full(len(blank), i), blank, np.ones(len(blank), np.int64))
    return np.concatenate(out), np.concatenate(owners), np.concatenate(needs)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def index_entries(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, keys, owners, needs): packed entries of the index; ``bucket`` -1 - x: entries of keys that a batch has often.

    A key is its bucket and 32 bits; keys that agree in these are taken for one, which costs a comparison.
    """

    def rows(texts: pa.Array, seen: set[bytes], classes: Classes) -> pa.RecordBatch | None:
        flat, sizes = shingle_sets(texts, words)
        names = names_of(flat, sizes)
        fresh = np.zeros(len(names), dtype=bool)
        for i, name in enumerate(names):
            if name and name not in seen:
                seen.add(name)
                fresh[i] = True
        if len(seen) > SEEN:
            seen.clear()
        key, who, need = keys_of(flat[np.repeat(fresh, sizes)], sizes[fresh], classes)
        if not len(key):
            return None
        short = short_names([n for n, f in zip(names, fresh, strict=True) if f])
        order = np.argsort(key, kind="stable")
        key, who, need = key[order], who[order], np.minimum(need[order], 255).astype(np.uint8)
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(at, len(key)))
        often = np.repeat(count > OFTEN, count) & (np.arange(len(key)) - np.repeat(at, count) > 1)
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
        out: tuple[list, list, list, list] = ([], [], [], [])
        for pick, sign in ((np.flatnonzero(~often), 1), (np.flatnonzero(often), -1)):
            if not len(pick):
                continue
            cut = np.flatnonzero(np.append(True, bucket[pick][1:] != bucket[pick][:-1])).tolist()
            for a, b in zip(cut, [*cut[1:], len(pick)], strict=True):
                part = pick[a:b]
                x = int(bucket[part[0]])
                for to, value in zip(out, (x if sign > 0 else -1 - x, low[part].tobytes(), short[who[part]].tobytes(), need[part].tobytes()), strict=True):
                    to.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "keys", "owners", "needs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        classes = Classes(percent)
        for batch in batches:
            for a, b in runs(batch.column(0)):
                if (found := rows(batch.column(0).slice(a, b - a), seen, classes)) is not None:
                    yield found

    return docs.select("text").mapInArrow(run, "bucket long, keys binary, owners binary, needs binary")


def shared_keys(entries: DataFrame, partitions: int) -> DataFrame:
    """(key, s, need): the keys that at least two sets have, and their sets by short name.

    Rows of a bucket with few sets a batch meet in a partition; of other keys two sets a batch come there, which is enough
    for the key to count as shared, while the rest pass by any partition.
    """
    dealt = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.xxhash64("keys", "owners"))
    names = ["key", "s", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, needs = [], [], []
        for batch in batches:
            for bucket, low, own, need in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                whole = (np.frombuffer(low, dtype="<u4").astype(np.int64)) | ((bucket if bucket >= 0 else -1 - bucket) << 32)
                own, need = np.frombuffer(own, dtype="<i8"), np.frombuffer(need, dtype=np.uint8)
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(own), pa.array(need.astype(np.int16))], names=names)
                else:
                    keys.append(whole)
                    owners.append(own)
                    needs.append(need)
        if not keys:
            return
        key, own, need = np.concatenate(keys), np.concatenate(owners), np.concatenate(needs)
        del keys, owners, needs
        order = np.argsort(key, kind="stable")
        key, own, need = key[order], own[order], need[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        mixed = np.repeat(np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at), np.diff(np.append(at, len(key))))
        key, own, need = key[mixed], own[mixed], need[mixed].astype(np.int16)
        for a in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (key, own, need)], names=names)

    return entries.repartition(partitions, dealt).mapInArrow(run, "key long, s long, need short").distinct()


def enough(met: DataFrame) -> DataFrame:
    """(key, s) of the sets that share as many keys of a class as a linked set must."""
    kind = F.col("key").bitwiseAND(1).alias("kind")
    fine = met.groupBy("s", kind).agg(F.count("*").alias("k"), F.max("need").alias("need")).where("k >= need").select("s", "kind")
    return met.select("key", "s", kind).join(fine, ["s", "kind"], "left_semi").select("key", "s")


def cells_of(met: DataFrame) -> DataFrame:
    """(cell, s): the sets that share keys with a pivot, by the pivot.

    The pivot of a key is its set with the most shared keys.  A pivot that shares a key with a better one hands its cell to
    that, a few times over, so that a set is in few cells.
    """
    weight = met.join(met.groupBy("s").agg(F.count("*").alias("k")), "s")
    heads = weight.groupBy("key").agg(F.max(F.struct("k", "s")).alias("x")).select("key", "x")
    joined = met.join(heads, "key")
    better = joined.groupBy("s").agg(F.max("x").alias("x")).select("s", F.col("x.s").alias("up"))
    for _ in range(HANDED):
        up = better.select(F.col("s").alias("up"), F.col("up").alias("top"))
        better = better.join(up, "up").select("s", F.col("top").alias("up"))
    pivots = better.select(F.col("s").alias("pivot"), F.col("up").alias("cell"))
    return joined.select("s", F.col("x.s").alias("pivot")).distinct().join(pivots, "pivot").select("cell", "s").distinct()


# -- texts -------------------------------------------------------------------


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def named(slim: DataFrame, words: int) -> DataFrame:
    """Per text: doc_id, n, name, short name s, and the columns of type long behind the text."""
    more = slim.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in runs(whole.column(1)):
                batch = whole.slice(a, b - a)
                flat, sizes = shingle_sets(batch.column(1), words)
                names = names_of(flat, sizes)
                columns = [batch.column(0), pa.array(sizes), pa.array(names, pa.binary()), pa.array(short_names(names)), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "name", "s", *more])

    return slim.mapInArrow(run, ", ".join([_ROW, *(f"{x} long" for x in more)]))


def _bits(short: np.ndarray) -> np.ndarray:
    return (short.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def bit_map_of(spark: SparkSession, short: DataFrame) -> np.ndarray:
    """The bits of column ``s`` as 64-bit words; what comes to the driver is at most 2 ** (BITS - 6) rows."""
    bit = f"shiftrightunsigned(s, {64 - BITS})"
    words = short.selectExpr(f"shiftright({bit}, 6) AS w", f"shiftleft(1L, cast({bit} & 63 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    table = words.toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return out


def members(docs: DataFrame, words: int, wanted: np.ndarray) -> DataFrame:
    """(name, members) of the texts whose set's short name is in the bit map ``wanted`` (and of some others), once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for a, b in runs(batch.column(0)):
                flat, sizes = shingle_sets(batch.column(0).slice(a, b - a), words)
                names = names_of(flat, sizes)
                at = _bits(short_names(names))
                hit = ((wanted[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0) & (sizes > 0)
                ends, pick = np.cumsum(sizes), []
                for i in np.flatnonzero(hit).tolist():
                    if names[i] not in seen:
                        seen.add(names[i])
                        pick.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                if pick:
                    own = pa.array(_signed(np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in pick])))
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes[pick]]), pa.int32()), own)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in pick], pa.binary()), lists], names=["name", "members"])

    return docs.select("text").mapInArrow(run, "name binary, members array<long>")


# -- cells -------------------------------------------------------------------


def _sets(table: pa.Table) -> regions.Sets:
    lists = table.column("members").combine_chunks()
    return regions.Sets(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))


def _edges(names: list[bytes], links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([names[i] for i, _ in links], pa.binary()), "b": pa.array([names[j] for _, j in links], pa.binary())})


def join_cells(cells: DataFrame, whole: DataFrame, percent: int, bunches: int) -> DataFrame:
    """(a, b): spanning forests of the links of cells (cell, name, n, pivot); each cell fits into a task.

    Cells go to tasks in bunches, and a set once to each bunch; ``whole`` (name, members) may hold a set several times.
    """
    routes = cells.withColumn("bunch", F.pmod(F.xxhash64("cell"), F.lit(bunches))).groupBy("name", "bunch").agg(F.collect_list(F.struct("cell", "pivot")).alias("cells"))

    def bunch(table: pa.Table) -> pa.Table:
        names = table.column("name").to_pylist()
        first = {name: i for i, name in reversed(list(enumerate(names)))}
        own: dict[int, list[tuple[int, bool]]] = {}
        cells = table.column("cells").to_pylist()
        for i in sorted(first.values()):
            for x in cells[i]:
                own.setdefault(x["cell"], []).append((i, x["pivot"]))
        lists = table.column("members").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out: list[tuple[int, int]] = []
        for _, rows in sorted(own.items()):
            idx = [i for i, _ in rows]
            sets = regions.Sets(np.concatenate([flat[ends[i] : ends[i + 1]] for i in idx]), np.diff(ends)[idx])
            labels = regions.Labels(len(idx))
            regions.join(sets, np.arange(len(idx)), labels, percent, next((k for k, (_, head) in enumerate(rows) if head), None))
            out += [(idx[i], idx[j]) for i, j in labels.links]
        return _edges(names, out)

    return whole.join(routes, "name").select("bunch", "name", "cells", "members").groupBy("bunch").applyInArrow(bunch, "a binary, b binary")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with ``blocks`` and the ``block`` of their cell: about TASK each."""
    blocks = F.ceil(F.col("total") / TASK).cast("long")
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))


def deal(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """One round over cells too large for a task, (cell, name, n, members, total).

    Returns (cell, q, name, d, core) of the regions that the sets go to, the pivots' links as (name, link), and pivots
    themselves nowhere: they have met their whole cell.
    """
    radius = 1 - percent / 100
    salt = F.pmod(F.xxhash64("name", F.lit(turn)), F.lit(SPLIT))
    picked = rows.groupBy("cell", salt.alias("salt")).agg(F.min(F.struct(F.xxhash64("name", F.lit(turn + 1)), "name")).alias("x")).select("cell", F.col("x.name").alias("name"))
    blocked = _blocks(rows).select("cell", "block", "name", "n", "members", F.lit(False).alias("pivot"))
    pivots = _blocks(rows.join(picked, ["cell", "name"], "left_semi")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "descending"), ("name", "ascending")])
        names, k = table.column("name").to_pylist(), int(table.column("pivot").to_numpy().astype(np.int64).sum())
        sets, own = _sets(table), set(names[:k])
        idx = np.array([i for i in range(k, len(names)) if names[i] not in own], dtype=np.int64)
        out: list[tuple] = []
        cell = table.column("cell")[0].as_py()
        # Pivots against pivots as well: they leave together.
        for i in range(k):
            later = np.arange(i + 1, k)
            for j in later[regions.linked(sets, i, later, percent)].tolist() if len(later) else ():
                out.append((cell, None, names[j], names[i], None, None))
        d = np.stack([sets.distances(i, idx) for i in range(k)], axis=1) if len(idx) else np.zeros((0, k))
        for i in range(k):
            near = idx[regions.linked(sets, i, idx, percent)] if len(idx) else idx
            out += [(cell, None, names[j], names[i], None, None) for j in near.tolist()]
        least = d.min(axis=1, initial=np.inf)
        nearest = d.argmin(axis=1) if len(idx) else least
        for q in range(k):
            for r in np.flatnonzero(d[:, q] <= least + 2 * radius + regions.EPS).tolist():
                out.append((cell, names[q], names[idx[r]], None, float(d[r, q]), bool(nearest[r] == q)))
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.bool_()]
        return pa.table({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(zip(("cell", "q", "name", "link", "d", "core"), types, strict=True))})

    both = blocked.union(pivots.select("cell", "block", "name", "n", "members", F.lit(True).alias("pivot")))
    return both.groupBy("cell", "block").applyInArrow(split, "cell long, q binary, name binary, link binary, d double, core boolean")


def join_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links of regions that pivots don't shrink, (cell, name, n, members, total, c), two blocks at a time; c: component."""
    blocked = _blocks(rows)
    spread = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = spread.select("cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "name", "members", "c")

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by([("name", "ascending")])
        names, sets = table.column("name").to_pylist(), _sets(table)
        labels = regions.Labels(len(names), np.unique(np.array(table.column("c").to_pylist(), dtype=object), return_inverse=True)[1])
        regions.exact(sets, np.arange(len(names)), labels, percent)
        return _edges(names, labels.links)

    return paired.groupBy("cell", "x", "y").applyInArrow(pair, "a binary, b binary")


# -- the join ----------------------------------------------------------------


def _totals(cells: DataFrame) -> DataFrame:
    """The rows with ``total``, the weight of their cell."""
    return cells.join(cells.groupBy("cell").agg(F.sum(F.expr(WEIGHT)).alias("total")), "cell")


def links(slim: DataFrame, rows: DataFrame, words: int, percent: int, work: Scratch) -> DataFrame | None:
    """(node, component) of the sets that have a set within the radius; ``rows``: as of :func:`named`."""
    spark = slim.sparkSession
    shingles_in_all = rows.agg(F.sum("n")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles_in_all * 8 * (100 - percent) // 300 // ENTRIES))
    met = work.table(shared_keys(index_entries(slim, words, percent, 4 * partitions), partitions), "keys")
    close = work.table(enough(met), "close")
    work.drop(met)
    pairs = work.table(cells_of(close), "pairs")
    work.drop(close)
    named_once = rows.where("n > 0").select("s", "name", "n").distinct()
    cells = work.table(_totals(pairs.join(named_once, "s").select("cell", "name", "n", (F.col("s") == F.col("cell")).alias("pivot"))), "cells")
    whole = members(slim, words, bit_map_of(spark, pairs.select("s").distinct()))
    edges = _recurse(cells, whole, percent, work)
    work.drop(pairs, cells)
    groups = work.table(components(edges), "groups")
    return groups


def _recurse(cells: DataFrame, whole: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """The edges of all cells (cell, name, n, total, pivot); ``whole``: (name, members), some maybe several times."""
    done: list[DataFrame] = []
    sets: DataFrame | None = None
    turn = 0
    while True:
        fits = cells.where(F.col("total") <= TASK)
        bunches = max(1, -(-(fits.agg(F.sum(F.expr(WEIGHT))).first()[0] or 0) // TASK))
        done.append(work.table(join_cells(fits, whole if sets is None else sets, percent, bunches), "edges"))
        large = cells.where(F.col("total") > TASK)
        if large.isEmpty():
            break
        turn += 2
        if sets is None:
            some = whole.join(large.select("name").distinct(), "name", "left_semi")
            sets = work.table(some.groupBy("name").agg(F.first("members").alias("members")), "sets")
        dealt = work.table(deal(large.join(sets, "name"), percent, turn), "dealt")
        done.append(work.table(dealt.where("link IS NOT NULL").select(F.col("name").alias("a"), F.col("link").alias("b")).distinct(), "edges"))
        labels = components(_all(done))
        parts = dealt.where("q IS NOT NULL")
        reach = parts.where("core").groupBy("cell", "q").agg(F.max("d").alias("reach"))
        kept = parts.join(reach, ["cell", "q"]).where(F.col("core") | (F.col("d") <= F.col("reach") + (1 - percent / 100) + regions.EPS))
        kept = kept.join(labels.withColumnRenamed("node", "name"), "name", "left").select("cell", "q", "name", F.coalesce("component", "name").alias("c"))
        mixed = kept.groupBy("cell", "q").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("cell", "q")
        sub = kept.join(mixed, ["cell", "q"]).join(large.select("cell", "name", "n", F.col("total").alias("before")), ["cell", "name"])
        parted = work.table(sub.select(F.xxhash64("cell", "q").alias("cell"), F.col("cell").alias("parent"), "name", "n", "before"), "parted")
        work.drop(dealt)
        # Where regions don't shrink, or copies at borders outgrow what they save, the cell is joined block by block instead.
        regional = parted.groupBy("parent", "cell", "before").agg(F.sum(F.expr(WEIGHT)).alias("own"))
        pairs = regional.groupBy("parent", "before").agg(F.sum(F.col("own").cast("double") * F.col("own")).alias("pairs"))
        stuck = pairs.where(F.col("pairs") > regions.SHRUNK * F.col("before").cast("double") * F.col("before")).select(F.col("parent").alias("cell"))
        if not stuck.isEmpty():
            left = large.join(stuck, "cell", "left_semi").join(labels.withColumnRenamed("node", "name"), "name", "left").withColumn("c", F.coalesce("component", "name"))
            done.append(work.table(join_blocks(left.join(sets, "name"), percent), "edges"))
            parted = parted.join(stuck.withColumnRenamed("cell", "parent"), "parent", "left_anti")
        cells = work.table(_totals(parted.select("cell", "name", "n")).withColumn("pivot", F.lit(False)), "cells")
    return _all(done)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _labelled(slim: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of ``slim``: doc_id, n, name, c (the component, by the name of a set) and the columns behind the text."""
    work = Scratch(slim.sparkSession)
    rows = work.table(named(slim, words), "named")
    groups = links(slim, rows, words, percent, work)
    return rows.join(groups.withColumnRenamed("node", "name"), "name", "left").withColumn("c", F.coalesce("component", "name"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    work = Scratch(docs.sparkSession)
    slim = _slim(docs, id_col, text_col)
    rows = work.table(named(slim, words), "named")
    groups = links(slim, rows, words, percent, work)
    # Copies of a set meet in partial aggregates; the join that brings the result back to rows may be split.
    once = rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least")).join(groups.withColumnRenamed("node", "name"), "name", "left")
    once = work.table(once.select("name", "least", F.coalesce("component", "name").alias("c")), "once")
    least = once.groupBy("c").agg(F.min("least").alias("component_id"))
    found = work.table(once.join(least, "c").select("name", "component_id"), "found")
    work.drop(once, groups)
    joined = rows.join(found, "name", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, of every component exactly one; columns as they were.

    It is the one with the smallest id, null ids last, then by a 64-bit hash of the text; of rows with both in common the
    smallest by all columns.  A component is a row's by its id and text, so an id with two texts may be in two components.
    Texts without words are in no component and all stay.
    """
    text = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    slim = _slim(docs, f"`{id_col}`", f"`{text_col}`").withColumn("t", F.xxhash64("text"))
    work = Scratch(docs.sparkSession)
    rows = work.table(_labelled(slim, words, percent).where("n > 0").groupBy("c", "doc_id", "t").agg(F.count("*").alias("rows")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    least = rows.groupBy("c").agg(F.min(order).alias("least"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t") == F.col("least.t"))
    # What stays once and has no copies needs nothing; here is the rest, with whether one row of it stays.
    odd = work.table(rows.join(least, "c").withColumn("stays", stays).where("NOT stays OR rows > 1").select("doc_id", "t", "stays"), "odd")
    work.drop(rows)
    # All of a document's columns travel in a struct, so none of their names can clash with ours.
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    same = lambda other: keyed["_id"].eqNullSafe(other["doc_id"]) & (keyed["_t"] == other["t"])
    kept = keyed.join(odd, same(odd), "left_anti").select("doc")
    repeated = odd.where("stays")
    if not repeated.isEmpty():
        one = keyed.join(repeated, same(repeated), "left_semi").groupBy("_id", "_t").agg(F.min("doc").alias("doc"))
        kept = kept.union(one.select("doc"))
    return kept.select("doc.*")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
