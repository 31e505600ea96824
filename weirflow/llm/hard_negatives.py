"""Hard negatives by vantage-point trees over vectors of equal augmented length.

With one more coordinate, sqrt(M^2 - |v|^2) for the largest length M, all vectors
are equally long, and an inner product s with an anchor a is a distance: d^2 =
|a|^2 + M^2 - 2 s.  A window of scores is an annulus around the anchor, and the
highest scores in it are the nearest points beyond its inner radius.

A tree over a bounded sample routes every row to a cell; what is known of a cell
are the true ranges of its rows' distances to the vantage points above it.  An
anchor goes only to cells that its annulus can meet.  In a cell a tree of its own
is opened leaf by leaf, nearest first, until the next leaf is farther than the
k-th best found or than the outer radius.  Cells of more rows than a task should
hold are split by a hash, and so are the anchors that visit them.

Mining searches twice: for an anchor's best rows of its label (an annulus without
inner radius), then, per positive, for the best rows of other labels within the
window that the positive's score spans.

Of rows with one vector and one label only the smallest ids can be among the
first k, as all have one score; the rest of them is left out before the search.
Rows with a component beyond 2^20 are in no tree: every anchor meets them, and
they meet every anchor, in Python integers.

Defined results: rows with a null id or label, or a vector that is null or empty
or holds null or non-finite components, take no part; shorter vectors count as
filled up with zeros; rows that repeat id, label and vector count once; rows
with the anchor's id are not its candidates; of repeated anchor ids the smallest
label and vector is the anchor; ties go to smaller ids; scores beyond 64 bits
count as their ends; without rows, anchors or positives there are no rows; only
the columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.vectors import exact_products, matrix, valid, widened
from weirflow.llm.workspace import Scratch

SCALE = 256  #: a power of two
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  #: a negative's score is at least LOW and at most HIGH per cent of the positive's
LARGE = float(2**20)  #: components of vectors in trees; products of up to 2^13 of them are exact in doubles
SAMPLE = 4096  #: rows that fit the tree of cells and give every anchor its first bounds
CELL_ROWS, CELL_QUERIES, LEAST_CELLS = 4096, 2048, 16
LEAF = 64
FOUND = "id long, tag long, other long, score long"


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as float64 that holds whole numbers; large ones are not to be used."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def small(x: np.ndarray) -> np.ndarray:
    """Which rows may be in a tree."""
    return np.abs(scaled(x)).max(axis=1, initial=0) <= (LARGE if x.shape[1] <= 2**13 else 0)


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query number the k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores.astype(np.float64), query)) if len(scores) and np.abs(scores).max() < 2**53 else np.array(sorted(range(len(scores)), key=lambda i: (query[i], -int(scores[i]), ids[i])), dtype=np.int64)
    query, ids, scores = query[order], ids[order], scores[order]
    top = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[top], ids[top], scores[top]


# -- trees ---------------------------------------------------------------------


def augmented(v: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the coordinate that makes all of them ``longest`` (a squared length) long."""
    return np.column_stack([v, np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0.0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0.0))


@dataclass
class Tree:
    """A full binary tree: node i has a vantage point and a radius; its near half is node 2i + 1, its far half 2i + 2."""

    depth: int
    points: np.ndarray
    radius: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, depth: int) -> tuple[Tree, list[np.ndarray]]:
        """Split rows in halves ``depth`` times; the tree and the row numbers of each leaf."""
        points, radius = np.zeros(((1 << depth) - 1, x.shape[1])), np.zeros((1 << depth) - 1)
        level = [np.arange(len(x))]
        for at in range(depth):
            below = []
            for k, rows in enumerate(level):
                node = (1 << at) - 1 + k
                if len(rows):
                    # The point farthest from the middle of a node sees the largest differences of distance.
                    own = x[rows]
                    points[node] = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
                d = distances(x[rows], points[node][None, :])[:, 0]
                order = np.argsort(d, kind="stable")
                half = (len(rows) + 1) // 2
                radius[node] = d[order[half - 1]] if len(rows) else 0.0
                below += [rows[order[:half]], rows[order[half:]]]
            level = below
        return cls(depth, points, radius), level

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances to the vantage points on the way."""
        node, seen = np.zeros(len(x), dtype=np.int64), np.zeros((len(x), self.depth))
        for at in range(self.depth):
            seen[:, at] = np.sqrt(np.maximum(((x - self.points[node]) ** 2).sum(axis=1), 0.0))
            node = 2 * node + 1 + (seen[:, at] > self.radius[node])
        return node - ((1 << self.depth) - 1), seen

    def path(self, leaves: np.ndarray) -> np.ndarray:
        """The nodes above each leaf, from the root down."""
        node, out = leaves + (1 << self.depth) - 1, []
        for _ in range(self.depth):
            node = (node - 1) // 2
            out.append(node)
        return np.array(out[::-1], dtype=np.int64).reshape(self.depth, len(leaves)).T

    def reach(self, x: np.ndarray, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that each row of ``x`` can have to rows of each leaf; ``low``, ``high``: ranges of the leaves' distances by level."""
        least, most = np.zeros((len(x), len(leaves))), np.full((len(x), len(leaves)), np.inf)
        to, path = distances(x, self.points), self.path(leaves)
        for at in range(self.depth):
            d = to[:, path[:, at]]
            least = np.maximum(least, np.maximum(d - high[None, :, at], low[None, :, at] - d))
            most = np.minimum(most, d + high[None, :, at])
        return least, most


# -- one cell ------------------------------------------------------------------


@dataclass
class Queries:
    """Windows of scores around anchors: ``anchor`` numbers the rows of v, id and label; ``own`` asks for the anchor's label or for others."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray  # unscaled
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    own: bool


def accepted(q: Queries, which: np.ndarray, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Flags of (window, candidate): the label fits, the score lies in the window, the candidate is not the anchor."""
    anchor = q.anchor[which]
    fits = (q.labels[anchor][:, None] == labels[None, :]) == q.own
    return fits & (q.ids[anchor][:, None] != ids[None, :]) & (score >= q.low[which][:, None]) & (score <= q.high[which][:, None])


def search_cell(q: Queries, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, id, score): the k best candidates of each window."""
    width = max(q.v.shape[1], v.shape[1])
    qv, cv = widened(q.v, width), widened(v, width)
    q_small, c_small = small(qv), small(cv)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    q_exact, c_exact = ~q_small[q.anchor], np.flatnonzero(~c_small)
    for which, rows in ((np.flatnonzero(q_exact), np.arange(len(ids))), (np.flatnonzero(~q_exact), c_exact)):
        for w in which.tolist() if len(rows) else ():
            one = np.array([w])
            score = exact_products(qv[q.anchor[one]], cv[rows], SCALE)
            hit = np.flatnonzero(accepted(q, one, ids[rows], labels[rows], score)[0])
            best = best_of(*(np.concatenate(x) for x in zip(best, (np.full(len(hit), w), ids[rows[hit]], score[0, hit]), strict=True)), k)
    rows, which = np.flatnonzero(c_small), np.flatnonzero(~q_exact)
    if len(rows) and len(which):
        found = _search_tree(q, which, scaled(np.where(q_small[:, None], qv, 0.0)), ids[rows], labels[rows], scaled(cv[rows]), best, k)
        done = q_exact[best[0]]  # the other windows' rows are among what the tree has returned
        best = tuple(np.concatenate([x[done], y]) for x, y in zip(best, found, strict=True))
        best = best_of(*best, k)
    return best


def _search_tree(q: Queries, which: np.ndarray, a: np.ndarray, ids: np.ndarray, labels: np.ndarray, c: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``search_cell`` for the windows ``which`` and rows that may be in trees, together with ``known``, what else has been found for them."""
    longest = float((c * c).sum(axis=1).max())
    x = augmented(c, longest)
    depth = max(0, int(np.ceil(np.log2(max(1, len(c) / LEAF)))))
    tree, leaves = Tree.fit(x, depth)
    filled = np.array([i for i, rows in enumerate(leaves) if len(rows)])
    path = tree.path(filled)
    low, high = np.zeros((len(filled), depth)), np.zeros((len(filled), depth))
    for i, leaf in enumerate(filled.tolist()):
        if depth:
            d = distances(x[leaves[leaf]], tree.points[path[i]])
            low[i], high[i] = d.min(axis=0), d.max(axis=0)
    square = (a * a).sum(axis=1)
    least, most = tree.reach(np.column_stack([a, np.zeros(len(a))]), filled, low, high)
    slack = 1e-6 * (1 + np.sqrt(square + longest))
    # Distances as the bounds of scores: the nearest point of a leaf has its highest score.
    top = (square[:, None] + longest - np.maximum(least - slack[:, None], 0.0) ** 2) / 2 + 1
    bottom = (square[:, None] + longest - (most + slack[:, None]) ** 2) / 2 - 1
    order = np.argsort(-top, axis=1, kind="stable")
    floor = q.low[which].astype(np.float64)
    number = np.full(len(q.anchor), -1)
    number[which] = np.arange(len(which))
    mine = number[known[0]] >= 0
    best = (number[known[0][mine]], known[1][mine], known[2][mine])
    row = q.anchor[which]
    live = np.arange(len(which))
    for turn in range(len(filled)):
        leaf = order[row[live], turn]
        reached = top[row[live], leaf] >= floor[live]
        live, leaf = live[reached], leaf[reached]
        if not len(live):
            break
        inside = bottom[row[live], leaf] <= q.high[which[live]]
        found = []
        for i in np.unique(leaf[inside]).tolist():
            asking = live[inside & (leaf == i)]
            rows = leaves[filled[i]]
            anchors, again = np.unique(row[asking], return_inverse=True)
            score = (a[anchors] @ c[rows].T)[again]
            one, two = np.nonzero(accepted(q, which[asking], ids[rows], labels[rows], score))
            found.append((asking[one], ids[rows][two], score[one, two].astype(np.int64)))
        if found:
            best = best_of(*(np.concatenate(z) for z in zip(best, *found, strict=True)), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(which)) >= k)
            last = np.searchsorted(best[0], full, side="right") - 1
            floor[full] = np.maximum(floor[full], best[2][last])
    return which[best[0]], best[1], best[2]


# -- all cells -----------------------------------------------------------------


class Cells:
    """Rows dealt into the cells of a tree, and the search of all of them."""

    def __init__(self, rows: DataFrame, work: Scratch) -> None:
        """``rows``: id, label, v (unscaled, valid)."""
        self.work = work
        # A sample of bounded size comes to the driver, rows by the order of a hash.
        sample = rows.select("id", "label", "v", F.xxhash64("id", "label").alias("h")).orderBy("h", "id", "label", "v").limit(SAMPLE).toArrow()
        self.sample = (sample.column("id").to_numpy(), sample.column("label").to_numpy(), matrix(sample.column("v")))
        wide = rows.select(F.max(F.size("v"))).first()[0] or 1
        self.width = int(wide)
        fits = F.forall("v", lambda x: (x * SCALE >= -LARGE) & (x * SCALE <= LARGE)) if self.width <= 2**13 else F.lit(False)
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
        total, longest = rows.select(F.count("*"), F.max(F.when(fits, square))).first()
        self.longest = float(longest or 0.0)
        v = widened(self.sample[2], self.width)
        v = scaled(v[small(v)])
        cells = max(LEAST_CELLS, -(-int(total) // CELL_ROWS))
        depth = max(0, min(int(np.ceil(np.log2(cells))), int(np.log2(max(1, len(v) / 8)))))
        self.tree, _ = Tree.fit(augmented(v, self.longest * (1 + 1e-9)), depth)
        tree, longest, width = self.tree, self.longest * (1 + 1e-9), self.width

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x = widened(matrix(batch.column(2)), width)
                fine = small(x)
                cell, seen = tree.route(augmented(scaled(np.where(fine[:, None], x, 0.0)), longest))
                cell = np.where(fine, cell, -1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(seen.ravel()), tree.depth).cast(pa.list_(pa.float64())) if tree.depth else pa.array([[]] * len(batch), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), lists], names=["id", "label", "v", "cell", "seen"])

        dealt = rows.select("id", "label", "v").mapInArrow(deal, "id long, label long, v array<double>, cell long, seen array<double>")
        self.rows = work.table(dealt, "cells")
        # One row per cell of the tree: at most SAMPLE / 8 of them.
        ranges = [f(F.col("seen")[i]) for i in range(depth) for f in (F.min, F.max)]
        known = sorted(tuple(r) for r in self.rows.groupBy("cell").agg(F.count("*"), *ranges).collect())
        self.cell = np.array([r[0] for r in known], dtype=np.int64)
        self.parts = {r[0]: max(1, -(-r[1] // CELL_ROWS)) for r in known}
        regular = [r for r in known if r[0] >= 0]
        self.regular = np.array([r[0] for r in regular], dtype=np.int64)
        self.low = np.array([r[2::2] for r in regular], dtype=np.float64).reshape(len(regular), depth)
        self.high = np.array([r[3::2] for r in regular], dtype=np.float64).reshape(len(regular), depth)

    def _needed(self, own: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Anchors with their windows narrowed by the sample, and the cells that they meet."""
        tree, width, longest, regular, low, high, every = self.tree, self.width, self.longest * (1 + 1e-9), self.regular, self.low, self.high, self.cell
        s_ids, s_labels, s_v = self.sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                q = windows(batch, own)
                first = search_cell(q, s_ids, s_labels, s_v, k)
                full = np.flatnonzero(np.bincount(first[0], minlength=len(q.anchor)) >= k)
                least = q.low.copy()
                least[full] = np.maximum(least[full], first[2][np.searchsorted(first[0], full, side="right") - 1])
                v = widened(q.v, width)
                fine = small(v)
                a = scaled(np.where(fine[:, None], v, 0.0))
                near, far = tree.reach(np.column_stack([a, np.zeros(len(a))]), regular, low, high)
                square = (a * a).sum(axis=1)
                slack = 1e-6 * (1 + np.sqrt(square + longest))
                top = (square[:, None] + longest - np.maximum(near - slack[:, None], 0.0) ** 2) / 2 + 1
                bottom = (square[:, None] + longest - (far + slack[:, None]) ** 2) / 2 - 1
                meets = (top[q.anchor] >= least[:, None].astype(np.float64)) & (bottom[q.anchor] <= q.high[:, None]) & (least <= q.high)[:, None]
                any_of = np.zeros((len(q.ids), len(regular)), dtype=bool)
                np.logical_or.at(any_of, q.anchor, meets)
                any_of[~fine] = True
                cells = [[*every[every < 0].tolist(), *regular[m].tolist()] for m in any_of]
                ends = np.cumsum(np.bincount(q.anchor, minlength=len(q.ids)))
                lows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(least))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), lows, batch.column(5), pa.array(cells, pa.list_(pa.int64()))], names=["id", "label", "v", "tags", "lows", "highs", "cells"])

        return run

    def search(self, queries: DataFrame, own: bool, k: int) -> DataFrame:
        """(id, tag, other, score): for every anchor (id, label, v) and window (tags, lows, highs) its k best rows of its label, or of others."""
        asking = "id long, label long, v array<double>, tags array<long>, lows array<long>, highs array<long>"
        needing = self.work.table(queries.select("id", "label", "v", "tags", "lows", "highs").mapInArrow(self._needed(own, k), f"{asking}, cells array<long>"), "anchors")
        visits = needing.select("id", "label", "v", "tags", "lows", "highs", F.explode("cells").alias("cell"))
        # One row per cell again.
        blocks = {int(c): max(1, -(-int(n) // CELL_QUERIES)) for c, n in visits.groupBy("cell").count().collect()}
        of = lambda numbers: F.create_map(*(F.lit(int(x)) for pair in sorted(numbers.items()) for x in pair))[F.col("cell")].cast("long")
        if not blocks:
            return needing.sparkSession.createDataFrame([], f"{FOUND}, rank int")
        to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        none = F.lit(None).cast("array<long>")
        held = self.rows.where(F.col("cell").isin([int(c) for c in blocks])).select("cell", F.pmod(F.xxhash64("id", "label", "v"), of(self.parts)).alias("part"), to(of(blocks)).alias("block"), "id", "label", "v", none.alias("tags"), none.alias("lows"), none.alias("highs"))
        asks = visits.select("cell", to(of(self.parts)).alias("part"), F.pmod(F.xxhash64("id"), of(blocks)).alias("block"), "id", "label", "v", "tags", "lows", "highs")

        def look(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            asks = table.column("tags").is_valid()
            anchors, held = table.filter(asks), table.filter(pc.invert(asks))
            batch = pa.RecordBatch.from_arrays([pa.array([], f.type) if not len(anchors) else anchors.column(f.name).combine_chunks() for f in anchors.schema if f.name not in ("cell", "part", "block")], names=["id", "label", "v", "tags", "lows", "highs"])
            if not len(anchors) or not len(held):
                return pa.table({c: pa.array([], pa.int64()) for c in ("id", "tag", "other", "score")})
            q = windows(batch, own)
            n, other, score = search_cell(q, held.column("id").to_numpy(), held.column("label").to_numpy(), matrix(held.column("v")), k)
            tags = batch.column(3).flatten().to_numpy()
            return pa.table({"id": pa.array(q.ids[q.anchor[n]]), "tag": pa.array(tags[n]), "other": pa.array(other, pa.int64()), "score": pa.array(score, pa.int64())})

        found = held.unionByName(asks).groupBy("cell", "part", "block").applyInArrow(look, FOUND)
        place = F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.desc("score"), "other"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)


def windows(batch: pa.RecordBatch, own: bool) -> Queries:
    """The anchors of a batch (id, label, v, tags, lows, highs) and their windows."""
    sizes = np.diff(batch.column(4).offsets.to_numpy())
    anchor = np.repeat(np.arange(len(batch)), sizes)
    return Queries(batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2)), anchor, batch.column(4).flatten().to_numpy().astype(np.int64), batch.column(5).flatten().to_numpy().astype(np.int64), own)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor and positive the best rows of other labels within the window.

    ``low`` and ``high`` bound a negative's score in per cent of the positive's.
    """
    fine = valid(vec_col) & F.col(id_col).isNotNull() & label.isNotNull()
    plain = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), plain.alias("v"), is_anchor.alias("asks"))
    work = Scratch(vectors.sparkSession)
    # Rows of one vector and label have one score: beside the anchor's own, the smallest ids are the first.
    first = F.dense_rank().over(Window.partitionBy("v", "label").orderBy("id"))
    leading = rows.select("id", "label", "v", first.alias("nth")).where(F.col("nth") <= max(positives, negatives) + 1).dropDuplicates(["v", "label", "id"])
    cells = Cells(work.table(leading.select("id", "label", "v"), "rows"), work)
    anchors = rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    lowest, highest = (F.array(F.lit(x).cast("long")) for x in (-(2**63), 2**63 - 1))
    best = work.table(cells.search(anchors.select("id", "label", "v", F.array(F.lit(0).cast("long")).alias("tags"), lowest.alias("lows"), highest.alias("highs")), True, positives), "positives")
    # Whole numbers n with low * s <= 100 * n <= high * s.
    up = lambda s: F.expr(f"CAST(CEIL(CAST({s} AS DECIMAL(20, 0)) * {int(low)} / 100) AS LONG)")
    down = lambda s: F.expr(f"CAST(FLOOR(CAST({s} AS DECIMAL(20, 0)) * {int(high)} / 100) AS LONG)")
    spans = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("tag"), up("score").alias("low"), down("score").alias("high")))).alias("w"))
    again = anchors.join(spans, "id").select("id", "label", "v", F.col("w.tag").alias("tags"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = cells.search(again, False, negatives)
    # A window is known by its positive's rank, as ids may repeat.
    named = best.select("id", F.col("rank").cast("long").alias("tag"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    scored = found.join(named, ["id", "tag"])
    return scored.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``embeddings``: every 100th id is an anchor, and every seventh id has another label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same
), n AS (
  SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.r <= 5
) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
