"""Exact top-k inner products over vectors sorted by length.

Candidates are dealt into slices by descending length, and queries into blocks by
how many slices they need: a query whose k-th best so far is f needs no candidate
shorter than f over its own length (Cauchy-Schwarz).  A block and a slice that it
needs form a cell, a task of bounded size; no other cell is made.  In a cell
candidates come by descending length, too.  A rotation (the right singular vectors of a bounded sample)
puts most of a vector's length into its first coordinates; the product over
these plus, by Cauchy-Schwarz, the product of the lengths of the rest bounds
the whole product.  Pairs whose bound stays below the query's k-th best so far
are dropped, a query ends once the longest candidate left cannot reach it, and
what survives is computed exactly in integers.  The k-th best starts from the
longest candidates of all (a head of bounded size that every query sees first).

Defined results: vectors that are null or empty or hold null or non-finite
components, and rows without id, take no part; rows with the query's id are not
its candidates; of repeated query ids the smallest vector is the query; ties go
to smaller ids; vectors of fewer components count as filled up with zeros;
vectors with a component beyond 2^20 are in no slice: every query meets them, and
they meet every slice, in Python integers, so that no finite component is too
large; products are exact, and those beyond a 64-bit number count as its ends; no
queries or candidates give no rows; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.vectors import Slices, exact_products, matrix, valid, widened

SCALE = 256
K = 5
CELL_ROWS, CELL_QUERIES, LEAST_SLICES = 4096, 2048, 16
HEAD, SAMPLE = 1024, 4096  #: longest candidates that every query sees first; vectors that fit the rotation
LEADING = 16  #: coordinates of the partial sums
BLOCK = 1024
LARGE = float(2**20)  #: components of vectors in slices; products of up to 2^13 of them are exact in doubles
EXACT = 64  #: queries whose products are made in Python integers at a time


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as float64 that holds whole numbers."""
    return np.floor(scale * x)


def large(x: np.ndarray, scale: float) -> np.ndarray:
    """Which rows are in no slice."""
    with np.errstate(over="ignore"):
        return np.abs(scale * x).max(axis=1, initial=0) > LARGE


def search_rows(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`search_cell`, of unscaled vectors, large ones among them."""
    width = max(q.shape[1], c.shape[1])
    q, c = widened(q, width), widened(c, width)
    q_large, c_large = large(q, scale), large(c, scale)
    few, rest = np.flatnonzero(~q_large), np.flatnonzero(~c_large)
    n, ids, score = search_cell(q_ids[few], whole(q[few], scale), floor[few], c_ids[rest], whole(c[rest], scale), rotation, k)
    best = (few[n], ids, score)
    for asks, held in ((np.flatnonzero(q_large), np.arange(len(c))), (few, np.flatnonzero(c_large))):
        for at in range(0, len(asks) if len(held) else 0, EXACT):
            part = asks[at : at + EXACT]
            row, col = np.nonzero(q_ids[part, None] != c_ids[None, held])
            exact = exact_products(q[part], c[held], scale)[row, col]
            best = best_of(*(np.concatenate(x) for x in zip(best, (part[row], c_ids[held][col], exact), strict=True)), k)
    return best


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as int64 (beyond its range: its ends)."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q], dtype=object).reshape(len(q), len(c))
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query number the k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, ~scores, query))  # the complement has no number that cannot be negated
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query, side="left")
    top = np.arange(len(query)) - first < k
    return query[top], ids[top], scores[top]


def search_cell(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of the candidates of one cell that may be among a query's k best."""
    width = max(q.shape[1], c.shape[1], len(rotation))
    q, c = widened(q, width), widened(c, width)
    turn = np.eye(width)
    turn[: len(rotation), : len(rotation)] = rotation
    length = np.sqrt((c * c).sum(axis=1))
    order = np.lexsort((c_ids, -length))
    c, c_ids, length = c[order], c_ids[order], length[order]
    q_turned, c_turned = q @ turn, c @ turn
    lead = min(LEADING, width)
    q_length, q_rest = np.sqrt((q * q).sum(axis=1)), np.sqrt((q_turned[:, lead:] ** 2).sum(axis=1))
    c_rest = np.sqrt((c_turned[:, lead:] ** 2).sum(axis=1))
    floor = floor.astype(np.float64).copy()
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(c), BLOCK):
        slack = 1e-6 * (1 + q_length * length[at])
        live = np.flatnonzero(q_length * length[at] + slack >= floor)
        if not len(live):
            break
        part = slice(at, at + BLOCK)
        bound = q_turned[live, :lead] @ c_turned[part, :lead].T + q_rest[live, None] * c_rest[None, part]
        row, col = np.nonzero((bound + slack[live, None] >= floor[live, None]) & (q_ids[live, None] != c_ids[None, part]))
        if not len(row):
            continue
        rows, columns = np.unique(row), np.unique(col)
        exact = products(q[live[rows]], c[part][columns])[np.searchsorted(rows, row), np.searchsorted(columns, col)]
        hit = exact >= floor[live[row]]
        found = (live[row[hit]], c_ids[part][col[hit]], exact[hit])
        best = best_of(*(np.concatenate(x) for x in zip(best, found, strict=True)), k)
        last = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
        kth = np.searchsorted(best[0], last, side="right") - 1
        floor[last] = np.maximum(floor[last], best[2][kth])
    return best


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its k best of all rows by inner product of floor(scale * x)."""
    fine = vectors.where(valid(vec_col) & F.col(id_col).isNotNull())
    rows = fine.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    big = F.exists("v", lambda x: F.abs(x * scale) > LARGE)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    # Two samples of proven size come to the driver: the longest candidates, and rows by the order of a hash.
    head = rows.where(~big).select("id", "v", length.alias("l")).orderBy(F.desc("l"), "id").limit(HEAD).select("id", "v").toArrow()
    sample = rows.where(~big).select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").toArrow()
    head_ids, head_v = head.column("id").to_numpy(), whole(matrix(head.column("v")), scale)
    fitted = whole(matrix(sample.column("v")), scale)
    rotation = np.linalg.svd(fitted, full_matrices=True)[2].T if len(fitted) else np.eye(1)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, q = batch.column(0).to_numpy(), matrix(batch.column(1))
            width = max(q.shape[1], head_v.shape[1])
            fine = ~large(q, scale)
            found = np.full(len(ids), -np.inf)
            found[fine] = best_of_head(ids[fine], widened(whole(q[fine], scale), width), head_ids, widened(head_v, width), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["id", "v", "floor"])

    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(first_look, "id long, v array<double>, floor double")
    # Slices by the negative length, so that the longest come first; what comes to the driver is a row per bin.
    minus = (-F.sqrt(length)).alias("x")
    low, high, total, beyond = rows.select(minus, big.alias("big")).agg(F.min(F.when(~F.col("big"), F.col("x"))), F.max(F.when(~F.col("big"), F.col("x"))), F.count("*"), F.count_if("big")).first()
    low, high = float(low or 0.0), float(high or 0.0)
    binned = rows.where(~big).select("id", "v", Slices.bin_of(minus, low, high).alias("bin"))
    cut = Slices(low, high, {int(b): int(n) for b, n in binned.groupBy("bin").count().collect()}, min(CELL_ROWS, max(1, -(-total // LEAST_SLICES))))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q, floor = matrix(batch.column(1)), batch.column(2).to_numpy()
                q = np.where(large(q, scale)[:, None], 0.0, whole(np.where(large(q, scale)[:, None], 0.0, q), scale))  # large ones have no floor and need all
                own = np.sqrt((q * q).sum(axis=1))
                # A slice's longest candidate has the length -least; lengths and products are rounded up.
                shortest = np.where(own > 0, (floor - 1e-6 * np.abs(floor) - 1) / np.maximum(own, 1e-300) * (1 - 1e-9), -np.inf)
                last = np.where((own == 0) & (floor > 0), 0, np.searchsorted(cut.least, np.where(np.isfinite(shortest), -shortest, np.inf), side="right") - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(last, 0, len(cut) - 1))], names=["id", "v", "floor", "last"])

    needing = queries.mapInArrow(need, "id long, v array<double>, floor double, last long")
    kind = F.floor(F.log2(F.col("last") + 1)).cast("long")  # queries of a block need about as many slices
    needing = needing.withColumn("kind", kind)
    kinds = sorted(((int(x), int(n), int(most)) for x, n, most in needing.groupBy("kind").agg(F.count("*"), F.max("last")).collect()), reverse=True)  # some dozens of rows
    blocks: list[tuple[int, int, int]] = []  # (kind, its first block, how many)
    tops: list[int] = []  # per block the last slice that it needs, descending
    for x, n, most in kinds:
        many = -(-n // CELL_QUERIES)
        blocks.append((x, len(tops), many))
        tops += [most] * many
    wanted = len(tops) - np.searchsorted(np.array(tops[::-1], dtype=np.int64), np.arange(len(cut)))  # per slice how many blocks, from the first, need it

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = cut.of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(wanted[c]), *batch.columns[2:]], names=["c", "n", "id", "v"])

    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    dealt = binned.select("bin", F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("h"), "id", "v").mapInArrow(deal, "c long, n long, id long, v array<double>")
    block = F.lit(0).cast("long")
    for x, first, many in blocks:
        block = F.when(F.col("kind") == x, F.lit(first) + F.pmod(F.xxhash64("id"), F.lit(many))).otherwise(block)
    # Large candidates are cells of their own, numbered from -1 down, that every query visits.
    apart = -(-int(beyond) // CELL_ROWS)
    odd = rows.where(big).select((-1 - F.pmod(F.xxhash64("id"), F.lit(max(apart, 1)))).alias("c"), F.lit(len(tops)).cast("long").alias("n"), "id", "v")
    first = F.lit(-apart).cast("long")
    cells = dealt.unionByName(odd).where("n > 0").select("c", to(F.col("n")).alias("q"), F.lit(False).alias("asks"), "id", "v", F.lit(0.0).alias("floor")).union(
        needing.select(F.explode(F.sequence(first, F.col("last"))).alias("c"), block.alias("q"), F.lit(True).alias("asks"), "id", "v", "floor")
    )

    def look(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        ids, v, floor = table.column("id").to_numpy(), matrix(table.column("v")), table.column("floor").to_numpy()
        n, vec, score = search_rows(ids[asks], v[asks], floor[asks], ids[~asks], v[~asks], rotation, k, scale)
        return pa.table({"query_id": pa.array(ids[asks][n], pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})

    found = cells.groupBy("c", "q").applyInArrow(look, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of_head(ids: np.ndarray, q: np.ndarray, head_ids: np.ndarray, head: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best product among the head; minus infinity where it has fewer candidates."""
    if len(head) <= k:
        return np.full(len(q), -np.inf)
    score = products(q, head).astype(np.float64)
    score[ids[:, None] == head_ids[None, :]] = -np.inf
    return np.partition(score, len(head) - k, axis=1)[:, len(head) - k]


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``embeddings``: every 50th id asks."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
