"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors are collapsed first, so a vector that a third of all rows hold is
one row.  The distinct ones are dealt into slices in the order of their products
with a fixed unit vector (the first singular direction of a bounded sample).
Unit vectors with a cosine of at least t are at most sqrt(2 - 2t) apart, and so
are their products with any unit vector: only slices that near form a cell.  A
cell's tile of cosines is bounded from int8 products: with v = s q + e and
w = t p + f for unit vectors v and w,

    |v.w - s t q.p| <= |s q| |f| + |e| |t p| + |e| |f|,

all of which are known per vector.  Only pairs whose upper bound reaches the
threshold are computed again in double precision.  A cell returns sums of links
per vector and a spanning forest of its links, never the pairs, so dense groups
cost rows in proportion to their vectors.  Distinct vectors are named by 128 bits
of hashes.

Defined results: vectors that are null, zero or empty or hold null or
non-finite components link with nothing and stay; repeated rows are vectors of
their own; vectors of different sizes are filled up with zeros; null ids take
part but are never a component's name unless all are null; an empty table gives
an empty table; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weirflow.llm.components import components
from weirflow.llm.vectors import Slices, matrix, valid
from weirflow.llm.workspace import Scratch

THRESHOLD = 0.95
SLICE_ROWS, LEAST_SLICES = 8192, 16
SAMPLE = 4096  #: vectors that fit the direction along which slices are ordered
BLOCK = 512


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes and scale of unit rows, the lengths of what the codes stand for and of what they miss."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    stood = codes * scale[:, None]
    return codes, scale, np.sqrt((stood**2).sum(axis=1)), np.sqrt(((unit - stood) ** 2).sum(axis=1))


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float):
    """Yield (rows, columns) of pairs of a x b with a cosine of at least ``threshold``, block by block of rows."""
    a, b = moderate(a), moderate(b)
    a_len, b_len = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    qa, sa, na, ea = quantised(a / a_len[:, None])
    qb, sb, nb, eb = quantised(b / b_len[:, None])
    codes_b = qb.astype(np.float32).T  # products of int8 codes are exact in float32: at most 127 * 127 * 1040 components
    sb32, miss_b, sum_b = sb.astype(np.float32), eb.astype(np.float32), (nb + eb).astype(np.float32)
    for at in range(0, len(a), BLOCK):
        part = slice(at, at + BLOCK)
        upper = qa[part].astype(np.float32) @ codes_b
        upper *= sa[part, None].astype(np.float32)
        upper *= sb32
        upper += na[part, None].astype(np.float32) * miss_b
        upper += ea[part, None].astype(np.float32) * sum_b
        row, col = np.nonzero(upper >= np.float32(threshold - 1e-5))
        if not len(row):
            continue
        rows, columns = np.unique(row), np.unique(col)
        exact = (a[part][rows] @ b[columns].T) / (a_len[part][rows, None] * b_len[None, columns])
        hit = exact[np.searchsorted(rows, row), np.searchsorted(columns, col)] >= threshold
        yield row[hit] + at, col[hit]


def moderate(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one: their cosines stay, and no square over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest-index labels after linking i with j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        low = np.minimum(a[apart], b[apart])
        np.minimum.at(label, a[apart], low)
        np.minimum.at(label, b[apart], low)
        while (label != label[label]).any():
            label = label[label]


def axis(distinct: DataFrame) -> np.ndarray:
    """A unit vector along which vectors differ most, from a sample by the order of their names."""
    sample = unit(matrix(distinct.orderBy("rep").limit(SAMPLE).select("v").toArrow().column("v")))
    return np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)[2][0] if len(sample) else np.ones(1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    v = moderate(v)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def projected(distinct: DataFrame, along: np.ndarray) -> DataFrame:
    """``distinct`` with ``x``, the product of each unit vector with ``along`` (components that one of them lacks count as zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = distinct_names.index("v")
        for batch in batches:
            v = unit(matrix(batch.column(at)))
            width = min(v.shape[1], len(along))
            x = v[:, :width] @ along[:width]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=[*distinct_names, "x"])

    distinct_names = distinct.columns
    return distinct.mapInArrow(run, StructType([*distinct.schema, StructField("x", DoubleType())]))


def links(distinct: DataFrame, threshold: float, rows: int) -> DataFrame:
    """(id, other, n): per cell the number of rows that a vector links with, and an edge of a spanning forest (or null)."""
    near = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    placed = projected(distinct, axis(distinct)).withColumn("bin", Slices.bin_of(F.col("x"), -1.0, 1.0))
    cut = Slices(-1.0, 1.0, {int(b): int(n) for b, n in placed.groupBy("bin").count().collect()}, rows)  # a row per bin
    # Slice y is near slice x if their ranges are; ranges come in order, so the near ones are a run.
    lo = np.searchsorted(cut.most, cut.least - near)
    hi = np.searchsorted(cut.least, cut.most + near, side="right") - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = cut.of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(lo[g]), pa.array(hi[g]), *batch.columns[2:]], names=["g", "lo", "hi", "rep", "v", "copies"])

    keyed = placed.select("bin", F.pmod(F.xxhash64("rep"), F.lit(1 << 31)).alias("h"), "rep", "v", "copies")
    dealt = keyed.mapInArrow(deal, "g long, lo long, hi long, rep string, v array<double>, copies long")
    cells = dealt.withColumn("h", F.explode(F.sequence("lo", "hi"))).select(
        F.least("g", "h").alias("x"), F.greatest("g", "h").alias("y"), (F.col("g") > F.col("h")).alias("second"), "rep", "v", "copies",
    )

    def tile(table: pa.Table) -> pa.Table:
        ids, copies, v = np.array(table.column("rep").to_pylist(), dtype=object), table.column("copies").to_numpy(), matrix(table.column("v"))
        second = table.column("second").to_numpy().astype(bool)
        own = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        one = np.arange(len(ids)) if own else np.flatnonzero(~second)
        two = one if own else np.flatnonzero(second)
        count, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for row, col in linked_pairs(v[one], v[two], threshold) if len(one) and len(two) else ():
            i, j = one[row], two[col]
            if own:
                other = i < j
                i, j = i[other], j[other]
            count += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            label = _join_labels(label, i, j)
        at = np.flatnonzero(count)
        other = np.where(label[at] != at, ids[label[at]], ids[at])
        return pa.table({"id": pa.array(ids[at], pa.string()), "other": pa.array(other, pa.string()), "n": pa.array(count[at], pa.int64())})

    return cells.groupBy("x", "y").applyInArrow(tile, "id string, other string, n long")


def name_of(vec_col: str) -> Column:
    """128 bits of hashes of a vector, as text."""
    return F.concat_ws("-", F.hex(F.xxhash64(vec_col)), F.hex(F.xxhash64(F.lit(1), F.col(vec_col))))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = valid("v") & F.exists("v", lambda x: x != 0)
    keyed = rows.select("vec_id", F.when(fine, F.transform("v", lambda x: x + 0.0)).alias("v"))  # no negative zeros
    distinct = keyed.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").cast("long").alias("copies"))
    # A hash names each distinct vector, also where ids are null or repeated.
    work = Scratch(vectors.sparkSession)
    distinct = work.table(distinct.select(name_of("v").alias("rep"), "v", "least", "copies"), "vectors")
    rows_a_slice = min(SLICE_ROWS, max(1, -(-distinct.count() // LEAST_SLICES)))
    found = work.table(links(distinct.select("rep", "v", "copies"), threshold, rows_a_slice), "links")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = distinct.select("rep", "least", "copies").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = named.join(least, "component").join(counts, "rep", "left").select("rep", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = keyed.select("vec_id", F.when(F.col("v").isNotNull(), name_of("v")).alias("rep")).join(facts, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_near_vectors(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n
), c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN k ON a = vec_id LEFT JOIN c ON n = vec_id
"""
