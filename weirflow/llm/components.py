"""Connected components of an edge table by alternating large and small stars.

Every round rewires each node's larger neighbours (large star), then its smaller
ones (small star), to the smallest neighbour, until nothing changes; rounds grow
with the logarithm of a component's size.  Minima are partial aggregates and the
joins that bring them back are equi-joins that adaptive execution may split, so
a hub with a third of all edges does not land in one task.  Each round is written
to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.workspace import Scratch


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and u's neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b) that isn't its component's smallest itself."""
    work = Scratch(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = work.table(now, "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = work.table(_star(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        starred = _star(large)
        small = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v"))).distinct()
        after = work.table(small, "small")
        work.drop(now, large)
        now = after
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
