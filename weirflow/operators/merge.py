"""Merges of a source into a target as plain joins.

Null keys never match, so such source rows are inserted.  A key that a source
has twice is an error where it would update a row; ``assert_unique`` checks it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MergeError(ValueError):
    """A merge whose outcome would be ambiguous, or a null in a key."""


def assert_unique(source: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a non-null key occurs twice."""
    filled = source.dropna(subset=keys)
    if not filled.groupBy(*keys).count().where("count > 1").isEmpty():
        raise MergeError(f"the source has several rows for one {keys}")
    return source


def assert_keys(source: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a key is null."""
    total, nulls = source.agg(F.count("*"), F.count_if(F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull())).first()
    if nulls:
        raise MergeError(f"{nulls} of {total} rows have no {keys}")
    return source


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source whose key the target lacks join it."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows of their key."""
    return source.unionByName(target.join(source.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def conditional(target: DataFrame, source: DataFrame, keys: list[str], when: Callable[[str, str], Column]) -> DataFrame:
    """As ``upsert``, but a matched row is replaced only where ``when('s', 't')`` holds."""
    s, t = source.alias("s"), target.alias("t")
    on = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys]
    joined = t.withColumn("_t", F.lit(True)).alias("t").join(s.withColumn("_s", F.lit(True)).alias("s"), on, "full_outer")
    take = F.col("t._t").isNull() | (F.col("s._s").isNotNull() & F.coalesce(when("s", "t"), F.lit(False)))
    return joined.select(*(F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def close_missing(register: DataFrame, current: DataFrame, keys: list[str], run_id: str, within: Column | None = None) -> DataFrame:
    """Issues seen again are touched, new ones opened, open ones not seen any more (inside the window) resolved.

    Keys are compared null-safely, so an issue without key is one issue, not a new one every run.
    """
    r, c = register.withColumn("_r", F.lit(True)).alias("r"), current.withColumn("_c", F.lit(True)).alias("c")
    joined = r.join(c, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full_outer")
    seen, old = F.col("c._c").isNotNull(), F.col("r._r").isNotNull()
    inside = F.lit(True) if within is None else F.coalesce(within, F.lit(True))
    closes = ~seen & (F.col("r.status") == "open") & inside
    fixed = {
        "status": F.when(seen, F.lit("open")).when(closes, F.lit("resolved")).otherwise(F.col("r.status")),
        "first_seen_run": F.when(old, F.col("r.first_seen_run")).otherwise(F.lit(run_id)),
        "last_seen_run": F.when(seen, F.lit(run_id)).otherwise(F.col("r.last_seen_run")),
    }
    return joined.select(*(
        fixed[n].alias(n) if n in fixed else (F.when(seen, F.col(f"c.{n}")).otherwise(F.col(f"r.{n}")) if n in current.columns else F.col(f"r.{n}")).alias(n)
        for n in register.columns
    ))


def replace_where(target: DataFrame, fresh: DataFrame, inside: Column) -> DataFrame:
    """Rows of the target inside the predicate give way to ``fresh``, also where it has none for their key."""
    return target.where(~F.coalesce(inside, F.lit(False))).unionByName(fresh)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
