"""Orders of rows in files."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6  #: of each column in the curve's key: 64 ranges
SAMPLE = 4096  #: rows, by the order of a hash, that cut a column into ranges


def _rank(column: Column, cuts: list, base: int = 0) -> Column:
    """How many of the sorted ``cuts`` a value reaches, by halving; nulls reach none."""
    if not cuts:
        return F.lit(base)
    middle = len(cuts) // 2
    return F.when(column >= F.lit(cuts[middle]), _rank(column, cuts[middle + 1 :], base + middle + 1)).otherwise(_rank(column, cuts[:middle], base))


def z_key(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """A number whose bits are those of the columns' ranges in turn, the highest first.

    Ranges hold about equally many rows each: they are cut at quantiles of a sample of bounded size, which decides on the order
    of rows and on nothing else.
    """
    sample = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(SAMPLE).collect()
    key = F.lit(0).cast("long")
    for j, c in enumerate(columns):
        values = sorted(r[j] for r in sample if r[j] is not None)
        picked = [values[len(values) * i // (1 << BITS)] for i in range(1, 1 << BITS)] if values else []
        cuts = [v for i, v in enumerate(picked) if bisect_left(picked, v) == i]
        rank = _rank(F.col(c), cuts).cast("long")
        for bit in range(BITS):
            one = F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(one, bit * len(columns) + len(columns) - 1 - j))
    return key


def along_curve(df: DataFrame, groups: tuple[str, ...], columns: tuple[str, ...], files: int) -> DataFrame:
    """Rows dealt into ``files`` ranges and sorted: by ``groups`` first, then along the curve through ``columns``."""
    if not columns:
        return df.repartitionByRange(files, *groups).sortWithinPartitions(*groups) if groups else df.repartition(files)
    keyed = df.withColumn("_z", z_key(df, columns))
    order = [*groups, "_z", *columns]
    return keyed.repartitionByRange(files, *groups, "_z").sortWithinPartitions(*order).drop("_z")
