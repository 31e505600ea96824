"""What the vector operators share: which vectors count, and matrices from Arrow."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vec_col: str) -> Column:
    """Not null, not empty, and only finite components."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as float64; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of no chunks
        column = pa.array([], column.type)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), int(sizes.max(initial=1))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, exact for every finite double; ``scale`` is a power of two."""
    out = np.empty(x.shape, dtype=object)
    out.ravel()[:] = [math.floor(t * scale) if abs(t) < 1e300 else int(t) * scale for t in x.ravel().tolist()]
    return out


def exact_products(q: np.ndarray, c: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of rows of floor(scale * x), computed in Python integers; beyond 64 bits: their ends."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), dtype=np.int64)
    return np.clip(whole_numbers(q, scale) @ whole_numbers(c, scale).T, -(2**63), 2**63 - 1).astype(np.int64)


def widened(a: np.ndarray, width: int) -> np.ndarray:
    """With columns of zeros up to ``width``."""
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


class Slices:
    """Slices of rows in the order of a number, of about so many rows each.

    Made from counts in equal bins (at most ``BINS``, whatever the number of rows): neighbouring bins share a slice, and a
    bin with more rows is several slices, told apart by a hash.
    """

    BINS = 4096

    def __init__(self, low: float, high: float, counts: dict[int, int], rows: int) -> None:
        self.low, self.step = low, max((high - low) / self.BINS, 1e-300)
        first, many, edges = np.zeros(self.BINS, np.int64), np.ones(self.BINS, np.int64), []
        held = rows + 1
        for b in range(self.BINS):
            n = counts.get(b, 0)
            pieces = -(-n // rows)
            if pieces > 1 or held + n > rows or not edges:
                first[b], many[b], held = len(edges), max(pieces, 1), n
                edges += [[b, b] for _ in range(int(many[b]))]
            else:
                first[b], held = len(edges) - 1, held + n
                edges[-1][1] = b
            if many[b] > 1:
                held = rows + 1
        self.first, self.many = first, many
        spans = np.array(edges, dtype=np.float64)
        slack = 1e-9 * (abs(low) + abs(high))  # numbers are cut into bins with rounding errors
        self.least, self.most = low + spans[:, 0] * self.step - self.step - slack, low + spans[:, 1] * self.step + 2 * self.step + slack

    @staticmethod
    def bin_of(number: Column, low: float, high: float) -> Column:
        """The bin of a number, as :meth:`of` has it."""
        step = max((high - low) / Slices.BINS, 1e-300)
        return F.least(F.greatest(F.floor((number - F.lit(low)) / F.lit(step)), F.lit(0)), F.lit(Slices.BINS - 1))

    def of(self, bins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slice of rows in bins, by a hash of each row."""
        return self.first[bins] + hashes % self.many[bins]

    def __len__(self) -> int:
        return len(self.least)
