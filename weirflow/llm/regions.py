"""Recursive Voronoi regions around pivots, for sets under the Jaccard distance, in one task.

Pivots are taken far from each other.  Every set goes to the region of its
nearest pivot p, and also to that of another pivot q where the triangle
inequality leaves room for a partner: with radius r, a set y can be within r of
a set whose nearest pivot is q only if d(y, q) <= d(y, p) + 2r and d(y, q) is
at most r more than the largest distance that a set of q's region has from q.
Sets within r of a pivot are linked to it; pivots have met everybody and leave;
regions are joined in the same way until they are small, have one component or
their pairs add up to too many, and then exactly.  Sets that are already in one component are
never compared.
"""

from __future__ import annotations

import numpy as np

SMALL = 24  #: regions of at most so many sets are joined exactly
PIVOTS = 12  #: of a region, at most
SHRUNK = 0.5  #: regions whose pairs add up to more than this share of the pairs before are not made: the sets are joined exactly
CELLS, DENSE = 8_000_000, 0.005  #: cells of a matrix made at a time; with less than this share filled there are no products
PRODUCTS = 4000  #: sets of a region that is joined by products, at most
EPS = 1e-9  #: above the rounding of distances


class Labels:
    """Union-find over set numbers; remembers the links that joined two components."""

    def __init__(self, n: int, given: np.ndarray | None = None) -> None:
        self.label = np.arange(n) if given is None else np.unique(given, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        """Link ``i`` with all of ``others``."""
        label = self.label
        kinds, first = np.unique(label[others], return_index=True)
        new = kinds != label[i]
        if new.any():
            self.links += [(i, j) for j in others[first[new]].tolist()]
            label[np.isin(label, kinds[new])] = label[i]


class Sets:
    """Sets of a region as numbers of the shingles that at least two of them have."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes = sizes
        _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = count[number] > 1
        self.flat = (np.cumsum(count > 1) - 1)[number[often]]
        self.width = int((count > 1).sum())
        self.left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[often], minlength=len(sizes))
        self.end = np.cumsum(self.left)
        self.mark = np.zeros(self.width + 1, dtype=bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.end[i] - self.left[i] : self.end[i]]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles set ``i`` shares with each of ``others``."""
        own = self.of(i)
        self.mark[own] = True
        sizes = self.left[others]
        ends = np.cumsum(sizes)
        at = np.repeat(self.end[others] - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate([[0], np.cumsum(self.mark[self.flat[at]])])
        self.mark[own] = False
        return sums[ends] - sums[ends - sizes]

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        both = self.shared(i, others)
        return 1 - both / (self.sizes[i] + self.sizes[others] - both)


def exact(sets: Sets, idx: np.ndarray, labels: Labels, percent: int) -> None:
    """Link all pairs of ``idx`` within the radius that are not in one component already."""
    entries = int(sets.left[idx].sum())
    if SMALL < len(idx) <= PRODUCTS and entries > DENSE * len(idx) * sets.width:
        return dense(sets, idx, labels, percent)
    # Small components first: their sets are compared with all others, those of the largest with none that is left.
    _, of, count = np.unique(labels.label[idx], return_inverse=True, return_counts=True)
    order = idx[np.argsort(count[of], kind="stable")]
    for k, i in enumerate(order.tolist()):
        rest = order[k + 1 :]
        rest = rest[labels.label[rest] != labels.label[i]]
        low, high = np.minimum(sets.sizes[rest], sets.sizes[i]), np.maximum(sets.sizes[rest], sets.sizes[i])
        rest = rest[low * 100 >= high * percent]
        if len(rest):
            labels.join(i, rest[linked(sets, i, rest, percent)])


def dense(sets: Sets, idx: np.ndarray, labels: Labels, percent: int) -> None:
    """As :func:`exact`, with intersections as products of a matrix of zeros and ones, some columns at a time."""
    step = max(1, CELLS // len(idx))
    own = np.concatenate([sets.of(i) for i in idx.tolist()])
    row = np.repeat(np.arange(len(idx)), sets.left[idx])
    both = np.zeros((len(idx), len(idx)), dtype=np.float32)  # whole numbers below 2 ** 24 are exact
    for lo in range(0, sets.width, step):
        some = (own >= lo) & (own < lo + step)
        columns, at = np.unique(own[some], return_inverse=True)
        grid = np.zeros((len(idx), len(columns)), dtype=np.float32)
        grid[row[some], at] = 1
        both += grid @ grid.T
    size = sets.sizes[idx].astype(np.float64)
    for k in range(len(idx) - 1):
        near = both[k, k + 1 :].astype(np.float64)
        others = idx[k + 1 :][near * 100 >= (size[k] + size[k + 1 :] - near) * percent]
        if len(others):
            labels.join(int(idx[k]), others)


def linked(sets: Sets, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` are within the radius of set ``i``, in whole numbers."""
    both = sets.shared(i, others)
    return both * 100 >= (sets.sizes[i] + sets.sizes[others] - both) * percent


def windows(d: np.ndarray, radius: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pivot (column of ``d``) the rows of its region: those nearest to it, and those that the inequality admits."""
    least, nearest = d.min(axis=1), d.argmin(axis=1)
    out = []
    for q in range(d.shape[1]):
        core = nearest == q
        reach = least[core].max(initial=-1.0)
        admitted = ~core & (d[:, q] <= least + 2 * radius + EPS) & (d[:, q] <= reach + radius + EPS)
        out.append((np.flatnonzero(core), np.flatnonzero(admitted)))
    return out


def join(sets: Sets, idx: np.ndarray, labels: Labels, percent: int, first: int | None = None) -> None:
    """Link what is within the radius among ``idx`` so that components come out right; ``first``: a pivot to begin with."""
    radius = 1 - percent / 100
    todo = [(idx, first)]
    while todo:
        idx, first = todo.pop()
        if len(np.unique(labels.label[idx])) < 2:
            continue
        if len(idx) <= SMALL:
            exact(sets, idx, labels, percent)
            continue
        pivots: list[int] = []
        columns: list[np.ndarray] = []
        least = np.full(len(idx), np.inf)
        at = int(np.flatnonzero(idx == first)[0]) if first is not None else int(np.argmax(sets.left[idx]))
        while len(pivots) < PIVOTS:
            pivots.append(at)
            columns.append(sets.distances(int(idx[at]), idx))
            labels.join(int(idx[at]), idx[linked(sets, int(idx[at]), idx, percent)])
            least = np.minimum(least, columns[-1])
            # The next pivot is the set farthest from all so far, as long as there is one outside their components.
            apart = ~np.isin(labels.label[idx], labels.label[idx[pivots]])
            if not apart.any():
                break
            at = int(np.flatnonzero(apart)[np.argmax(least[apart])])
        d = np.stack(columns, axis=1)
        parts = [np.setdiff1d(np.concatenate([core, admitted]), pivots) for core, admitted in windows(d, radius)]
        parts = [sub for sub in parts if len(np.unique(labels.label[idx[sub]])) > 1]
        if sum(len(sub) ** 2 for sub in parts) > SHRUNK * len(idx) ** 2:
            # Sets that are about equally far from each other: copies at the borders would outgrow what regions save.
            exact(sets, np.delete(idx, pivots), labels, percent)
        else:
            todo += [(idx[sub], None) for sub in parts]
