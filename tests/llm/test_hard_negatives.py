import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<double>, label int, id string, v string, cell int"


def brute(rows, anchors, k=5, least=80):
    """Mining by Python integers and sorting; rows: (id, vector, label), anchors: ids."""
    exact = lambda v: [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]
    fine = {(i, tuple(v), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    fine = sorted(((i, exact(v), y, v) for i, v, y in fine), key=lambda r: r[0])
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    score = lambda a, b: clip(sum(x * y for x, y in zip(a, b)))
    out = set()
    for a in anchors:
        mine = sorted((y, v, e) for i, e, y, v in fine if i == a)
        if not mine:
            continue
        label, _, e = mine[0]
        others = sorted((-score(e, c), i, y) for i, c, y, _ in fine if i != a)
        for p, pos, _ in [x for x in others if x[2] == label][:k]:
            window = [x for x in others if x[2] != label and least * -p <= 100 * -x[0] <= 100 * -p][:k]
            out |= {(a, pos, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(window)}
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "clash", "clash", 7) for i, v, y in rows], ROWS).repartition(parts)


def mined(spark, rows, every=5, **kw):
    got = [tuple(r) for r in hn.mine(frame(spark, rows), F.col("vec_id") % every == 0, F.col("label"), **kw).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def clustered(rng, n, width=6, labels=3):
    centres = rng.normal(size=(5, width))
    v = centres[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, width))
    return [(i, v[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.fixture
def small_cells(monkeypatch):
    for name, value in (("CELL_ROWS", 40), ("CELL_QUERIES", 16), ("SAMPLE", 100), ("LEAF", 4)):
        monkeypatch.setattr(hn, name, value)


def test_trees_keep_all_rows_and_their_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 5)), np.zeros((80, 5))])
    tree, leaves = hn.Tree.fit(x, 4)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(x)))
    cell, seen = tree.route(x)
    q = rng.normal(size=(20, 5)) * 2
    cells = np.unique(cell)
    low, high = (np.array([f(seen[cell == c], axis=0) for c in cells]) for f in (np.min, np.max))
    least, most = tree.reach(q, cells, low, high)
    true = hn.distances(q, x)
    for j, c in enumerate(cells):
        assert (true[:, cell == c].min(axis=1) >= least[:, j] - 1e-9).all() and (true[:, cell == c].max(axis=1) <= most[:, j] + 1e-9).all()


def test_far_leaves_are_not_opened(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(32, 8)) * 4
    c = np.repeat(centres, 128, axis=0) + 0.01 * rng.normal(size=(4096, 8))
    q = hn.Queries(np.arange(8) + 10_000, np.zeros(8, np.int64), centres[:8], np.arange(8), np.full(8, -(2**62)), np.full(8, 2**62), True)
    seen = []
    real = hn.accepted
    monkeypatch.setattr(hn, "accepted", lambda q, which, ids, *a: seen.append(len(which) * len(ids)) or real(q, which, ids, *a))
    hn.search_cell(q, np.arange(4096), np.zeros(4096, np.int64), c, 5)
    assert sum(seen) < 8 * 4096 / 2


def test_mining_equals_the_plain_search(spark, small_cells):
    rows = clustered(np.random.default_rng(3), 400)
    want = brute(rows, range(0, 400, 5))
    assert len(want) > 200
    assert mined(spark, rows) == want


def test_ties_copies_and_a_hot_vector(spark, small_cells):
    rng = np.random.default_rng(4)
    # A third of all rows hold one vector, under two labels; the rest come on a coarse grid, full of ties.
    rows = [(i, [1.0, 0.5, 0.0], int(i % 2)) for i in range(120)] + [(i, (rng.integers(-2, 3, 3) / 2).tolist(), int(rng.integers(0, 2))) for i in range(120, 360)]
    assert mined(spark, rows + rows[:50]) == brute(rows, range(0, 360, 5))


def test_odd_rows(spark, small_cells):
    rng = random.Random(5)
    rows = clustered(np.random.default_rng(6), 60, 3, 2)
    rows += [(100, None, 1), (105, [], 0), (110, [1.0, None, 0.0], 1), (115, [1.0, float("nan"), 0.0], 1), (120, [float("inf"), 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (125, [1.0, 0.0, 0.0], None)]
    rows += [(130, [-0.0, 0.0, 0.0], 1), (135, [0.0] * 3, 0), (140, [1.0], 1), (145, [-1.0, -1.0, -1.0], 0), (0, [0.5, 0.5, 0.5], 1)]
    # Large finite components: products beyond 2^53, beyond 64 bits, and beyond the largest double.
    rows += [(150, [3e5, 1.0, -2e4], 0), (151, [1e307, 0.0, 0.0], 0), (152, [1e9, 1e9, 1.0], 1), (153, [-1e307, 2.0, 0.0], 1), (155, [1e-200, 0.0, 1e-300], 1)]
    rng.shuffle(rows)
    got = [tuple(r) for r in hn.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, F.col("label")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert set(got) == brute(rows, {r[0] for r in rows if r[0] is not None and r[0] % 5 == 0})
    # Two rows of one id and label are two positives, also where their scores are equal.
    assert {r[:2] for r in got if got.count(r) > 1} <= {(130, 0), (135, 0), (155, 0)}


def test_tables_without_rows_anchors_or_positives(spark):
    rows = clustered(np.random.default_rng(7), 20, 3, 2)
    assert mined(spark, []) == set()
    assert mined(spark, [r for r in rows if r[0] % 5]) == set()
    assert mined(spark, [(i, v, i) for i, v, _ in rows]) == set()
    assert mined(spark, [(i, v, 0) for i, v, _ in rows]) == set()


def test_other_windows_and_numbers(spark, small_cells):
    rows = clustered(np.random.default_rng(8), 150, 4, 2)
    assert mined(spark, rows, positives=2, negatives=2, low=50) == brute(rows, range(0, 150, 5), 2, 50)
