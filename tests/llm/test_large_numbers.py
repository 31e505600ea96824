"""Vectors with very large and very small components, and addresses that look like version blocks."""

import math

import numpy as np
from pyspark.sql import functions as F

from weirflow.llm import near_vectors, top_k, vectors, warc

ROWS = "vec_id long, embedding array<double>"


def exact(v):
    return [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]


def test_whole_numbers_and_their_products_are_exact():
    x = np.array([[1e307, -0.3, 1.7e308], [2.0**60, 1.0, 0.1], [-1e-300, 0.0, 5.0]])
    assert vectors.whole_numbers(x, 256).tolist() == [exact(r) for r in x.tolist()]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = [[clip(sum(a * b for a, b in zip(exact(q), exact(c)))) for c in x.tolist()] for q in x.tolist()]
    assert vectors.exact_products(x, x, 256).tolist() == want


def test_top_k_with_components_of_every_size(spark, monkeypatch):
    monkeypatch.setattr(top_k, "CELL_ROWS", 8)
    monkeypatch.setattr(top_k, "HEAD", 6)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(100, [1e307, 0.0, 0.0]), (101, [-1e307, 1.0, 0.0]), (102, [1e9, -1e9, 3.0]), (103, [5e4, 1.0]), (104, [1e-200, 0.0, 1e-300]), (150, [2e5, 2e5, -1e5]), (107, [0.0, 1.0, 1e307])]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k.search(df, F.col("vec_id") % 25 == 0).collect()}
    want, full = {}, {i: exact([*v, 0.0][:3]) for i, v in rows}
    for q in (i for i in full if i % 25 == 0):
        score = {c: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(full[q], full[c])))) for c in full if c != q}
        want |= {(q, r + 1): (c, score[c]) for r, c in enumerate(sorted(score, key=lambda c: (-score[c], c))[:5])}
    assert got == want
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e307, 0.0])], ROWS)
    assert [tuple(r) for r in top_k.search(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2**63 - 1)]


def test_near_vectors_of_every_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.1e200, 1e200]), (3, [3e-200, 3e-200]), (4, [-1e307, 1e307]), (5, [-1e-300, 1e-300]), (6, [0.0, 0.0]), (7, [1e-320, 1e-320]), (8, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 7: (3, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 8: (0, 8)}


def test_addresses_that_look_like_version_blocks(spark, tmp_path):
    rows = [(1, "filedesc://x.arc", "<p>not a version</p>"), (2, "filedesc://", "1 0 me\nURL IP-address"), (3, "http://a", "plain"), (4, "filedesc://x.arc", None)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.pages_to_records(spark.createDataFrame(rows, "page_id long, url string, html string")), path)
    got = sorted((r.url, bytes(r.payload).decode()) for r in warc.read_archives(spark, path).collect())
    assert got == sorted((u, h or "") for _, u, h in rows)
