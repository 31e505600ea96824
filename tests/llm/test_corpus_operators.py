import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import jaccard, near_vectors, regions, top_k, toxicity
from weirflow.llm.vectors import Slices
from weirflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, s long, region string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "clash") for i, t in texts], DOCS)


def union(links, nodes):
    name = {n: n for n in nodes}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        name[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 230)]
    want = {n: c for n, c in union(edges, {n for e in edges for n in e}).items() if n != c}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- Jaccard -------------------------------------------------------------------


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def brute_jaccard(texts, words, percent):
    sets = {i: shingle_set(t, words) for i, t in texts}
    found = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in union(found, sets).items()}


def near_copies(rng, n, common):
    """Families of near copies at graded distances, a passage that all share, and short texts."""
    out = []
    for family in range(6):
        base = [f"w{family}x{rng.randint(0, 10**6)}" for _ in range(rng.choice([5, 40, 90]))]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"z{rng.randint(0, 10**6)}"
            out.append(" ".join((common if rng.random() < 0.5 else []) + words))
    out += ["A b  c", "a B c", "a b c d", "", None, " ", "É é", "é É"]
    out += [" ".join(common + [f"q{i}", f"r{i}"]) for i in range(25)]
    return list(enumerate(out))


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, words, percent):
    texts = near_copies(random.Random(words), 12, [f"common{i}" for i in range(30)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts), words, percent).collect()}
    assert got == brute_jaccard(texts, words, percent)


def test_jaccard_splits_cells_that_are_too_large(spark, monkeypatch):
    """Cells of a few sets go through whole jobs: pivots, regions, blocks."""
    monkeypatch.setattr(jaccard, "TASK", 900)
    texts = near_copies(random.Random(9), 24, [f"common{i}" for i in range(30)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts), 4, 85).collect()}
    assert got == brute_jaccard(texts, 4, 85)


def test_jaccard_group_of_many_near_copies(spark):
    """A star: thousands of copies with changes of their own, so that many are within the radius of few."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(70)]
    texts = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(70)] = f"m{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts), 4, 85).collect()}
    assert got == brute_jaccard(texts, 4, 85)


def test_linked_sets_share_a_key():
    """Whatever their sizes, with keys of empty parts where a set has more of them than its class allows."""
    rng = np.random.default_rng(1)
    for percent in (50, 80, 85, 95):
        classes = jaccard.Classes(percent)
        for n in (1, 2, 3, 5, 6, 7, 9, 12, 20, 33, 61, 100, 700):
            for _ in range(12):
                width = 2**64 if rng.random() < 0.7 else 2**60  # bunched hashes leave parts empty
                a = np.unique(rng.integers(0, width, n, dtype=np.uint64))
                drop, add = rng.integers(0, n // 4 + 1, 2)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, width, add, dtype=np.uint64)]))
                both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if not both or both * 100 < percent * either or len(a) == len(b) == both:
                    continue
                key, who, need = jaccard.keys_of(np.concatenate([a, b]), np.array([len(a), len(b)]), classes)
                same = np.intersect1d(key[who == 0], key[who == 1])
                # In one class there are as many as either set needs there.
                fine = [all((same & 1 == kind).sum() >= need[(who == i) & (key & 1 == kind)].max(initial=0) for i in (0, 1)) for kind in (0, 1) if (same & 1 == kind).any()]
                assert any(fine), (percent, n)


def test_regions_equal_all_pairs():
    rng = np.random.default_rng(5)
    for trial in range(20):
        sets, families = [], [rng.integers(0, 2**63, 60) for _ in range(3)]
        for _ in range(90):
            base = families[rng.integers(0, 3)]
            sets.append(np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 2**63, 60), base)))
        sizes = np.array([len(s) for s in sets])
        labels = regions.Labels(len(sets))
        regions.join(regions.Sets(np.concatenate(sets), sizes), np.arange(len(sets)), labels, 80)
        found = [(i, j) for i in range(90) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        want = union(found, range(90))
        assert {tuple(sorted(np.flatnonzero(labels.label == k))) for k in labels.label} == {tuple(sorted(i for i in want if want[i] == c)) for c in want.values()}, trial


def test_jaccard_takes_very_long_texts_whole(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 400)}" for _ in range(120_000)]
    other = [*words[:-12_000], *(f"x{rng.randint(0, 400)}" for _ in range(12_000))]
    texts = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:60_000])), (4, "x" * 300_000), (5, "x" * 300_000 + " y")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts), 4, 85).collect()}
    assert got == brute_jaccard(texts, 4, 85)


def test_jaccard_edges(spark):
    assert jaccard.near_duplicates(docs(spark, []).limit(0)).count() == 0
    rows = jaccard.near_duplicates(docs(spark, [(2, "a b c d e"), (2, "a b c d e"), (1, "A B C D E"), (None, None)])).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(2, 2, 1), (2, 2, 1), (1, 2, 1), (None, 0, None)], key=str)


# -- vectors -------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, id long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 9) for i, v in rows], VEC)


def sample_vectors(rng, n=260, dim=12):
    base = rng.normal(size=(n // 4, dim))
    rows = [base[i % len(base)] + rng.normal(scale=rng.choice([0.0, 0.02, 0.08, 1.0]), size=dim) for i in range(n)]
    out = [(i, np.float32(r).tolist()) for i, r in enumerate(rows)]
    return out + [(900, None), (950, [float("nan")] * dim), (1000, [None] * dim), (1050, [0.0] * dim), (1051, [float("inf")] * dim), (1052, (2 * np.float32(rows[3])).tolist())]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "HEAD", 20)
    monkeypatch.setattr(top_k, "BLOCK", 8)
    rows = sample_vectors(np.random.default_rng(2))
    good = {i: np.floor(256 * np.float64(np.float32(v))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]
        want |= {(q, r + 1): (c, -s) for r, (s, c) in enumerate(scores)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()}
    assert got == want


def test_slices_hold_their_numbers():
    rng = np.random.default_rng(6)
    for numbers in (rng.normal(size=3000), np.zeros(500), np.concatenate([np.full(900, 0.25), rng.random(300)]), np.array([-7.5])):
        low, high = float(numbers.min()), float(numbers.max())
        bins = np.clip(np.floor((numbers - low) / max((high - low) / Slices.BINS, 1e-300)), 0, Slices.BINS - 1).astype(np.int64)
        cut = Slices(low, high, dict(zip(*(x.tolist() for x in np.unique(bins, return_counts=True)), strict=True)), 100)
        at = cut.of(bins, rng.integers(0, 1 << 31, len(bins)))
        assert (cut.least[at] <= numbers).all() and (numbers <= cut.most[at]).all()
        assert (np.diff(cut.least) >= 0).all() and (np.diff(cut.most) >= 0).all() and np.bincount(at).max() <= 200


def test_top_k_of_many_lengths_makes_few_cells(spark, monkeypatch):
    """Lengths far apart: short candidates and the blocks of queries that cannot need them never meet."""
    monkeypatch.setattr(top_k, "HEAD", 16)
    monkeypatch.setattr(top_k, "CELL_ROWS", 20)
    rng = np.random.default_rng(7)
    v = np.abs(rng.normal(size=(600, 6))) * np.exp(rng.normal(0, 2, size=(600, 1)))
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(v)]
    good = {i: np.floor(256 * np.float64(np.float32(x))) for i, x in rows}
    monkeypatch.setattr(top_k, "CELL_QUERIES", 4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()}
    want = {}
    for q in range(0, 600, 50):
        for r, (s, c) in enumerate(sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]):
            want[q, r + 1] = (c, -s)
    assert got == want


def test_top_k_edges(spark):
    ask = F.col("vec_id") % 50 == 0
    assert top_k.search(vectors(spark, []).limit(0), ask).count() == 0
    got = top_k.search(vectors(spark, [(0, [1, 2]), (7, [1, 2]), (3, [1, 2]), (5, [3]), (None, [9, 9])]), ask).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 3, 5 * 65536), (2, 7, 5 * 65536), (3, 5, 3 * 65536)]
    huge = top_k.products(np.array([[2.0**40]]), np.array([[2.0**40]]))
    assert huge.tolist() == [[2**63 - 1]]


@pytest.mark.parametrize("rows_a_slice", [8192, 10])
def test_near_vectors_equal_brute_force(spark, monkeypatch, rows_a_slice):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    monkeypatch.setattr(near_vectors, "SLICE_ROWS", rows_a_slice)
    rows = sample_vectors(np.random.default_rng(3)) + [(2000 + i, [1.0] * 12) for i in range(9)]
    good = {i: np.float64(np.float32(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))
    found = [(a, b) for a in good for b in good if a < b and cos(good[a], good[b]) >= 0.95]
    names = union(found, [i for i, _ in rows])
    count = defaultdict(int)
    for a, b in found:
        count[a] += 1
        count[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(vectors(spark, rows)).collect()}
    assert got == {i: (count[i], names[i], names[i] == i) for i, _ in rows}
    assert near_vectors.near_duplicates(vectors(spark, []).limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 16)) * rng.choice([1e-3, 1, 1e3], size=(200, 16))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    q, s, stood, missed = near_vectors.quantised(v)
    error = np.abs(v @ v.T - np.outer(s, s) * (q.astype(float) @ q.T.astype(float)))
    assert (error <= np.outer(stood, missed) + np.outer(missed, stood + missed) + 1e-12).all()


# -- toxicity ------------------------------------------------------------------


def test_gradients_are_right():
    rng = np.random.default_rng(5)
    par = {"att": rng.normal(size=16), "out": rng.normal(size=16), "bias": np.zeros(1)}
    for d in (0, 1):
        par |= {f"w{d}": rng.normal(0, 0.5, (4, 24)), f"u{d}": rng.normal(0, 0.5, (8, 24)), f"b{d}": rng.normal(0, 0.1, 24)}
    par = {k: v.astype(np.float32) for k, v in par.items()}
    x, ids = rng.normal(size=(6, 4)).astype(np.float32), rng.integers(0, 6, (5, 7)).astype(np.int32)
    x[0] = 0
    y, w = np.array([1, 0, 1, 0, 0], np.float32), np.ones(5, np.float32)
    _, grad = toxicity.backward(par, x, ids, y, w)
    for name in par:
        at = tuple(rng.integers(0, s) for s in par[name].shape)
        losses = []
        for step in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in par.items()}
            moved[name][at] += step
            losses.append(toxicity.backward(moved, x, ids, y, w)[0])
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grad[name][at], rel=0.05, abs=2e-3), name


def test_toxicity_gradients_of_the_tables():
    """Word rows and trigram rows move the loss as their gradients say."""
    rng = np.random.default_rng(2)
    words = ["idiot", "idiots", "fine", "a", "unseen"]
    model = toxicity.Model({"idiot": 0, "fine": 1}, rng.normal(size=(2, 6)).astype(np.float32), rng.normal(size=(toxicity.TRIGRAMS, 6)).astype(np.float32), {})
    size = 12
    for d in (0, 1):
        model.par |= {f"w{d}": rng.normal(0, 0.3, (size, 24)), f"u{d}": rng.normal(0, 0.3, (8, 24)), f"b{d}": np.zeros(24)}
    model.par |= {"att": rng.normal(size=16), "out": rng.normal(size=16), "bias": np.zeros(1)}
    model.par = {k: v.astype(np.float32) for k, v in model.par.items()}
    inputs, ids = toxicity.Inputs(model, words), rng.integers(0, 6, (4, 9)).astype(np.int32)
    y, w, numbers = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32), np.arange(6)
    loss = lambda: toxicity.backward(model.par, inputs.vectors(numbers), ids, y, w)
    tables = inputs.gradients(numbers, loss()[1]["x"])
    for table, (rows, grad) in zip((model.word, model.trigram), tables, strict=True):
        assert len(rows)
        for k in rng.integers(0, len(rows), 6):
            at, column, found = rows[k], int(rng.integers(0, 6)), []
            for step in (1e-2, -2e-2):
                table[at, column] += step
                found.append(loss()[0])
            table[at, column] += 1e-2
            assert (found[0] - found[1]) / 2e-2 == pytest.approx(grad[k, column], rel=0.05, abs=2e-3)


def test_toxicity_scores_equal_a_plain_loop():
    """Every window of every text, one word after the other."""
    model = toxicity.fit([(f"fine words number {i} here {'ja ' * (i % 70)}", 0) for i in range(40)] + [(f"such an idiot number {i}", 1) for i in range(40)])
    sig = lambda v: 1 / (1 + np.exp(-v))
    rng = random.Random(1)
    for n in (0, 1, 39, 41, 75, 130):
        words = [rng.choice(["fine", "idiot!", "words", "other", "Ébène", "x"]) for _ in range(n)]
        best = -np.inf
        for at in toxicity.windows_of(n):
            own = [w.lower() for w in words[at : at + toxicity.WINDOW]]
            x = [model.inputs([w])[1] for w in own] + [model.inputs([])[0]] * (toxicity.WINDOW - len(own))
            states = []
            for d in (0, 1):
                h, out = np.zeros(toxicity.HIDDEN), []
                for v in x if d == 0 else x[::-1]:
                    g, hu = v @ model.par[f"w{d}"] + model.par[f"b{d}"], h @ model.par[f"u{d}"]
                    z, r = sig(g[:8] + hu[:8]), sig(g[8:16] + hu[8:16])
                    h = (1 - z) * np.tanh(g[16:] + r * hu[16:]) + z * h
                    out.append(h)
                states.append(out if d == 0 else out[::-1])
            both = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)[: len(own) or None]
            a = np.exp(both @ model.par["att"])
            best = max(best, float((a / a.sum()) @ both @ model.par["out"] + model.par["bias"][0]))
        want = 1 / (1 + np.exp(-(model.slope * best + model.shift)))
        got, windows = toxicity.score_texts(model, [" ".join(words)])
        assert got[0] == pytest.approx(want, rel=1e-3, abs=1e-4) and windows[0] == len(toxicity.windows_of(n))


def test_windows_cover_every_word():
    for n in (0, 1, 39, 40, 41, 60, 61, 400):
        starts = toxicity.windows_of(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n and (np.diff(starts) == toxicity.STRIDE).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(frame, labels)
    scored = toxicity.score(frame, model).join(labels, "doc_id").where(toxicity.held_out()).select("_score", "toxic").toPandas()
    pos, neg = scored._score[scored.toxic == 1].to_numpy(), scored._score[scored.toxic == 0].to_numpy()
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] >= neg).mean()) / 2
    assert auc >= 0.85 and (neg < toxicity.THRESHOLD).mean() >= 0.97


def test_toxicity_edges(spark):
    frame = docs(spark, [(0, None), (1, ""), (2, "you idiot " * 300), (None, "x")])
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(0)], "doc_id long, toxic int")
    got = toxicity.score(frame, toxicity.train(frame, labels)).collect()
    assert {r._score for r in got} == {0.5} and len(got) == 4
    model = toxicity.fit([(f"fine words number {i} here", 0) for i in range(40)] + [(f"such an idiot number {i}", 1) for i in range(40)])
    clashing = frame.selectExpr("doc_id AS `doc.id`", "text", "1 AS _score", "'x' AS _windows", "doc_id AS doc")
    kept = toxicity.below(clashing, model)
    assert kept.columns == clashing.columns and sorted((r["doc.id"], r._score, r._windows) for r in kept.where("doc IS NOT NULL").collect()) == [(0, 1, "x"), (1, 1, "x")]
    score = {r.doc_id: r._score for r in toxicity.score(frame, model).collect()}
    assert score[0] == score[1] < 0.7 <= score[2]
    long = "fine words here " * 60_000
    found = {r.doc_id: (r._score, r._windows) for r in toxicity.score(docs(spark, [(1, long), (2, long + "such an idiot"), (2, long)]), model).collect() if r.doc_id == 1}
    assert found[1][0] < 0.7 and found[1][1] == len(toxicity.windows_of(180_000))
    assert toxicity.score(frame.limit(0), model).count() == 0
