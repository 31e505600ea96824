import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from weirflow.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, n long, term string, part string"
PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least, top):
    """The rows of the audit, by dictionaries and loops; rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    spread, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        found = terms(text)
        counts[lang, source].update(found)
        spread[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in spread[lang].items() if n >= least}
        per = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(per[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(per[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            more = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if per[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(more)}
    return out


def corpus(rng, n):
    words = ["the", "The", "Straße", "naïve", "x1y", "don't", "日本", "a", "B", "zzz", "q" * 70, "É", "é", "foo_bar", "under-score"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "s1", "s2", None, "ü"])
        k = rng.randint(0, 12)
        rows.append((None if rng.random() < 0.05 else " ".join(rng.choice(words[: 6 + len(source or "") * 4]) for _ in range(k)), lang, source))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, s, 9, "clash", "clash") for i, (t, lang, s) in enumerate(rows)], DOCS).repartition(parts)


def result(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_slices_are_the_matches_of_the_pattern():
    rng = random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choice(["a", "Z", "é", "日", " ", "1", "_", "@", "[", "`", "{", "\x7f", "\0", "ab", "\x80"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        data, bounds = dv.text_bytes(pa.array(texts))
        begin, end = dv.slices(data, bounds)
        raw = data.tobytes()
        assert [raw[a:b].decode() for a, b in zip(begin, end)] == [m for t in texts for m in PATTERN.findall(t)]


def test_terms_that_share_a_hash_stay_apart():
    words = ["a", "b", "ab", "ba", "long" * 20, "long" * 19 + "lonk", "x" * 500, "x" * 499 + "y", "aaaaaaaa", "aaaaaaab", "a"]
    data, bounds = dv.text_bytes(pa.array([" ".join(words)]))
    begin, end = dv.slices(data, bounds)
    seeds = []

    def weak(raw, seed):
        seeds.append(seed)
        return len(raw) % 3 if seed < 2 else xxhash.xxh3_64_intdigest(raw, seed)

    which, first = dv.grouped(data, begin, end, weak)
    assert max(seeds) == 2 and len(first) == len(set(words))
    assert [[i for i, w in enumerate(words) if w == v] for v in sorted(set(words))] == [np.flatnonzero(which == which[words.index(v)]).tolist() for v in sorted(set(words))]


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(2000):
        total = rng.randint(5, 9 * 10**15)
        n = rng.randint(0, max(0, total - 5))
        assert dv.parts(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 5) // total


def test_audit_equals_the_plain_count(spark):
    rows = corpus(random.Random(4), 400)
    want = brute(rows, 8, 4)
    assert {r[2] for r in want} == {"pair", "term"}
    assert result(dv.audit(frame(spark, rows), 8, 4)) == want


def test_blocks_tiles_and_shuffled_totals_change_nothing(spark, monkeypatch):
    rows = corpus(random.Random(5), 300)
    want = brute(rows, 3, 50)
    for name, value in (("LEAST_BLOCK", 4), ("MOST_BLOCK", 4), ("TILE", 2), ("MOST_BROADCAST", 0), ("GROUP", 100)):
        monkeypatch.setattr(dv, name, value)
    assert result(dv.audit(frame(spark, rows), 3, 50)) == want


def test_odd_tables(spark):
    # No kept term at all, one source alone, nulls, repeated rows and ids, a very long text, an empty table.
    rows = [("rare", "en", "a"), (None, "en", "b"), ("", "en", None), ("alone " * 50_000, "fr", "only"), ("alone", "fr", "only"), ("alone", "fr", "only")]
    assert result(dv.audit(frame(spark, rows, 1), 3, 50)) == brute(rows, 3, 50)
    assert result(dv.audit(frame(spark, rows, 1), 30, 50)) == brute(rows, 30, 50)
    assert result(dv.audit(frame(spark, rows).limit(0))) == set()
