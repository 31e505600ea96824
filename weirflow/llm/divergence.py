"""How far the sources of a language differ in their words, and by which.

Texts are cut at byte level: one look-up per byte of a batch's UTF-8 buffers tells
letters (A-Z, a-z and every byte of a character beyond ASCII) from the rest, and
a term begins where that changes.  A 64-bit xxhash groups the slices, and every
slice is compared with its group's first, byte by byte; if two different ones
have met, the batch is hashed again under another seed.  What leaves a batch is a
row per group of documents and term.

Kept terms of a language are dealt into blocks by a hash.  A block is a sparse
matrix (sources by terms, rows compressed); for each source the absolute
differences to all others are sums over runs of the other rows (``reduceat``)
plus what absent terms add, which follows from counts.  All numbers are whole:
shares are parts per billion, rounded down.

Defined results: null text, lang and source count as ''; texts without terms
still make their group; a row is a document, so repeated rows and ids count as
often as they come; very long texts are taken whole; ties rank by the item's
UTF-8 bytes; a language without kept terms has pairs of value 0; an empty table
gives an empty table; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.interned import gathered
from weirflow.llm.pretokens import text_bytes
from weirflow.llm.workspace import Scratch

LEAST_DOCUMENTS = 30  #: documents of its language that a kept term is in
BILLION, SMOOTHING = 1_000_000_000, 5
TOP_TERMS = 50
GROUP = 1 << 24  #: bytes of text counted at a time, but for longer texts
LEAST_BLOCK, MOST_BLOCK = 1 << 15, 1 << 20  #: entries of a block: as many as it makes pairs, between these
TILE = 512  #: sources of a block that one task compares with all others
MOST_BROADCAST = 50_000  #: groups up to which their totals are broadcast; beyond, they are joined by shuffle

#: Which bytes are letters, and every byte with A-Z lower-cased.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


# -- terms ---------------------------------------------------------------------


def slices(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of texts begin and end in their bytes; ``bounds``: where texts begin, with the end."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = LETTER[data]
    edge = inside[1:] != inside[:-1]
    begin, end = edge & inside[1:], edge & inside[:-1]
    # Texts that touch end one term and begin another.
    meet = bounds[1:-1][inside[bounds[1:-1]] & inside[bounds[1:-1] + 1]]
    begin[meet] = end[meet] = True
    return np.flatnonzero(begin), np.flatnonzero(end)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether data[a:a + size] and data[b:b + size] are equal for all."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    at = 0
    while len(a):
        more = size - at
        mask = np.where(more >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.clip(more, 0, 7)).astype(np.uint64)) - np.uint64(1))
        if ((words[a + at] ^ words[b + at]) & mask).any():
            return False
        left = more > 8
        a, b, size, at = a[left], b[left], size[left], at + 8
        if at >= 64 and len(a):
            raw = data.tobytes()
            return all(raw[x:y] == raw[z : z + y - x] for x, y, z in zip((a + at).tolist(), (a + size).tolist(), (b + at).tolist(), strict=True))
    return True


def grouped(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's term, and for each number its first slice."""
    raw, size, seed = data.tobytes(), end - begin, 0
    while True:
        hashes = np.fromiter((hashed(raw[a:b], seed) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(begin))
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        rep = first[which]
        other = np.flatnonzero(rep != np.arange(len(rep)))
        if (size[other] == size[rep[other]]).all() and same_bytes(data, begin[other], begin[rep[other]], size[other]):
            return which, first
        seed += 1


def counted(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents), a row per group and term, for every GROUP bytes of texts; ``group``: each text's."""
    data, bounds = text_bytes(texts)
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + GROUP, side="right")) - 1)
        part, cut = LOWER[data[bounds[lo] : bounds[hi]]], bounds[lo : hi + 1] - bounds[lo]
        begin, end = slices(part, cut)
        if len(begin):
            term, first = grouped(part, begin, end)
            doc = np.searchsorted(cut, begin, side="right") - 1
            both, n = np.unique(doc * len(first) + term, return_counts=True)
            key, which = np.unique(group[lo + both // len(first)] * len(first) + both % len(first), return_inverse=True)
            flat, sizes = gathered(part, begin[first], (end - begin)[first])
            names = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(flat)])
            yield key // len(first), names.take(pa.array(key % len(first))), np.bincount(which, n, len(key)).astype(np.int64), np.bincount(which, minlength=len(key))
        lo = hi


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of a table with lang, source and text, none of them null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "documents"]
        for batch in batches:
            lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
            own = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            for group, term, n, documents in counted(batch.column(2), own):
                to = [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary)))]
                yield pa.RecordBatch.from_arrays([*to, term.cast(pa.string()), pa.array(n), pa.array(documents.astype(np.int64))], names=names)

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


# -- divergences ---------------------------------------------------------------


def parts(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 5) / total), by long division in three steps, exact up to totals of 9 * 10^15."""
    rest, out = n + SMOOTHING, np.zeros(len(n), dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def differences(indptr: np.ndarray, terms: np.ndarray, p: np.ndarray, absent: np.ndarray, width: int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sums): for each of ``rows`` the sum over all ``width`` terms of |p of it - p of the other|, for every row of the matrix.

    ``indptr``, ``terms``, ``p``: rows of present terms; ``absent``: each row's p of terms that it does not have.
    """
    filled = np.flatnonzero(indptr[1:] > indptr[:-1])
    owner = np.repeat(np.arange(len(absent)), np.diff(indptr))
    for g in rows.tolist():
        own = slice(int(indptr[g]), int(indptr[g + 1]))
        dense = np.full(width, absent[g], dtype=np.int64)
        dense[terms[own]] = p[own]
        # Against all terms as if the other row had none of them, by sums over the sorted shares ...
        ordered = np.sort(p[own])
        below = np.concatenate([[0], np.cumsum(ordered)])
        k = np.searchsorted(ordered, absent)
        out = absent * k - below[k] + (below[-1] - below[k]) - absent * (len(ordered) - k) + (width - len(ordered)) * np.abs(absent - absent[g])
        # ... and corrected for those that it has.
        if len(filled):
            there = dense[terms]
            out[filled] += np.add.reduceat(np.abs(p - there) - np.abs(absent[owner] - there), indptr[:-1][filled])
        yield g, out


def block_pairs(table: pa.Table) -> pa.Table:
    """(lang, source, item, value) of one block: the part of each pair's divergence that the block's terms make."""
    term = table.column("term").combine_chunks()
    source = table.column("source").combine_chunks()
    names = sorted({s.encode() for s in source.to_pylist()})
    code = {s.decode(): i for i, s in enumerate(names)}
    row = np.array([code[s] for s in source.dictionary_encode().dictionary.to_pylist()], dtype=np.int64)[source.dictionary_encode().indices.to_numpy()]
    total, n = table.column("total").to_numpy(), table.column("n").to_numpy()
    head = np.asarray(term.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    mine = np.zeros(len(names), dtype=bool)
    mine[row[head & (table.column("own").to_numpy(zero_copy_only=False) == table.column("tile").to_numpy())]] = True
    absent = np.ones(len(names), dtype=np.int64)
    some = head & (total > 0)  # a language without kept terms has none
    absent[row[some]] = parts(np.zeros(int(some.sum()), np.int64), total[some])
    encoded = term.filter(pa.array(~head)).dictionary_encode()
    spot, row, n, total = encoded.indices.to_numpy().astype(np.int64), row[~head], n[~head], total[~head]
    order = np.lexsort((spot, row))
    spot, row, p = spot[order], row[order], parts(n[order], total[order])
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    found = list(differences(indptr, spot, p, absent, len(encoded.dictionary), np.flatnonzero(mine)))
    a = np.repeat([g for g, _ in found], len(names)).astype(np.int64)
    b = np.tile(np.arange(len(names)), len(found))
    value = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
    other = a != b
    label = pa.array([s.decode() for s in names], pa.string())
    lang = pa.array([table.column("lang")[0].as_py()] * int(other.sum()), pa.string())
    return pa.table({"lang": lang, "source": label.take(pa.array(a[other])), "item": label.take(pa.array(b[other])), "value": pa.array(value[other], pa.int64())})


def share(n: str, total: str) -> Column:
    """As :func:`parts`, in decimals."""
    return F.expr(f"1 + (CAST({BILLION} AS DECIMAL(10, 0)) * CAST({n} + {SMOOTHING} AS DECIMAL(20, 0))) DIV CAST({total} AS DECIMAL(20, 0))")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", work: Scratch | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): per group its distances to other sources, and the terms that it has more of than its language."""
    work = work or Scratch(docs.sparkSession)
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    whole = Window.partitionBy("lang", "term")
    counts = term_counts(slim).select(
        "*", F.sum("documents").over(whole).alias("spread"), F.sum("n").over(whole).alias("lang_n"), F.row_number().over(whole.orderBy("source")).alias("nth")
    )
    kept = work.table(counts.where(F.col("spread") >= least_documents).select("lang", "source", "term", "n", "lang_n", (F.col("nth") == 1).cast("long").alias("new")), "terms")
    per_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("new").alias("terms"), F.count("*").alias("entries"))
    groups = slim.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(per_lang, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    facts = groups.select("lang", "source", *(zero(c).alias(c) for c in ("own", "lang_total", "terms", "entries")))
    by_source = Window.partitionBy("lang").orderBy("source")
    facts = facts.select(
        "lang", "source", (F.col("own") + SMOOTHING * F.col("terms")).alias("total"), (F.col("lang_total") + SMOOTHING * F.col("terms")).alias("lang_sum"), "entries",
        (F.row_number().over(by_source) - 1).cast("long").alias("nth"), F.count("*").over(Window.partitionBy("lang")).alias("sources"),
    )
    size = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.col("sources") * F.col("sources")))
    facts = facts.select(
        "lang", "source", "total", "lang_sum", F.floor(F.col("nth") / TILE).cast("long").alias("own"),
        F.greatest(F.lit(1), F.ceil(F.col("entries") / size)).cast("long").alias("blocks"), F.ceil(F.col("sources") / TILE).cast("long").alias("tiles"),
    )
    facts = work.table(facts, "sources")
    known = F.broadcast(facts) if facts.count() <= MOST_BROADCAST else facts
    entries = kept.join(known, ["lang", "source"])
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    # Every block also gets a row for each source, so that those without any of its terms count, too.
    heads = facts.select("*", to("blocks").alias("block")).select("lang", "block", to("tiles").alias("tile"), "own", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total")
    cells = entries.select("*", block).select("lang", "block", to("tiles").alias("tile"), "own", "source", "term", "n", "total").unionByName(heads)
    sums = cells.groupBy("lang", "block", "tile").applyInArrow(block_pairs, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    more = entries.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share("n", "total") - share("lang_n", "lang_sum")).cast("long").alias("value")).where("value > 0")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(more).where(F.col("rank") <= top_terms))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS df FROM w GROUP BY ALL
), k AS (SELECT lang, term, sum(n) AS ln FROM c GROUP BY ALL HAVING sum(df) >= 30
), v AS (SELECT lang, count(*) AS v, sum(ln) AS ln FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), e AS (SELECT g.lang, g.source, k.term, k.ln, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), s AS (SELECT lang, source, sum(n) AS sn FROM e GROUP BY ALL
), p AS (
  SELECT e.lang, e.source, e.term, e.n, 1 + (1000000000 * (e.n + 5)) // (s.sn + 5 * v.v) AS p, 1 + (1000000000 * (e.ln + 5)) // (v.ln + 5 * v.v) AS q
  FROM e JOIN s USING (lang, source) JOIN v USING (lang)
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
