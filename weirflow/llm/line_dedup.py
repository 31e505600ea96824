"""Repeated passages by overlapping three-line windows.

Native: DataFrame and SQL functions only.  Lines are compared trimmed; blank
lines do not count.  Every run of three counting lines is a window with a
128-bit hash.  The first occurrence of a window (smallest doc_id, then
position) stays; of every later one all three lines are covered, and the union
of a text's covered lines is removed.  A later occurrence that overlaps the
first one within the same text removes nothing, so the first always survives
whole.

Skew: a window that a third of the corpus shares is one row per task after
partial aggregation; the join that brings first places back to windows is an
equi-join that adaptive execution may split.  Texts are shuffled once.

Defined results: null texts stay null and have no lines; texts of fewer than
three counting lines are left as they are; texts of any length are compared and
cut whole; of equal windows at one place of a text the first counts; repeated rows (same id and text)
count as one document and are treated alike; null ids come before all others;
empty tables give empty tables; other columns pass through untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.workspace import materialise

WINDOW = 3


def _key(id_col: str, text_col: str) -> Column:
    """What identifies a document: id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, id, at, hash, lines): the windows of every text; ``lines`` are their lines' numbers."""
    counting = "filter(transform(split(text, '\\n'), (l, i) -> named_struct('i', i, 'l', trim(BOTH ' \\t\\r' FROM l))), x -> x.l <> '')"
    made = f"""transform(array({counting}), c -> CASE WHEN size(c) >= {WINDOW} THEN transform(sequence(0, size(c) - {WINDOW}), i -> named_struct(
      'hash', unhex(md5(concat_ws('\\n', c[i].l, c[i + 1].l, c[i + 2].l))),
      'lines', array(c[i].i, c[i + 1].i, c[i + 2].i))) END)[0]"""
    slim = docs.select(_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    per_text = slim.select("key", "id", F.expr(made).alias("w"))
    return per_text.select("key", "id", F.posexplode("w").alias("at", "w")).select("key", "id", "at", "w.hash", "w.lines")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, removed): the line numbers that later occurrences cover, merged, for texts that have any."""
    each = materialise(windows(docs, id_col, text_col), "windows")
    first = each.groupBy("hash").agg(F.min(F.struct("id", "key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    later = each.join(first, "hash").where((F.col("key") != F.col("first.key")) | (F.col("at") - F.col("first.at") >= WINDOW))
    return later.select("key", F.explode("lines").alias("line")).groupBy("key").agg(F.collect_set("line").alias("removed"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the row as it was in ``doc``, and ``text`` without covered lines, ``n_lines``, ``n_removed``."""
    # All of a document's columns travel in a struct, so none of their names can clash with ours.
    keyed = docs.select(_key(id_col, text_col).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    joined = keyed.join(covered(docs, id_col, text_col), "key", "left")
    lines = f"split(cast(doc.`{text_col}` AS string), '\\n')"
    # The one-element array binds the lines to a name, so that a text is split once and not for every line.
    kept = F.expr(f"transform(array({lines}), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), removed), i -> ls[i]), '\\n'))[0]")
    own = F.col(f"doc.`{text_col}`").cast("string")
    return joined.select(
        "doc", F.when(F.col("removed").isNull(), own).otherwise(kept).alias("text"),
        F.when(own.isNull(), 0).otherwise(F.size(F.expr(lines))).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with covered lines taken out of the text, and ``_n_lines``, ``_n_removed`` (in place of columns of these names)."""
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    columns = (F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in own)
    return deduped(docs, id_col, text_col).select(*columns, F.col("n_lines").alias("_n_lines"), F.col("n_removed").alias("_n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
c AS (
  SELECT doc_id, list_filter(list_transform(range(0, len(lines)), lambda i: {'i': i, 'l': trim(lines[i + 1], ' ' || chr(9) || chr(13))}), lambda x: x.l <> '') AS c FROM d
),
w AS (
  SELECT doc_id, u.pos AS pos, c[u.pos + 1].l || chr(10) || c[u.pos + 2].l || chr(10) || c[u.pos + 3].l AS body,
    [c[u.pos + 1].i, c[u.pos + 2].i, c[u.pos + 3].i] AS ls
  FROM c, LATERAL (SELECT unnest(range(0, greatest(len(c) - 2, 0))) AS pos) u
),
f AS (
  SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(pos) OVER o AS first_pos
  FROM w WINDOW o AS (PARTITION BY body ORDER BY doc_id, pos)
),
r AS (
  SELECT doc_id, list_distinct(flatten(list(ls))) AS removed FROM f WHERE doc_id <> first_doc OR pos - first_pos >= 3 GROUP BY doc_id
)
SELECT d.doc_id,
  CASE WHEN removed IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(removed, i)), lambda i: lines[i + 1]), chr(10)) END AS text,
  len(lines)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed
FROM d LEFT JOIN r USING (doc_id)
"""
