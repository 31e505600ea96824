"""Secrets, and whose they are: corpus-wide ownership frequency.

Native: DataFrame and SQL functions only.  Candidates are found by three fixed
patterns; the hash of each candidate's value is counted by distinct
repositories and owners over the whole corpus.  Every candidate gets a verdict:
a value that several owners have, or one or two owners in still more
repositories, or that reads like a placeholder, is an ``example``; any other is
``live``, from the least length of its pattern on and whether or not it mixes
letters and digits.  Each judged span carries both counts.

Positions come from the text between matches: ``split`` cuts a text where
``regexp_extract_all`` finds its matches, so the lengths of both, added up in
turn, are the matches' bounds in code points.

Skew: one value may be in a third of all rows.  Counting is a distinct
aggregate with partial sums; the join that brings the counts back is an
equi-join that adaptive execution may split.  No group of rows is collected but
the candidates of one text.

Defined results: a null text counts as empty; an empty text has no spans; texts
of any length are read whole; null repositories and owners count as one unnamed
one; spans that begin together come by kind; repeated rows (same id and text)
give the same result each; empty tables give empty tables; only the columns named
are read, whatever others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.workspace import materialise

KINDS = ("assign", "access", "hex", "live", "example")

#: The patterns of the base kinds; of the first, group 2 is the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are whole: the same as [0-9a-f]+ of which shorter ones are dropped
PLACEHOLDER = r"(?i)example|sample|changeme|dummy|placeholder|your[_-]?|xxxx|\*\*\*\*|0000000"
LEAST_VALUE, LEAST_ACCESS = 8, 16
OWNERS_OF_AN_EXAMPLE = 3
REPOSITORIES_OF_AN_EXAMPLE = 4  #: more than of owners: copies within one owner say less
BLOCK = 64  #: matches whose places are added up at a time
MASK = "[SECRET]"


def _literal(pattern: str) -> str:
    """A pattern as a raw SQL literal that has no quote in it."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, kind: int, group: int) -> str:
    """SQL: array of (kind, start, end, value) of all matches; the value is the group's text and ends with the match.

    Places are added up block by block, so that no long list grows by one match at a time.
    """
    p, none = _literal(pattern), "cast(array() AS array<struct<kind:int,start:int,end:int,value:string>>)"
    found = f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p})" + (f", 'v', regexp_extract_all({text}, {p}, {group}))" if group else ")")
    matches = f"arrays_zip(slice(transform(f.g, g -> length(g)), 1, size(f.m)), transform(f.m, m -> length(m)), {'f.v' if group else 'f.m'})"
    one = f"named_struct('kind', {kind}, 'start', c.at + x['0'], 'end', c.at + x['0'] + x['1'], 'value', {'x.v' if group else 'x.m'})"
    block = f"""aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}), named_struct('at', a.at, 'out', {none}),
      (c, x) -> named_struct('at', c.at + x['0'] + x['1'], 'out', concat(c.out, array({one}))))"""
    return f"""
    CASE WHEN {text} RLIKE {p} THEN flatten(transform(array({found}), f -> flatten(transform(array({matches}), z -> aggregate(
      sequence(0, (size(z) - 1) div {BLOCK}),
      named_struct('at', 0, 'outs', cast(array() AS array<array<struct<kind:int,start:int,end:int,value:string>>>)),
      (a, b) -> transform(array({block}), r -> named_struct('at', r.at, 'outs', concat(a.outs, array(r.out))))[0],
      a -> flatten(a.outs))))))
    ELSE {none} END"""


def _rendered(spans: str) -> str:
    """SQL: ``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"""array_join(transform(
      array_sort(transform({spans}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))),
      s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.end)), ',')"""


def _slim(docs: DataFrame, id_col: Column, text_col: Column, repository: Column, owner: Column) -> DataFrame:
    """Rows (doc_id, text, repository, owner), nulls of the last three as empty."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(id_col.alias("doc_id"), blank(text_col).alias("text"), blank(repository).alias("repository"), blank(owner).alias("owner"))


def candidates(slim: DataFrame) -> DataFrame:
    """Per row of ``slim``: key, doc_id, repository, owner and the base spans with hashed values."""
    found = slim.withColumns({
        "key": key(F.col("doc_id"), F.col("text")),
        "_assign": F.expr(f"filter({_matches('text', ASSIGN, 0, 2)}, x -> length(x.value) >= {LEAST_VALUE})"),
        "_access": F.expr(f"filter({_matches('text', ACCESS, 1, 0)}, x -> length(x.value) >= {LEAST_ACCESS})"),
        "_hex": F.expr(_matches("text", HEX, 2, 0)),
    })
    base = f"""transform(concat(_assign, _access, _hex), x -> named_struct(
      'kind', x.kind, 'start', x.start, 'end', x.end, 'value_start', x.end - length(x.value), 'hash', unhex(sha2(x.value, 256)),
      'placeholder', x.value RLIKE {_literal(PLACEHOLDER)}))"""
    return found.select("key", "doc_id", "repository", "owner", F.expr(base).alias("base"))


def key(id_col: Column, text_col: Column) -> Column:
    """What a row's verdict hangs on: its id and text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text_col.cast("string"), F.lit(""))), 256))


def judged(slim: DataFrame, owners_of_an_example: int = OWNERS_OF_AN_EXAMPLE, repositories_of_an_example: int = REPOSITORIES_OF_AN_EXAMPLE) -> DataFrame:
    """Per row of ``slim``: key, doc_id, ``base`` spans and ``judged`` value spans (start, kind, end, n_repositories, n_owners), kinds 3 live and 4 example."""
    rows = materialise(candidates(slim), "secrets")
    each = rows.where(F.size("base") > 0).select("key", "repository", "owner", F.explode("base").alias("c")).select("key", "repository", "owner", "c.*")
    owned = each.select("hash", "repository", "owner").distinct()
    frequency = owned.groupBy("hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    shared = (F.col("n_owners") >= owners_of_an_example) | (F.col("n_repositories") >= repositories_of_an_example)
    found = each.join(frequency, "hash").withColumn("verdict", F.when(F.col("placeholder") | shared, 4).otherwise(3))
    verdicts = found.groupBy("key").agg(
        F.collect_set(F.struct(F.col("value_start").alias("start"), F.col("verdict").alias("kind"), "end", "n_repositories", "n_owners")).alias("judged"),
    )
    none = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int,n_repositories:bigint,n_owners:bigint>>)")
    return rows.join(verdicts, "key", "left").select("key", "doc_id", "base", F.coalesce("judged", none).alias("judged"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str = "source", owners_of_an_example: int = OWNERS_OF_AN_EXAMPLE, repositories_of_an_example: int = REPOSITORIES_OF_AN_EXAMPLE) -> DataFrame:
    """As :func:`judged`, over the named columns of ``docs``."""
    slim = _slim(docs, *(F.col(f"`{c}`") for c in (id_col, text_col, repository_col, owner_col)))
    return judged(slim, owners_of_an_example, repositories_of_an_example)


def masked_rows(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """Per row of ``docs``: the row as it was in ``doc``, ``text`` with every live value replaced by ``mask``, and whether any was (``masked``)."""
    own_id, own_text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    found = judged(_slim(docs, own_id, own_text, repository, owner))
    live = found.select("key", F.expr("array_sort(filter(judged, s -> s.kind = 3))").alias("live")).where(F.size("live") > 0).dropDuplicates(["key"])
    # Values may overlap (an assignment whose value is a long hexadecimal run): a later start inside a masked part masks only what goes beyond.
    # Parts are joined once at the end.
    parts = f"""aggregate(live, named_struct('at', 0, 'out', cast(array() AS array<string>)),
      (a, s) -> CASE WHEN s.end <= a.at THEN a ELSE named_struct('at', s.end, 'out',
        CASE WHEN s.start >= a.at THEN concat(a.out, array(substring(text, a.at + 1, s.start - a.at), '{mask}')) ELSE a.out END) END,
      a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"""
    # All of a document's columns travel in a struct, so none of their names can clash with ours.
    keyed = docs.select(key(own_id, own_text).alias("key"), own_text.cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    any_live = F.col("live").isNotNull()
    return keyed.join(live, "key", "left").select("doc", F.when(any_live, F.expr(parts)).otherwise(F.col("text")).alias("text"), any_live.alias("masked"))


def masked(docs: DataFrame, mask: str = MASK, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str = "source") -> DataFrame:
    """``docs`` with every live value in the text replaced by ``mask``; columns as they were."""
    done = masked_rows(docs, F.col(f"`{repository_col}`"), F.col(f"`{owner_col}`"), id_col, text_col, mask)
    return done.select(*((F.col("text") if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``: source is the owner, source and language the repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = judged(_slim(docs, F.col("doc_id"), F.col("text"), F.concat_ws("/", "source", "lang"), F.col("source")))
    of = lambda column, kind: F.expr(f"cast(size(filter({column}, s -> s.kind = {kind})) AS bigint)")
    plain = "transform({}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))"
    base, verdicts = plain.format("base"), plain.format("judged")
    return found.select(
        "doc_id", of("base", 0).alias("n_assign"), of("base", 1).alias("n_access"), of("base", 2).alias("n_hex"),
        F.sha2(F.expr(_rendered(base)).cast("binary"), 256).alias("base_sha256"), F.expr(_rendered(f"concat({base}, {verdicts})")).alias("spans"),
        of("judged", 3).alias("n_live"), of("judged", 4).alias("n_example"),
    )


def _oracle_matches(pattern: str, kind: int, group: int, least: int) -> str:
    """DuckDB: list of (start, kind, end, value) of the matches whose value is long enough."""
    p, whole = "'" + pattern.replace("'", "''") + "'", f"regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}', 0)"
    gaps = f"list_transform(string_split_regex(text, {p}), lambda g: length(g))"
    return f"""(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
        's': (list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT, 'k': {kind},
        'e': (list_sum(g[1:i]) + list_sum(list_transform(m[1:i], lambda x: length(x))))::INT, 'v': v[i]}}), lambda x: length(x.v) >= {least})
      FROM (SELECT {whole} AS m, {gaps} AS g, regexp_extract_all(text, {p}, {group}) AS v))"""


def _oracle_rendered(spans: str) -> str:
    """DuckDB: as ``_rendered``."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"""coalesce(array_to_string(list_transform(list_sort({spans}), lambda x: [{names}][x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, source, repository,
    {_oracle_matches(ASSIGN, 0, 2, LEAST_VALUE)} AS a0,
    {_oracle_matches(ACCESS, 1, 0, LEAST_ACCESS)} AS a1,
    {_oracle_matches(HEX, 2, 0, 32)} AS a2
  FROM d
),
e AS (SELECT doc_id, source, repository, unnest(list_concat(a0, list_concat(a1, a2))) AS x FROM b),
o AS (SELECT x.v AS v, count(DISTINCT source) AS owners, count(DISTINCT repository) AS repositories FROM e GROUP BY 1),
j AS (
  SELECT doc_id, x.e - length(v) AS s, x.e AS e,
    CASE WHEN regexp_matches(v, '{PLACEHOLDER}') OR owners >= {OWNERS_OF_AN_EXAMPLE} OR repositories >= {REPOSITORIES_OF_AN_EXAMPLE} THEN 4 ELSE 3 END AS k
  FROM e JOIN o ON e.x.v = o.v
),
l AS (SELECT doc_id, list(DISTINCT {{'s': s::INT, 'k': k, 'e': e}}) AS judged FROM j GROUP BY 1),
z AS (
  SELECT doc_id, len(a0)::BIGINT AS n_assign, len(a1)::BIGINT AS n_access, len(a2)::BIGINT AS n_hex,
    list_transform(list_concat(a0, list_concat(a1, a2)), lambda x: {{'s': x.s, 'k': x.k, 'e': x.e}}) AS base,
    coalesce(judged, []) AS judged
  FROM b LEFT JOIN l USING (doc_id)
)
SELECT doc_id, n_assign, n_access, n_hex, sha256({_oracle_rendered("base")}) AS base_sha256,
  {_oracle_rendered("list_concat(base, judged)")} AS spans,
  len(list_filter(judged, lambda x: x.k = 3))::BIGINT AS n_live, len(list_filter(judged, lambda x: x.k = 4))::BIGINT AS n_example
FROM z
"""
