"""A corpus pipeline: toxicity, line dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the shared folder and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.

Every stage takes null texts (as empty, kept as null), empty and very long texts
(whole), null and repeated ids, repeated rows, columns of any other names, and an
empty table, which stays empty.  What else is defined stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import jaccard, line_dedup, packing, secrets, toxicity
from weirflow.llm.workspace import delete, made, new_path, ship

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the network learns from ``labels`` and the documents at hand.

    Rows are judged each by its own text, so repeated rows go or stay together; a score that equals the threshold goes.
    Without labels of both kinds nothing can be learnt and all scores are the share of positive labels.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later occurrences of three-line windows cover; those of which nothing is left go.

    The first occurrence is that of the smallest id, null ids first; repeated rows (same id and text) count as one document
    and keep the same lines.  Texts of which no line is removed stay, empty ones too.
    """
    done = line_dedup.deduped(docs)
    return _measured(done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")), F.col("n_removed") > 0, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the smallest id, null ids last, then by a hash of the text.

    Repeated rows are near duplicates, too, of which one stays; an id with two unrelated texts keeps both; texts without
    words are in no group and all stay.
    """
    return jaccard.one_of_each(docs, words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the values of live secrets masked; examples that many owners share stay.

    ``source`` is the owner, source and language the repository (null ones are one unnamed); values that overlap are masked
    together; repeated rows are masked alike; no row goes.
    """
    repository = F.concat_ws("/", *(F.col(c) for c in ("source", "lang") if c in docs.columns))
    done = secrets.masked_rows(docs, repository, F.col("source") if "source" in docs.columns else F.lit(None).cast("string"))
    return _measured(done, F.col("masked"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048.

    An empty text is its end token alone; equal lengths are told apart by id, piece and checksum; repeated rows are packed
    each on its own; an empty table gives no pieces.
    """
    import public_tokenizers

    packed = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _measured(done: DataFrame, changed, columns: list[str]) -> DataFrame:
    """The columns asked for, from ``doc`` and the new ``text``, with n_chars measured anew where the text has changed."""
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in columns else None}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the network nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again.

    What a stage has left in the shared folder goes when its result is written, and its result when the next one's is: only the
    last one's stays.
    """
    ship(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before = made()
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        for left in [x for x in made() if x == last or x not in (*before, path)]:
            delete(spark, left)
        last = path
    return docs
