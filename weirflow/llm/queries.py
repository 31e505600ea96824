"""Registry of this folder's queries: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm.byte_bpe import op10_byte_bpe
from weirflow.llm import divergence, hard_negatives, jaccard, line_dedup, near_vectors, secrets, top_k, toxicity, warc
from weirflow.llm.packing import op6_best_fit_packing
from weirflow.llm.pii import op3_pii
from weirflow.llm.sentence_pieces import op11_sentence_pieces
from weirflow.llm.workspace import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package on the workers' path."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over whole tables."""
    return {f.__name__: _shipped(f) for f in (warc.op1_warc, toxicity.op2_toxicity, op3_pii, line_dedup.op4_line_dedup, jaccard.op5_jaccard_join, op6_best_fit_packing, secrets.op7_secret_scans, top_k.op8_top_k, near_vectors.op9_near_vectors, op10_byte_bpe, op11_sentence_pieces, hard_negatives.op12_hard_negatives, divergence.op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_warc": warc.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op7_secret_scans": secrets.ORACLE, "op8_top_k": top_k.ORACLE, "op9_near_vectors": near_vectors.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_source_divergence": divergence.ORACLE}
