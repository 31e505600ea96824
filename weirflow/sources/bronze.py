"""Raw files as text columns with audit columns, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESCUED, _LINE = "_rescued_data", "_line_that_does_not_fit"

#: What each source must deliver.
CONTRACT = {
    "events": ("event_id", "user_id", "event_ts", "event_name", "offer_id", "ingest_ts"),
    "installs": ("user_id", "install_ts", "country", "platform", "media_source", "device_model", "campaign_id"),
    "offers": ("offer_id", "offer_category", "payout_type", "payout_eur"),
    "user_profile": ("user_id", "events_lifetime", "last_seen_ts", "revenue_30d_eur", "is_payer"),
}


def schema(source: str, rescue: bool = False) -> T.StructType:
    """All text; with a column for rows that don't fit where asked."""
    return T.StructType([T.StructField(c, T.StringType()) for c in (*CONTRACT[source], *([_LINE] if rescue else []))])


def audited(df: DataFrame, source: str) -> DataFrame:
    """Where a row came from, when, and of which source."""
    told = [c for c in df.columns if c != _LINE]
    # Spark does not answer what asks for the line alone, so the rescued line is made to depend on a column of data, too.
    rescued = [F.when(F.col(_LINE).isNotNull() | (F.length(told[0]) < 0), F.col(_LINE)).alias(RESCUED)] if _LINE in df.columns else []
    return df.select(*told, *rescued, F.col("_metadata.file_path").alias("_source_file"), F.current_timestamp().alias("_ingested_at"), F.lit(source).alias("_source"))


def _options(reader, rescue: bool, header: bool = True):
    reader = reader.option("header", header).option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", False if not rescue else True)
    # Whole lines are parsed, whatever columns are asked for: a line fits or it does not.
    return reader.option("columnNameOfCorruptRecord", _LINE).option("columnPruning", False) if rescue else reader


def read_csv(spark: SparkSession, source: str, path: str, rescue: bool = False, header: bool = True) -> DataFrame:
    """A batch of CSV files; with ``rescue`` lines with too few or too many fields are kept as they came, beside what could be read of them."""
    return audited(_options(spark.read.schema(schema(source, rescue)), rescue, header).csv(path), source)


def stream_csv(spark: SparkSession, source: str, path: str, rescue: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """The same files as they arrive."""
    reader = _options(spark.readStream.schema(schema(source, rescue)), rescue)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return audited(reader.csv(path), source)


def distinct_within(stream: DataFrame, horizon: str) -> DataFrame:
    """A stream without rows that have come before, in the same or another file, within a horizon of arrival.

    Rows are compared by all they say; audit columns are left out.  What remains does not depend on how files are dealt into
    batches; the state that remembers rows is kept in the checkpoint and let go of after the horizon.
    """
    told = [c for c in stream.columns if not c.startswith("_") or c == RESCUED]
    return stream.withWatermark("_ingested_at", horizon).dropDuplicatesWithinWatermark(told)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Rows of several places; columns that one lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def backfill_ingested(df: DataFrame, moment: str) -> DataFrame:
    """Rows from before the audit column get a fixed moment."""
    now = F.lit(moment).cast("timestamp")
    return df.withColumn("_ingested_at", F.coalesce(F.col("_ingested_at"), now) if "_ingested_at" in df.columns else now)
