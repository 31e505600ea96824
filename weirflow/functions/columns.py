"""Normalising text columns into typed ones; what cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.config import PAYER_TOKENS


def as_text(df: DataFrame) -> DataFrame:
    """The frame with text in all columns; audit columns, whose names begin with an underscore, keep their types."""
    untyped = [c for c in df.columns if not c.startswith("_")]
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in untyped})


def trimmed(name: str) -> Column:
    return F.trim(F.col(name))


def lowered(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def blank_to_null(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def timestamp(name: str) -> Column:
    return F.try_to_timestamp(F.trim(F.col(name).cast("string")))


def money(name: str) -> Column:
    return F.trim(F.col(name).cast("string")).try_cast("decimal(18,2)")


def whole(name: str) -> Column:
    return F.trim(F.col(name).cast("string")).try_cast("bigint")


def payer(name: str) -> Column:
    """True, false or (of null) null."""
    return lowered(name).isin(*PAYER_TOKENS)


def platform_of(device: str) -> Column:
    return F.when(F.lower(F.col(device)).contains("iphone"), F.lit("ios")).otherwise(F.lit("android"))


def raw_record(df: DataFrame) -> Column:
    """The row as it came, as JSON, without audit columns."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("_"))))


def column_or(df: DataFrame, name: str, kind: str) -> Column:
    """A column, or a typed null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
