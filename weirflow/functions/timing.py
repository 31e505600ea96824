"""Lateness of events and settlement of days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def late_after(event_ts: Column, cutoff: timedelta) -> Column:
    """The moment from which an event's arrival is late: the cutoff of the day after it."""
    return F.date_add(F.to_date(event_ts), 1).cast("timestamp") + F.lit(cutoff)


def is_late(event_ts: Column, ingest_ts: Column, cutoff: timedelta) -> Column:
    return ingest_ts.cast("timestamp") > late_after(event_ts, cutoff)


def lag_hours(event_ts: Column, ingest_ts: Column) -> Column:
    """Hours from event to arrival, by whole seconds."""
    return (F.unix_timestamp(ingest_ts.cast("timestamp")) - F.unix_timestamp(event_ts.cast("timestamp"))) / F.lit(3600.0)


def is_settled(day: Column, lookback_days: int, as_of: date | None = None) -> Column:
    """Whether no late event can change a day any more."""
    today = F.current_date() if as_of is None else F.lit(as_of)
    return day <= F.date_sub(today, lookback_days)
