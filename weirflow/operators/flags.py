"""Anomalies are flagged, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.config import Config
from weirflow.functions import timing

#: The anomalies as the flags' array names them, in its order, and their columns.
FLAGS = {"late_arrival": "is_late", "orphan_offer": "is_orphan_offer", "pre_install": "is_pre_install"}
ADDED = ("event_date", "lag_hours", "is_late", "is_orphan_offer", "is_pre_install", "dq_flags")  #: columns of a flagged event
CARRIED = ("country", "platform", "payout_eur", "is_installed")  #: what gold needs of the dimensions


def meet(events: DataFrame, offers: DataFrame, installs: DataFrame, config: Config) -> DataFrame:
    """Events with their flags and, from the same two joins, country, platform, payout and whether the user has installed.

    Whether a side is broadcast is left to the optimizer and the sizes it sees.
    """
    catalog = offers.select("offer_id", "payout_eur", F.lit(True).alias("_offered"))
    users = installs.select("user_id", "country", "platform", F.col("install_ts").alias("_installed_at"), F.lit(True).alias("_installed"))
    both = events.join(catalog, "offer_id", "left").join(users, "user_id", "left")
    event_ts, ingest_ts, installed = F.col("event_ts"), F.col("ingest_ts"), F.coalesce("_installed", F.lit(False))
    made = {
        "event_date": F.to_date(event_ts), "lag_hours": timing.lag_hours(event_ts, ingest_ts), "is_late": timing.is_late(event_ts, ingest_ts, config.late_cutoff),
        "is_orphan_offer": F.col("offer_id").isNotNull() & F.col("_offered").isNull(), "is_pre_install": F.coalesce(event_ts < F.col("_installed_at"), F.lit(False)),
        "is_installed": installed,
    }
    flagged = both.withColumns(made)
    found = F.array_compact(F.array(*(F.when(F.col(c), F.lit(name)) for name, c in FLAGS.items())))
    return flagged.withColumn("dq_flags", found).select(*events.columns, *ADDED, *CARRIED)


def flag(events: DataFrame, offers: DataFrame, installs: DataFrame, config: Config) -> DataFrame:
    """Late, orphan-offer and pre-install flags, their array, the event's date and lag."""
    return meet(events, offers, installs, config).drop(*CARRIED)
