"""The daily funnel: one row per date, country and platform.

A reward is unpriced if no payout is known for it: its offer is not in the catalog, or it names none.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.config import Config
from weirflow.functions import timing

GRAIN = ("date", "country", "platform")
REWARD = "reward_paid"


def counts(config: Config) -> list[str]:
    """The counting columns in order."""
    return ["installs", "events_total", *(f"{s}_users" for s in config.steps), "reward_payouts", "rewards_unpriced", "late_events", "events_pre_install"]


def enrich(events: DataFrame, installs: DataFrame, offers: DataFrame) -> DataFrame:
    """Events of installed users with country, platform and the offer's payout; each dimension is met once.

    Events that :func:`weirflow.operators.flags.meet` made have met both already.
    """
    if "is_installed" in events.columns:
        return events.where("is_installed").withColumn("date", F.col("event_date"))
    users = installs.select("user_id", "country", "platform")
    prices = offers.select("offer_id", "payout_eur")
    return events.join(users, "user_id").join(prices, "offer_id", "left").withColumn("date", F.col("event_date"))


def by_user(enriched: DataFrame, config: Config) -> DataFrame:
    """A first level per user: step flags and partial sums, so that distinct users need no row copies."""
    reward = F.col("event_name") == REWARD
    steps = [F.max((F.col("event_name") == s).cast("int")).alias(f"_{s}") for s in config.steps]
    return enriched.groupBy(*GRAIN, "user_id").agg(
        F.count("*").alias("n"), *steps, F.sum(reward.cast("int")).alias("payouts"), F.sum(F.when(reward, F.col("payout_eur"))).alias("cost"),
        F.sum((reward & F.col("payout_eur").isNull()).cast("int")).alias("unpriced"), F.sum(F.col("is_late").cast("int")).alias("late"),
        F.sum(F.col("is_pre_install").cast("int")).alias("pre"),
    )


def aggregate(events: DataFrame, installs: DataFrame, offers: DataFrame, config: Config | None = None) -> DataFrame:
    """The whole gold table."""
    config = config or Config()
    users = by_user(enrich(events, installs, offers), config)
    funnel = users.groupBy(*GRAIN).agg(
        F.sum("n").alias("events_total"), *(F.sum(f"_{s}").alias(f"{s}_users") for s in config.steps), F.sum("payouts").alias("reward_payouts"),
        F.sum("cost").cast("decimal(18,2)").alias("reward_cost_eur"), F.sum("unpriced").alias("rewards_unpriced"),
        F.sum("late").alias("late_events"), F.sum("pre").alias("events_pre_install"),
    )
    return _finished(_installs_per_day(installs).join(funnel, list(GRAIN), "full_outer"), config)


def aggregate_distinct(events: DataFrame, installs: DataFrame, offers: DataFrame, config: Config | None = None) -> DataFrame:
    """The same by one level of distinct counts; plans an Expand, kept as a check of the two-level form."""
    config = config or Config()
    reward = F.col("event_name") == REWARD
    funnel = enrich(events, installs, offers).groupBy(*GRAIN).agg(
        F.count("*").alias("events_total"), *(F.countDistinct(F.when(F.col("event_name") == s, F.col("user_id"))).alias(f"{s}_users") for s in config.steps),
        F.count_if(reward).alias("reward_payouts"), F.sum(F.when(reward, F.col("payout_eur"))).cast("decimal(18,2)").alias("reward_cost_eur"),
        F.count_if(reward & F.col("payout_eur").isNull()).alias("rewards_unpriced"), F.count_if("is_late").alias("late_events"), F.count_if("is_pre_install").alias("events_pre_install"),
    )
    return _finished(_installs_per_day(installs).join(funnel, list(GRAIN), "full_outer"), config)


def _installs_per_day(installs: DataFrame) -> DataFrame:
    return installs.groupBy(F.col("install_date").alias("date"), "country", "platform").agg(F.count("*").alias("installs"))


def _finished(joined: DataFrame, config: Config) -> DataFrame:
    """Zeros for what is missing, the settled flag, columns in order."""
    filled = joined.fillna(0, subset=[*counts(config), "reward_cost_eur"])
    settled = filled.withColumn("is_settled", timing.is_settled(F.col("date"), config.lookback_days, config.as_of))
    names = counts(config)
    at = names.index("rewards_unpriced")
    return settled.select(*GRAIN, *names[:at], "reward_cost_eur", *names[at:], "is_settled")


def window(events: DataFrame, installs: DataFrame, offers: DataFrame, lo: date, hi: date, config: Config | None = None) -> DataFrame:
    """Gold rows of the dates from ``lo`` to ``hi``.

    Only events are filtered before the joins: a user who installed before the
    window still gives its events their country.
    """
    within = aggregate(events.where(F.col("event_date").between(lo, hi)), installs, offers, config)
    return within.where(F.col("date").between(lo, hi))
