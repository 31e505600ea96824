"""Quantiles and distinct users of any span of days, from one small row per day.

A day's lags are a KLL sketch and its users an HLL sketch, both built in; days
are merged for a span without another look at events.  Numbers of rows, extremes
and negative lags are kept exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 800  #: of the KLL sketches: larger is finer
LG_K = 12  #: of the HLL sketches
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def rank_error(k: int = K) -> float:
    """How far the rank of an estimate may lie off, as a share of all rows (99 % confidence): the published fit for KLL sketches."""
    return 2.296 / k**0.9021


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative error of distinct users at three standard deviations."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def daily(events: DataFrame) -> DataFrame:
    """One row per day: rows, extremes and negative lags, and the sketches."""
    lag = F.col("lag_hours")
    return events.groupBy("event_date").agg(
        F.count(lag).alias("rows"), F.min(lag).alias("min_lag"), F.max(lag).alias("max_lag"), F.count_if(lag < 0).alias("negative_rows"),
        F.kll_sketch_agg_double(lag, F.lit(K)).alias("lags"), F.hll_sketch_agg("user_id", LG_K).alias("users"),
    )


def merged(days: DataFrame, *keys: Column | str) -> DataFrame:
    """Days merged, per key or all of them: quantiles of lag and distinct users are estimates, the rest is exact."""
    both = days.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.min("min_lag").alias("min_lag"), F.max("max_lag").alias("max_lag"), F.sum("negative_rows").alias("negative_rows"),
        F.kll_merge_agg_double("lags").alias("lags"), F.hll_union_agg("users").alias("_users"),
    )
    return both.select(
        *[c for c in both.columns if c not in ("lags", "_users")], *(F.kll_sketch_get_quantile_double("lags", F.lit(p)).alias(name) for name, p in QUANTILES.items()),
        F.hll_sketch_estimate("_users").alias("users"),
    )


def checked(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Per span (name, lo, hi) what the merged sketches say beside exact numbers, and whether they err as little as promised."""
    inside = F.col("event_date").between(F.col("lo"), F.col("hi"))
    told = merged(daily(events).join(F.broadcast(spans), inside), "name")
    rows = events.join(F.broadcast(spans), inside).select("name", "user_id", "lag_hours").join(F.broadcast(told.select("name", *QUANTILES)), "name")
    # An estimate has the ranks from the first to the last of its equals.
    ranks = [f(F.col("lag_hours"), F.col(q)).cast("int") for q in QUANTILES for f in (lambda a, b: a < b, lambda a, b: a <= b)]
    exact = rows.groupBy("name").agg(F.countDistinct("user_id").alias("exact_users"), *(F.avg(r).alias(f"_{i}") for i, r in enumerate(ranks)))
    fits = [(F.col(f"_{2 * i}") <= p + 2 * rank_error()) & (F.col(f"_{2 * i + 1}") >= p - 2 * rank_error()) for i, p in enumerate(QUANTILES.values())]
    near = F.abs(F.col("users") - F.col("exact_users")) <= F.greatest(F.lit(1.0), distinct_error() * F.col("exact_users"))
    return told.join(exact, "name").select(
        "name", "rows", F.round("min_lag", 6).alias("min_lag"), F.round("max_lag", 6).alias("max_lag"), "negative_rows", F.col("exact_users").alias("users"),
        F.array_min(F.array(*fits)).alias("ranks_within"), near.alias("users_within"),
    )
