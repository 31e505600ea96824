"""Alerts on rules: one message when a rule begins to fail, one when it holds again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.sources.store import ParquetStore

STATE = "rule string, failing boolean, since timestamp"
MESSAGES = "rule string, change string, run_ts timestamp, violations double"


def transitions(results: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, state): what has changed from the state over the runs in ``results`` (rule, run_ts, passed, violations).

    Within a run a rule that several checks evaluate fails if one of them fails.  A rule that has never failed and passes sends
    nothing; a rule that no run evaluates stays as it was.
    """
    runs = results.groupBy("rule", "run_ts").agg((~F.min("passed")).alias("failing"), F.max("violations").alias("violations"))
    known = state.select("rule", F.lit(None).cast("timestamp").alias("run_ts"), "failing", F.lit(None).cast("double").alias("violations"), "since")
    in_order = Window.partitionBy("rule").orderBy(F.asc_nulls_first("run_ts"))
    line = known.unionByName(runs.withColumn("since", F.lit(None).cast("timestamp"))).withColumn("before", F.coalesce(F.lag("failing").over(in_order), F.lit(False)))
    changed = F.col("run_ts").isNotNull() & (F.col("failing") != F.col("before"))
    line = line.withColumn("changed", changed)
    messages = line.where("changed").select("rule", F.when(F.col("failing"), "opened").otherwise("closed").alias("change"), "run_ts", "violations")
    last = line.groupBy("rule").agg(
        F.max_by("failing", F.coalesce("run_ts", F.lit("0001-01-01").cast("timestamp"))).alias("failing"),
        F.coalesce(F.max(F.when(F.col("changed"), F.col("run_ts"))), F.max("since")).alias("since"),
    )
    return messages, last.select("rule", "failing", "since")


def alert(store: ParquetStore, send: Callable[[list[dict]], object], results: str = "dq.results", table: str = "dq.alerts") -> list[dict]:
    """Send what has changed since the last call, in the order of runs; then remember it, with the bound that it was read to.

    If sending fails, or the run dies before the state is stored, the next call sends it again: a message comes at least once.
    """
    if not store.exists(results):
        return []
    seen = store.properties(table).get("seen_until")
    found = store.read(results).where("rule IS NOT NULL")
    bound = found.agg(F.max("run_ts").cast("string")).first()[0]
    fresh = found.where(F.col("run_ts") <= F.lit(bound).cast("timestamp"))
    if seen:
        fresh = fresh.where(F.col("run_ts") > F.lit(seen).cast("timestamp"))
    messages, state = transitions(fresh, store.read_or(table, STATE))
    told = [r.asDict() for r in messages.orderBy("run_ts", "rule").collect()]  # at most a few per rule and run
    if told:
        send(told)
    if bound and bound != seen:
        store.overwrite(table, state, notes=lambda _, __: {"seen_until": bound})
    return told
