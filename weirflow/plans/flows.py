"""From bronze to gold: full, incremental, windowed, backfilled; and the order of stages."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.config import Config
from weirflow.operators import cleanse, flags, funnel
from weirflow.plans import quality
from weirflow.sources.bronze import CONTRACT
from weirflow.sources.store import Notes, ParquetStore, abandon, work_for

GOLD = Config().table("gold", "daily_country_platform")
RESULTS = "dq.results"


# -- how far a table has come --------------------------------------------------


def mark(store: ParquetStore, table: str) -> datetime | None:
    """The latest arrival that a table has taken in; it moves with the table's pointer, so one table has one."""
    text = store.properties(table).get("arrived_until")
    return datetime.fromisoformat(text) if text else None


def since(bronze: DataFrame, low: datetime | None, high: datetime | None) -> DataFrame:
    """Rows that arrived after the mark, up to the pinned bound."""
    out = bronze if low is None else bronze.where(F.col("_ingested_at") > F.lit(low))
    return out if high is None else out.where(F.col("_ingested_at") <= F.lit(high))


def _until(high: datetime | None) -> dict[str, str]:
    return {} if high is None else {"arrived_until": high.isoformat()}


# -- gates ---------------------------------------------------------------------


def gate(store: ParquetStore, rules: list[quality.Rule], **tables: DataFrame) -> None:
    """Evaluate rules, log all results, raise if an error rule fails: called before what is checked becomes visible."""
    own = [r for r in rules if r.table in tables]
    quality.run_rules(tables, own, lambda found: store.append(RESULTS, found.withColumn("run_ts", F.current_timestamp())))


# -- silver --------------------------------------------------------------------

#: What a change of these facts of a dimension means for events: they are flagged, or placed, anew.
FACTS = {"offers": ("offer_id", ["payout_eur"]), "installs": ("user_id", ["install_ts", "country", "platform"])}


def load_silver(store: ParquetStore, config: Config | None = None, full: bool = False) -> list[date]:
    """Dimensions, events and rejects, incrementally up to a bound that is pinned first; the dates whose gold waits to be made.

    Each table takes in what has arrived since its own mark, which moves in the same step as its rows.  So does, with the events,
    what they were flagged with (the versions of the dimensions) and the dates that gold has yet to make.  A run that dies
    between two tables is therefore made up for by the next: nothing is taken in twice, and nothing is forgotten.
    """
    config = config or Config()
    raw = {n: store.read(config.table("bronze", n)) for n in CONTRACT}
    gate(store, quality.contract_rules(CONTRACT, raw), **raw)
    high = raw["events"].agg(F.max("_ingested_at")).first()[0]
    events, best = config.table("silver", "events"), config.table("silver", "event_best")
    full = full or not store.exists(events) or not store.exists(best) or store.properties(events).get("generation") != store.properties(best).get("generation")
    generation = uuid.uuid4().hex if full else store.properties(best)["generation"]
    _load_dimensions(store, raw, config, full)
    _load_best(store, raw["events"], high, config, full, generation)
    _load_events(store, raw["events"], high, config, full, generation)
    _load_rejects(store, raw, high, config, full, generation)
    return sorted(pending(store, config))


def _load_dimensions(store: ParquetStore, raw: dict[str, DataFrame], config: Config, full: bool) -> None:
    """Offers, installs and profiles anew where their raw tables have changed."""
    rules = quality.v1_silver_rules(config.steps)
    made = {"offers": lambda: cleanse.clean_offers(raw["offers"])[0], "installs": lambda: cleanse.clean_installs(raw["installs"], config)[0], "user_profile": lambda: cleanse.clean_user_profile(raw["user_profile"])}
    for name, make in made.items():
        table = config.table("silver", name)
        origin = f"{store.version(config.table('bronze', name))} {config.platform_mode}"
        if full or store.properties(table).get("made_from") != origin:
            own = [r for r in rules if r.table == name and not r.measure]
            store.overwrite(table, make(), lambda stored, name=name, own=own: gate(store, own, **{name: stored}), lambda _, __, origin=origin: {"made_from": origin})


def _load_best(store: ParquetStore, raw: DataFrame, high: datetime | None, config: Config, full: bool, generation: str) -> None:
    """Append the rows that are the best of their key so far: of any key, the best row of the table is the best of all bronze."""
    table, source = config.table("silver", "event_best"), cleanse.events_source(config)
    fresh = cleanse.contenders(since(raw, None if full else mark(store, table), high), source)
    notes = lambda _, __: _until(high) | {"generation": generation}
    stamp = F.lit(high).cast("timestamp").alias("_until")
    if full:
        store.overwrite(table, cleanse.settle(fresh.limit(0), fresh, source)[0].select("*", stamp), notes=notes)
    elif mark(store, table) != high:
        store.append(table, cleanse.settle(store.read(table).drop("_until"), fresh, source)[0].select("*", stamp), notes=notes)


def _known(store: ParquetStore, config: Config, low: datetime | None) -> DataFrame:
    """Best rows as they were known when another table's mark stood at ``low``."""
    best = store.read(config.table("silver", "event_best"))
    return (best.limit(0) if low is None else best.where(F.col("_until") <= F.lit(low))).drop("_until")


def _load_events(store: ParquetStore, raw: DataFrame, high: datetime | None, config: Config, full: bool, generation: str) -> None:
    """Append new events; write anew the days of events that a better copy replaces or whose offer or install has changed."""
    table, source = config.table("silver", "events"), cleanse.events_source(config)
    offers, installs = (store.read(config.table("silver", n)) for n in ("offers", "installs"))
    with_now = {n: store.version(config.table("silver", n)) for n in FACTS}
    rules = quality.silver_rules(config.steps) if config.rule_set == "v2" else quality.v1_silver_rules(config.steps)
    own = [r for r in rules if r.table == "events"]
    check = lambda stored: gate(store, own, events=stored, installs=installs, offers=offers)
    token = uuid.uuid4().hex

    def notes(more: list[date]) -> Notes:
        """What moves with the rows: the mark, the dimensions' versions, and dates that gold has yet to make."""

        def of(stored: DataFrame, before: dict[str, str]) -> dict[str, str]:
            waiting = json.loads(before.get("pending", "{}")) | {d.isoformat(): token for d in {*_dates(stored.select("event_date")), *more}}
            return _until(high) | {"generation": generation, "flagged_with": json.dumps(with_now), "pending": json.dumps(waiting, sort_keys=True)}

        return of

    if full:
        # All days wait for gold, those that have lost their last event, too.
        had = _dates(store.read(table).select("event_date")) if store.exists(table) else []
        good, _ = cleanse.cleanse(since(raw, None, high), source)
        store.overwrite(table, flags.flag(good, offers, installs, config), check, notes([*had, *_dates(installs.select("install_date"))]))
        return
    low, old = mark(store, table), store.read(table)
    changed = {n: _changed_since(store, config, n, json.loads(store.properties(table)["flagged_with"]).get(n)) for n in FACTS}
    winners, _ = cleanse.settle(_known(store, config, low), cleanse.contenders(since(raw, low, high), source), source)
    fresh = flags.flag(winners.select(*source.columns), offers, installs, config).persist()
    beaten = old.join(fresh.select("event_id"), "event_id", "left_semi")
    stale = reduce(DataFrame.unionByName, [old.join(keys, FACTS[n][0], "left_semi") for n, (keys, _) in changed.items()]).dropDuplicates(["event_id"]).join(fresh.select("event_id"), "event_id", "left_anti").persist()
    try:
        rewritten = _dates(beaten.select("event_date").union(stale.select("event_date")))
        moved = sorted({*rewritten, *(d for _, dates in changed.values() for d in dates)})
        if not rewritten:
            store.append(table, fresh, check, notes(moved))
            return
        days = sorted({*rewritten, *_dates(fresh.select("event_date"))})
        inside = F.col("event_date").isin(days)
        gone = stale.select("event_id").union(beaten.select("event_id"))
        again = flags.flag(stale.drop(*flags.ADDED), offers, installs, config)
        kept = old.where(inside).join(gone, "event_id", "left_anti")
        store.replace_where(table, kept.unionByName(again).unionByName(fresh), inside, check, notes(moved))
    finally:
        fresh.unpersist()
        stale.unpersist()


def _changed_since(store: ParquetStore, config: Config, name: str, version: int | None) -> tuple[DataFrame, list[date]]:
    """Keys of a dimension that came, went or have other facts since a version, and install dates that this moves."""
    table = config.table("silver", name)
    key, facts = FACTS[name]
    now = store.read(table)
    if version == store.version(table):
        return now.select(key).limit(0), []
    # A version that is gone leaves nothing to compare with: all keys count as changed.
    then = store.read(table, version) if store.readable(table, version) else now.limit(0)
    keys = _changed(then, now, key, facts)
    if name != "installs":
        return keys, []
    return keys, _dates(then.unionByName(now).join(keys, key, "left_semi").select(F.col("install_date").alias("event_date")))


def _changed(before: DataFrame, after: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Keys that came, went, or have other facts."""
    a, b = (df.select(key, F.struct(*facts).alias(side)) for df, side in ((before, "a"), (after, "b")))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def _dates(df: DataFrame) -> list[date]:
    """The distinct dates, in order: as many rows as there are days."""
    return sorted(r[0] for r in df.distinct().collect() if r[0])


def _load_rejects(store: ParquetStore, raw: dict[str, DataFrame], high: datetime | None, config: Config, full: bool, generation: str) -> None:
    """Append what has been rejected since: rows that are wrong, and copies that have lost against a better one.

    Rejects of a dimension are read from what was appended to its raw table, or made anew where that has been rewritten.
    """
    table = config.table("silver", "rejects")
    dimensions = {"offers": cleanse.OFFERS, "installs": cleanse.installs_source(config)}
    at = {n: str(store.version(config.table("bronze", n))) for n in dimensions}
    own = lambda: store.properties(table)
    if full or not store.exists(table) or own().get("generation") != generation:
        notes = lambda _, __: _until(high) | {"generation": generation} | {f"{n}_version": v for n, v in at.items()}
        store.overwrite(table, cleanse.all_rejects(raw | {"events": since(raw["events"], None, high)}, config), notes=notes)
        return
    for name, source in dimensions.items():
        seen = own().get(f"{name}_version")
        if seen == at[name]:
            continue
        note = lambda _, __, name=name: {f"{name}_version": at[name]}
        added = store.added(config.table("bronze", name), int(seen))
        if added is not None:
            store.append(table, cleanse.invalid(added, source), notes=note)
        else:
            store.replace_where(table, cleanse.invalid(raw[name], source), F.col("source") == name, notes=note)
    low, source = mark(store, table), cleanse.events_source(config)
    if low != high:
        arrived = since(raw["events"], low, high)
        _, lost = cleanse.settle(_known(store, config, low), cleanse.contenders(arrived, source), source)
        store.append(table, cleanse.invalid(arrived, source).unionByName(lost), notes=lambda _, __: _until(high))


# -- gold ----------------------------------------------------------------------


def pending(store: ParquetStore, config: Config | None = None) -> dict[date, str]:
    """The dates that gold has yet to make, each with a mark of the load that asked for it last."""
    found = json.loads(store.properties((config or Config()).table("silver", "events")).get("pending", "{}"))
    return {date.fromisoformat(d): token for d, token in found.items()}


def load_gold(store: ParquetStore, touched: list[date] | None = None, config: Config | None = None, full: bool = False) -> tuple[date, date] | None:
    """Make the days anew that waiting dates (or the given ones) and the lookback span, or all; the window.

    Silver must not be empty, and gold's rules hold before it is visible.  A date waits until gold has been made with it: if this
    fails, the next run makes it, and a date that silver has asked for again in the meantime goes on waiting.
    """
    config = config or Config()
    table, gold = config.table("silver", "events"), config.table("gold", "daily_country_platform")
    waiting = pending(store, config)
    silver = {t: store.read(config.table("silver", t)) for t in ("events", "installs", "offers")}
    gate(store, quality.gold_input_rules(), **silver)
    frames = [silver[t] for t in ("events", "installs", "offers")]
    rules = quality.gold_rules(config)

    def check(stored: DataFrame) -> None:
        gate(store, rules, gold=stored, **silver, installed_events=quality.installed_events(silver))

    stamped = lambda df: df.withColumn("_loaded_at", F.current_timestamp())
    dates = sorted(waiting) if touched is None else touched
    span = (min(dates) - timedelta(days=config.lookback_days), max(dates)) if dates else None
    if full or not store.exists(gold):
        store.overwrite(gold, stamped(funnel.aggregate(*frames, config)), check)
        made = waiting
    elif span:
        store.replace_where(gold, stamped(funnel.window(*frames, *span, config)), F.col("date").between(*span), check)
        made = {d: token for d, token in waiting.items() if span[0] <= d <= span[1]}
    else:
        return None
    now = pending(store, config)
    left = {d.isoformat(): token for d, token in now.items() if made.get(d) != token}
    if len(left) < len(now):
        store.set_properties(table, {"pending": json.dumps(left, sort_keys=True)})
    return span


def backfill(store: ParquetStore, config: Config | None = None, full: bool = False, dates: list[str] | None = None) -> tuple[date, date] | None:
    """Silver and gold again; ``dates`` (ISO) name the days to rebuild in place of those that wait."""
    load_silver(store, config, full)
    return load_gold(store, [date.fromisoformat(d) for d in dates] if dates else None, config, full)


# -- order ---------------------------------------------------------------------


@dataclass
class Registry:
    """Named datasets and what each reads; built in dependency order."""

    nodes: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = field(default_factory=dict)

    def dataset(self, name: str, *reads: str) -> Callable:
        """Register a function of the frames it reads."""

        def register(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.nodes:
                raise ValueError(f"{name} is there already")
            self.nodes[name] = (make, reads)
            return make

        return register

    def build(self, given: dict[str, DataFrame], store: ParquetStore | None = None) -> dict[str, DataFrame]:
        """All datasets, lazily, or each written to the store and read back."""
        frames = dict(given)
        for name in TopologicalSorter({n: r for n, (_, r) in self.nodes.items()}).static_order():
            if name in self.nodes:
                make, reads = self.nodes[name]
                df = make(*(frames[r] for r in reads))
                if store:
                    store.overwrite(name, df)
                    df = store.read(name)
                frames[name] = df
        return frames


def standard(config: Config | None = None) -> Registry:
    """Bronze frames to gold as a registry."""
    config = config or Config()
    flow = Registry()
    flow.dataset("silver.offers", "offers")(lambda raw: cleanse.clean_offers(raw)[0])
    flow.dataset("silver.installs", "installs")(lambda raw: cleanse.clean_installs(raw, config)[0])
    flow.dataset("silver.user_profile", "user_profile")(cleanse.clean_user_profile)
    flow.dataset("silver.events", "events", "silver.offers", "silver.installs")(lambda raw, o, i: cleanse.clean_events(raw, o, i, config)[0])
    flow.dataset("silver.rejects", "events", "installs", "offers")(lambda e, i, o: cleanse.all_rejects({"events": e, "installs": i, "offers": o}, config))
    flow.dataset(GOLD, "silver.events", "silver.installs", "silver.offers")(lambda e, i, o: funnel.aggregate(e, i, o, config))
    return flow


def run_pipeline(stages: list[tuple[str, Callable[[dict], object]]], params: dict | None = None, seconds: dict[str, float] | None = None, before: Callable[[], object] | None = None, spark: SparkSession | None = None) -> dict[str, object]:
    """Run stages in turn; each gets the parameters and what earlier stages returned.

    ``before`` (a run of tests, say) must not raise, or no stage writes anything.  A stage that takes longer than its
    ``seconds`` ends the run: its Spark jobs (those of ``spark`` that its thread has begun) are cancelled, and no table that it
    still tries to write becomes visible.
    """
    if before:
        before()
    state: dict = dict(params or {})
    for name, stage in stages:
        limit, tag = (seconds or {}).get(name), f"stage-{uuid.uuid4().hex}"

        def run(stage: Callable[[dict], object] = stage, tag: str = tag) -> object:
            work_for(tag)
            if spark:
                spark.sparkContext.addJobTag(tag)
                spark.sparkContext.setInterruptOnCancel(True)
            return stage(state)

        pool = ThreadPoolExecutor(1)
        task = pool.submit(run)
        try:
            state[name] = task.result(limit)
        except FutureTimeout as e:
            abandon(tag)
            if spark:
                spark.sparkContext.cancelJobsWithTag(tag)
            raise TimeoutError(f"stage {name} took longer than {limit} s") from e
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    return state
