"""Runs that die between two writes, and increments against full runs."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from weirflow.config import Config
from weirflow.operators import merge
from weirflow.plans import flows, quality
from weirflow.sources import bronze
from weirflow.sources.store import Layout, ParquetStore

CONFIG = Config(as_of=date(2024, 1, 20))
LAYOUTS = {"silver.events": Layout(partition_by=("event_date",)), "silver.rejects": Layout(partition_by=("source",)), flows.GOLD: Layout(partition_by=("date",))}
OFFERS = (("o1", "g", "cpa", "2.50"),)


def e(i, day, offer="o1", at=1, hour=11, user="u1", name="reward_paid"):
    return (f"e{i}", user, f"2024-01-{day:02d} 10:00:00", name, offer, f"2024-01-{day:02d} {hour}:00:00", datetime(2024, 3, at))


def put(store, name, rows, at=1, append=False):
    """Rows into a raw table; events bring their own time of arrival."""
    cols = ", ".join(f"{c} string" for c in bronze.CONTRACT[name]) + ", _ingested_at timestamp"
    df = store.spark.createDataFrame([r if len(r) > len(bronze.CONTRACT[name]) else (*r, datetime(2024, 3, at)) for r in rows], cols)
    (store.append if append else store.overwrite)(f"bronze.{name}", df)


def fill(store, events, offers=OFFERS, installs=(("u1", "2024-01-01 00:00:00", "de", "ios", "m", "iPhone", "c"),)):
    put(store, "offers", offers)
    put(store, "installs", installs)
    put(store, "user_profile", [("u1", "1", "2024-01-01 00:00:00", "1", "yes")])
    put(store, "events", events)


def assert_equal_to_full(store, other):
    """All that ``store`` has come to equals a full run over the same raw tables."""
    for name in bronze.CONTRACT:
        other.overwrite(f"bronze.{name}", store.read(f"bronze.{name}"))
    flows.backfill(other, CONFIG, full=True)
    for table in ("silver.offers", "silver.installs", "silver.events", "silver.rejects", flows.GOLD):
        b = other.read(table).drop("_loaded_at")
        assert merge.multiset_difference(store.read(table).select(*b.columns), b).collect() == [], table
    assert flows.pending(store, CONFIG) == {}


@pytest.fixture(autouse=True)
def plain_plans(spark):
    """Tables of a few rows: plans are run as they are, without compiling each of them."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def stores(spark, tmp_path):
    return ParquetStore(spark, f"file://{tmp_path}/inc", dict(LAYOUTS)), ParquetStore(spark, f"file://{tmp_path}/full")


class Killed(RuntimeError):
    pass


def kill(monkeypatch, store, table, after):
    """Let the next write to a table fail, before or after its rows have become visible."""
    real = ParquetStore._point

    def point(self, name, state):
        if self is store and name == table:
            if after:
                real(self, name, state)
            monkeypatch.setattr(ParquetStore, "_point", real)
            raise Killed(name)
        real(self, name, state)

    monkeypatch.setattr(ParquetStore, "_point", point)


@pytest.mark.parametrize(("table", "after"), [("silver.event_best", True), ("silver.rejects", False)])
def test_a_run_that_dies_is_made_up_for(spark, tmp_path, monkeypatch, table, after):
    store, full = ParquetStore(spark, f"file://{tmp_path}/inc", dict(LAYOUTS)), ParquetStore(spark, f"file://{tmp_path}/full")
    fill(store, [e(1, 2), e(2, 3, "o2"), e(3, 8, user="u2")])
    flows.backfill(store, CONFIG)
    # An offer and an install arrive after their events, a new day, an earlier copy of an event, a wrong row.
    put(store, "offers", [("o2", "g", "cpa", "1.00"), (None, "g", "cpa", "1")], append=True)
    put(store, "installs", [("u2", "2024-01-05 00:00:00", "fr", "ios", "m", "x", "c"), ("u3", "never", "fr", "ios", "m", "x", "c")], append=True)
    put(store, "events", [e(4, 9, at=2), e(1, 2, at=2, hour=10), e(5, 4, at=2, name="nothing")], append=True)
    kill(monkeypatch, store, table, after)
    with pytest.raises(Killed):
        flows.backfill(store, CONFIG)
    put(store, "events", [e(6, 9, at=3), e(4, 9, at=3, hour=12)], append=True)
    flows.backfill(store, CONFIG)
    assert not store.read("silver.events").where("event_id = 'e2' AND is_orphan_offer").count()
    assert {r.date for r in store.read(flows.GOLD).where("events_total > 0").collect()} == {date(2024, 1, d) for d in (2, 3, 8, 9)}
    assert_equal_to_full(store, full)


def test_gold_makes_the_days_that_a_failed_gold_left(stores, monkeypatch):
    store, full = stores
    fill(store, [e(1, 2)])
    flows.backfill(store, CONFIG)
    put(store, "events", [e(2, 8, at=2)], append=True)
    real = quality.gold_rules
    monkeypatch.setattr(quality, "gold_rules", lambda config: [quality.Rule("broken", "gold", "true")])
    with pytest.raises(quality.DQFailure, match="broken"):
        flows.backfill(store, CONFIG)
    monkeypatch.setattr(quality, "gold_rules", real)
    assert set(flows.pending(store)) == {date(2024, 1, 8)}
    assert flows.backfill(store, CONFIG) == (date(2024, 1, 2), date(2024, 1, 8))
    assert flows.backfill(store, CONFIG) is None  # nothing waits any more
    assert {r.date for r in store.read(flows.GOLD).where("events_total > 0").collect()} == {date(2024, 1, 2), date(2024, 1, 8)}


def test_a_date_that_is_asked_for_again_meanwhile_goes_on_waiting(stores, monkeypatch):
    store, _ = stores
    fill(store, [e(1, 2)])
    flows.load_silver(store, CONFIG)
    real = flows.gate

    def meanwhile(s, rules, **tables):
        if "gold" in tables:
            monkeypatch.setattr(flows, "gate", real)
            put(store, "events", [e(2, 2, at=2)], append=True)
            flows.load_silver(store, CONFIG)
        real(s, rules, **tables)

    monkeypatch.setattr(flows, "gate", meanwhile)
    flows.load_gold(store, config=CONFIG)
    assert list(flows.pending(store)) == [date(2024, 1, 2)]
    flows.load_gold(store, config=CONFIG)
    assert flows.pending(store) == {} and store.read(flows.GOLD).where("date = '2024-01-02'").first().events_total == 2


def test_three_increments_equal_a_full_run(stores):
    store, full = stores
    fill(store, [e(1, 2), e(2, 3, "o2"), e(3, 3, hour=12), e(9, 3, name="x")])
    flows.backfill(store, CONFIG)
    # Late copies: one loses, one beats the row that was there and moves it to another day, one comes twice at once.
    put(store, "events", [e(1, 2, at=2, hour=13), e(3, 5, at=2, hour=9), e(4, 5, at=2), e(4, 5, at=2, hour=12), e(None, 5, at=2)], append=True)
    flows.backfill(store, CONFIG)
    put(store, "offers", [("o2", "g", "cpa", "1.00"), ("o1", "g", "cpa", "9.00"), ("", "g", "cpa", "bad")], at=2, append=True)
    put(store, "events", [e(1, 2, at=3, hour=9), e(3, 5, at=3, hour=9), e(5, 6, at=3, user="ghost")], append=True)
    flows.backfill(store, CONFIG)
    assert_equal_to_full(store, full)
    # Appends are taken from what was appended, a raw table that is rewritten from all of it.
    put(store, "offers", OFFERS)
    flows.backfill(store, CONFIG)
    assert store.read("silver.rejects").where("source = 'offers'").count() == 0
    assert_equal_to_full(store, full)


def test_idle_runs_write_nothing_but_checks(stores):
    store, _ = stores
    fill(store, [e(1, 2)])
    flows.backfill(store, CONFIG)
    tables = ("silver.offers", "silver.installs", "silver.user_profile", "silver.event_best", "silver.rejects", flows.GOLD)
    before = {t: store.version(t) for t in tables}
    flows.backfill(store, CONFIG)
    assert {t: store.version(t) for t in tables} == before


def test_dimensions_whose_version_is_gone_flag_all_events_again(stores):
    store, full = stores
    fill(store, [e(1, 2), e(2, 3, "o2")])
    flows.backfill(store, CONFIG)
    put(store, "offers", [("o2", "g", "cpa", "1.00")], append=True)
    flows._load_dimensions(store, {n: store.read(f"bronze.{n}") for n in bronze.CONTRACT}, CONFIG, False)
    assert store.vacuum("silver.offers") == 1 and not store.readable("silver.offers", 1)
    flows.backfill(store, CONFIG)
    assert_equal_to_full(store, full)


def test_gold_input_and_the_gate_on_installs(stores):
    store, _ = stores
    fill(store, [e(1, 2), e(2, 2, user="ghost")])
    with pytest.raises(quality.DQFailure, match="events: user_id not in installs"):
        flows.backfill(store, Config(as_of=CONFIG.as_of, rule_set="v2"))
    assert not store.exists("silver.events")
    flows.load_silver(store, CONFIG)
    store.overwrite("silver.offers", store.read("silver.offers").limit(0))
    with pytest.raises(quality.DQFailure, match="offers: not empty"):
        flows.load_gold(store, config=CONFIG)
    assert not store.exists(flows.GOLD)


def test_tables_are_named_by_the_config(spark, tmp_path):
    store, config = ParquetStore(spark, f"file://{tmp_path}/n"), Config(as_of=CONFIG.as_of, catalog="lake", silver="clean", bronze="raw")
    fill(store, [e(1, 2)])
    for name in bronze.CONTRACT:
        store.overwrite(f"lake.raw.{name}", store.read(f"bronze.{name}"))
    flows.backfill(store, config)
    assert store.exists("lake.clean.events") and store.read("lake.gold.daily_country_platform").count() and not store.exists("silver.events")


# -- windows of partitions ---------------------------------------------------------


def table(spark, days, rows=400):
    return spark.range(days * rows).selectExpr("date_add('2024-01-01', cast(id % {} AS int)) AS day".format(days), "cast(hash(id) % 1000 AS int) AS a", "cast(hash(id, 1) % 1000 AS int) AS b", "id", "repeat('x', 50) AS pad")


def test_replacing_a_window_writes_the_window(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/w", {"t": Layout(partition_by=("day",))})
    store.overwrite("t", table(spark, 20))
    whole = store.detail("t")["bytes"]
    fresh = table(spark, 20).where("day BETWEEN '2024-01-05' AND '2024-01-06' AND day <> '2024-01-06'").withColumn("a", F.lit(-1))
    window = F.col("day").between("2024-01-05", "2024-01-06")
    store.replace_where("t", fresh, window)
    part = store._pointer("t")["parts"][-1]
    written = store._files("t", {"parts": [part], "held": {}})[1]
    assert 0 < written < whole / 10
    got = store.read("t")
    assert got.where(window).select("day", "a").distinct().collect() == [(date(2024, 1, 5), -1)]  # the sixth has vanished
    assert got.count() == 19 * 400 and got.schema == store.read("t", 1).schema and store.read("t", 1).count() == 20 * 400
    with pytest.raises(merge.MergeError):
        store.replace_where("t", table(spark, 20), window)
    assert store.read("t").count() == 19 * 400
    # A predicate that asks for more than partitions rewrites the table, an empty replacement empties the window.
    store.replace_where("t", table(spark, 20).limit(0), F.col("id") < 100)
    assert store.read("t").where("id < 100").count() == 0
    store.replace_where("t", table(spark, 20).limit(0), F.col("day") > "2000-01-01")
    assert store.read("t").count() == 0
    store.append("t", table(spark, 2))
    assert store.read("t").count() == 800


def test_partitions_with_odd_values(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/o", {"t": Layout(partition_by=("k", "n"))})
    rows = [("a b/c=d%", 1, "x"), (None, 2, "y"), ("01", None, "z"), ("é", 3, "w")]
    store.overwrite("t", spark.createDataFrame(rows, "k string, n int, v string"))
    assert sorted(map(str, store.read("t").collect())) == sorted(str(r) for r in spark.createDataFrame(rows, "k string, n int, v string").collect())
    store.replace_where("t", spark.createDataFrame([("01", 7, "new")], "k string, n int, v string"), F.col("k") == "01")
    store.replace_where("t", spark.createDataFrame([], "k string, n int, v string"), F.col("k").isNull())
    assert sorted(r.v for r in store.read("t").collect()) == ["new", "w", "x"]


def touched(df, condition):
    return df.where(condition).select(F.input_file_name()).distinct().count()


def test_compaction_of_a_window_along_a_curve(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    store = ParquetStore(spark, f"file://{tmp_path}/z", {"t": Layout(partition_by=("day",))})
    store.overwrite("t", table(spark, 2, 4000))
    for k in range(3):
        store.append("t", table(spark, 2, 200).withColumn("id", F.col("id") + 10**6 * (k + 1)))
    window = F.col("day") == "2024-01-02"
    before = {r: n for r, n in store.read("t").groupBy(*store.read("t").columns).count().rdd.map(lambda r: (tuple(r[:-1]), r[-1])).collect()}
    outside = store.read("t").where(~window).select(F.input_file_name()).distinct().collect()
    size = store._files("t", {"parts": store._pointer("t")["parts"], "held": {p: [d for d in ds if "01-02" in d] for p, ds in store._pointer("t")["held"].items()}})[1]
    done = store.compact("t", window, ("a", "b"), file_bytes=size // 16)
    assert done["files_before"] >= 4 and done["files_after"] >= 12
    after = {r: n for r, n in store.read("t").groupBy(*store.read("t").columns).count().rdd.map(lambda r: (tuple(r[:-1]), r[-1])).collect()}
    assert before == after
    assert sorted(outside) == sorted(store.read("t").where(~window).select(F.input_file_name()).distinct().collect())
    few = touched(store.read("t").where(window), "a BETWEEN 0 AND 120 AND b BETWEEN 0 AND 120")
    assert few <= done["files_after"] / 3
    assert touched(store.read("t").where(window), "a BETWEEN 0 AND 60") < done["files_after"] * 2 / 3 and touched(store.read("t").where(window), "b BETWEEN 0 AND 60") < done["files_after"] * 2 / 3
    assert store.compact("t", window)["files_after"] == 1
    store.apply_layout("t", Layout())
    assert store.compact("t", z_by=("a",), file_bytes=10**9)["files_after"] == 1 and store.read("t").count() == sum(before.values())
