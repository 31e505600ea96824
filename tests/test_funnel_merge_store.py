from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.config import Config
from weirflow.operators import funnel, merge
from weirflow.plans import flows, governance, issues, quality
from weirflow.sources import bronze
from weirflow.sources.store import Conflict, Layout, ParquetStore
from weirflow.streaming.ingest import Flow, FlowRegistry, ingest, start

S_EV = "user_id string, offer_id string, event_name string, event_date date, is_late boolean, is_pre_install boolean, is_orphan_offer boolean"
S_IN = "user_id string, country string, platform string, install_date date"
S_OF = "offer_id string, payout_eur decimal(18,2)"
D = date(2024, 1, 10)
CONFIG = Config(as_of=date(2024, 1, 20))


def silver(spark, events, installs=(("u1", "DE", "ios", D),), offers=(("o1", Decimal("2.50")),)):
    return spark.createDataFrame(list(events), S_EV), spark.createDataFrame(list(installs), S_IN), spark.createDataFrame(list(offers), S_OF)


def test_reward_cost_and_unpriced(spark):
    (row,) = funnel.aggregate(*silver(spark, [("u1", "o1", "reward_paid", D, False, False, False), ("u1", "zz", "reward_paid", D, True, True, True)]), CONFIG).collect()
    assert (row.reward_payouts, row.reward_cost_eur, row.rewards_unpriced, row.late_events, row.events_pre_install) == (2, Decimal("2.50"), 1, 1, 1)
    assert row.reward_paid_users == 1 and row.installs == 1 and row.is_settled


def test_install_only_days_and_events_without_install(spark):
    rows = funnel.aggregate(*silver(spark, [("ghost", None, "app_open", D, False, False, False)]), CONFIG).collect()
    assert [(r.installs, r.events_total, r.reward_cost_eur) for r in rows] == [(1, 0, Decimal("0.00"))]


def test_window_keeps_users_who_installed_before(spark):
    frames = silver(spark, [("u1", None, "app_open", date(2024, 1, 15), False, False, False)])
    (row,) = funnel.window(*frames, date(2024, 1, 14), date(2024, 1, 16), CONFIG).collect()
    assert (row.installs, row.events_total) == (0, 1)


def test_settled_boundary(spark):
    frames = silver(spark, [], installs=[("a", "DE", "ios", date(2024, 1, 14)), ("b", "DE", "ios", date(2024, 1, 15))])
    assert {r.date.day: r.is_settled for r in funnel.aggregate(*frames, CONFIG).collect()} == {14: True, 15: False}


step = st.sampled_from(["app_open", "offer_view", "offer_start", "goal_reached", "reward_paid"])
event = st.tuples(st.sampled_from(["u1", "u2", "u3"]), st.sampled_from(["o1", "zz", None]), step, st.sampled_from([D, date(2024, 1, 11)]), st.booleans(), st.booleans(), st.booleans())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(event, max_size=30))
def test_two_levels_equal_distinct_counts(spark, events):
    frames = silver(spark, events, installs=[("u1", "DE", "ios", D), ("u2", "DE", "ios", D)])
    assert sorted(funnel.aggregate(*frames, CONFIG).collect()) == sorted(funnel.aggregate_distinct(*frames, CONFIG).collect())


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges(spark):
    t, s = kv(spark, (1, "a"), (2, "b"), (None, "n")), kv(spark, (2, "B"), (3, "C"), (None, "N"))
    assert rows(merge.insert_only(t, s, ["k"])) == [(1, "a"), (2, "b"), (3, "C"), (None, "N"), (None, "n")]
    assert rows(merge.upsert(t, s, ["k"])) == [(1, "a"), (2, "B"), (3, "C"), (None, "N"), (None, "n")]
    assert rows(merge.conditional(t, s, ["k"], lambda a, b: F.col(f"{a}.v") > F.col(f"{b}.v"))) == [(1, "a"), (2, "b"), (3, "C"), (None, "N"), (None, "n")]
    with pytest.raises(merge.MergeError):
        merge.assert_unique(kv(spark, (1, "a"), (1, "b")), ["k"])
    with pytest.raises(merge.MergeError):
        merge.assert_keys(t, ["k"])


def test_store_snapshots_merges_and_care(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    store.overwrite("a.t", kv(spark, (1, "a")))
    store.append("a.t", kv(spark, (2, "b")))
    store.insert_only("a.t", kv(spark, (2, "x"), (3, "c")), ["k"])
    assert rows(store.read("a.t")) == [(1, "a"), (2, "b"), (3, "c")]
    store.insert_only("a.t", kv(spark, (2, "x"), (3, "c")), ["k"])
    assert store.read("a.t").count() == 3
    store.upsert("a.t", kv(spark, (3, "C")), ["k"])
    store.replace_where("a.t", kv(spark, (2, "B")), F.col("k") >= 2)
    assert rows(store.read("a.t")) == [(1, "a"), (2, "B")]
    with pytest.raises(merge.MergeError):
        store.replace_where("a.t", kv(spark, (9, "x")), F.col("k") < 5)
    store.delete_where("a.t", F.col("k") == 1)
    store.delete_where("no.such", F.col("k") == 1)
    store.add_column("a.t", "w", "double")
    assert [tuple(r) for r in store.read("a.t").collect()] == [(2, "B", None)]
    assert store.apply_layout("a.t", Layout(partition_by=("k",))) and not store.apply_layout("a.t", Layout(partition_by=("k",)))
    assert store.detail("a.t")["files"] == 1 and store.vacuum("a.t") > 0 and store.read("a.t").count() == 1
    store.set_properties("a.t", {"comment": "x"})
    assert store.properties("a.t") == {"comment": "x"} and store.health(["a.t"]).count() == 1


def test_two_writers_and_a_check(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    store.overwrite("t", kv(spark, (1, "a")))
    seen = store._pointer("t")
    store.append("t", kv(spark, (2, "b")))
    with pytest.raises(Conflict):  # as one that had read the version before the append
        store._point("t", seen | {"version": seen["version"] + 1})

    def refuse(stored):
        raise quality.DQFailure(str(stored.count()))

    with pytest.raises(quality.DQFailure, match="1"):
        store.overwrite("t", kv(spark, (9, "z")), refuse)
    assert rows(store.read("t")) == [(1, "a"), (2, "b")]
    store.upsert("t", kv(spark, (2, "B")), ["k"])
    store._claim("t", store._pointer("t")["version"])  # a writer dies behind its claim
    with pytest.raises(Conflict):
        store.append("t", kv(spark, (3, "c")))
    store.recover("t")
    store.append("t", kv(spark, (3, "c")))
    assert rows(store.read("t")) == [(1, "a"), (2, "B"), (3, "c")]


def bronze_tables(spark, store, events, offers=(("o1", "g", "cpa", "2.50"),)):
    t0 = datetime(2024, 3, 1)
    put = lambda n, data, cols: store.overwrite(f"bronze.{n}", spark.createDataFrame([(*r, t0) for r in data], ", ".join(f"{c} string" for c in cols) + ", _ingested_at timestamp"))
    put("offers", offers, bronze.CONTRACT["offers"])
    put("installs", [("u1", "2024-01-01 00:00:00", "de", "ios", "m", "iPhone", "c")], bronze.CONTRACT["installs"])
    put("user_profile", [("u1", "1", "2024-01-01 00:00:00", "1", "yes")], bronze.CONTRACT["user_profile"])
    cols = ", ".join(f"{c} string" for c in bronze.CONTRACT["events"]) + ", _ingested_at timestamp"
    store.overwrite("bronze.events", spark.createDataFrame(events, cols))


def test_increments_end_where_a_full_run_does(spark, tmp_path):
    e = lambda i, day, offer="o1", at=1: (f"e{i}", "u1", f"2024-01-{day:02d} 10:00:00", "reward_paid", offer, f"2024-01-{day:02d} 11:00:00", datetime(2024, 3, at))
    one, two = [e(1, 2), e(2, 3, "o2")], [e(3, 4, at=2), e(1, 2, at=2)]
    inc, full = ParquetStore(spark, f"file://{tmp_path}/inc"), ParquetStore(spark, f"file://{tmp_path}/full")
    bronze_tables(spark, inc, one)
    flows.backfill(inc, CONFIG)
    # An offer arrives after its event: the event's flag follows.
    offers = (("o1", "g", "cpa", "2.50"), ("o2", "g", "cpa", "1.00"))
    bronze_tables(spark, inc, one + two, offers)
    flows.backfill(inc, CONFIG)
    bronze_tables(spark, full, one + two, offers)
    flows.backfill(full, CONFIG, full=True)
    for table in ("silver.events", "silver.rejects", flows.GOLD):
        a, b = inc.read(table), full.read(table)
        b = b.drop("_loaded_at")
        assert merge.multiset_difference(a.select(*b.columns), b).count() == 0, table
    before = inc.read(flows.GOLD).count()
    assert flows.load_gold(inc, [date(2024, 1, 3)], CONFIG) and inc.read(flows.GOLD).count() == before
    assert governance.apply(inc) and inc.properties("silver.events")["tag.layer"] == "silver"


def test_gates_keep_bad_tables_out(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/g")
    event = ("e1", "u1", "2024-01-02 10:00:00", "reward_paid", "o1", "2024-01-02 11:00:00", datetime(2024, 3, 1))
    bronze_tables(spark, store, [event])
    assert flows.backfill(store, CONFIG) and mark(store) == datetime(2024, 3, 1)
    # A payout of zero passes cleansing and fails a rule: offers stay as they were, the failure is logged.
    bronze_tables(spark, store, [event], (("o1", "g", "cpa", "2.50"), ("o2", "g", "cpa", "0.00")))
    with pytest.raises(quality.DQFailure, match="payout is not positive"):
        flows.backfill(store, CONFIG)
    assert store.read("silver.offers").count() == 1
    assert store.read(flows.RESULTS).where("rule = 'offers: payout is not positive' AND NOT passed").count() == 1
    # An empty source fails its contract before anything is read from it.
    bronze_tables(spark, store, [event], ())
    with pytest.raises(quality.DQFailure, match="offers: not empty"):
        flows.load_silver(store, CONFIG)


def mark(store):
    return flows.mark(store, "silver.events")


def test_manual_dates_and_stages(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/m")
    bronze_tables(spark, store, [("e1", "u1", "2024-01-02 10:00:00", "reward_paid", "o1", "2024-01-02 11:00:00", datetime(2024, 3, 1))])
    flows.backfill(store, CONFIG)
    assert flows.backfill(store, CONFIG, dates=["2024-01-05"]) == (date(2023, 12, 30), date(2024, 1, 5))
    assert {r.date for r in store.read(flows.GOLD).collect()} == {date(2024, 1, 1), date(2024, 1, 2)}
    assert flows.run_pipeline([("a", lambda s: s["x"] + 1), ("b", lambda s: s["a"] * 2)], {"x": 1}) == {"x": 1, "a": 2, "b": 4}
    done = []
    with pytest.raises(ValueError, match="tests fail"):
        flows.run_pipeline([("a", lambda s: done.append(1))], before=lambda: (_ for _ in ()).throw(ValueError("tests fail")))
    with pytest.raises(TimeoutError, match="a took"):
        flows.run_pipeline([("a", lambda s: __import__("time").sleep(3))], seconds={"a": 0.1})
    assert done == []


def test_streaming_bronze_is_idempotent(spark, tmp_path):
    store, src = ParquetStore(spark, f"file://{tmp_path}/s"), tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("offer_id,offer_category,payout_type,payout_eur\no1,a,b,1\n")
    for _ in range(2):
        ingest(spark, store, "offers", str(src), f"file://{tmp_path}/cp")
    assert store.read("bronze.offers").count() == 1
    (src / "b.csv").write_text("offer_id,offer_category,payout_type,payout_eur\no2,a,b,1\n")
    ingest(spark, store, "offers", str(src), f"file://{tmp_path}/cp")
    assert {r._source for r in store.read("bronze.offers").collect()} == {"offers"} and store.read("bronze.offers").count() == 2
    # A new checkpoint begins its batches at 0 again: what is there stays once, what is new comes in.
    (src / "c.csv").write_text("offer_id,offer_category,payout_type,payout_eur\no3,a,b,1\n")
    ingest(spark, store, "offers", str(src), f"file://{tmp_path}/another")
    assert sorted(r.offer_id for r in store.read("bronze.offers").collect()) == ["o1", "o2", "o3"]
    # A continuous flow goes on until it is stopped.
    query = start(spark, store, "offers", str(src), f"file://{tmp_path}/on", name="bronze.on", processingTime="1 second")
    query.processAllAvailable()
    (src / "d.csv").write_text("offer_id,offer_category,payout_type,payout_eur\no4,a,b,1\no4,z,b,1\n")
    query.processAllAvailable()
    query.stop()
    assert store.read("bronze.on").count() == 5
    for name in ("one", "two"):  # of copies within a batch the same one is kept every time
        ingest(spark, store, "offers", str(src), f"file://{tmp_path}/{name}", "insert_only", f"bronze.{name}")
    assert rows(store.read("bronze.one").select("offer_id", "offer_category")) == rows(store.read("bronze.two").select("offer_id", "offer_category"))
    (src / "d.csv").unlink()
    (src / "c.csv").unlink()
    flow = FlowRegistry(store, f"file://{tmp_path}/flows")
    flow.add(Flow("bronze.again", "once", "offers", str(src), once=True))
    assert flow.run(spark) == ["once"] and flow.run(spark) == []
    assert bronze.read_csv(spark, "offers", str(src)).count() == 2


@pytest.fixture
def tables(spark):
    from weirflow.plans.queries import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    return {n: df.persist() for n, df in t.silver.items()}


@pytest.mark.parametrize(
    ("table", "change", "rule"),
    [
        ("offers", {"payout_eur": "cast(0 AS decimal(18,2))"}, "offers: payout is not positive"),
        ("installs", {"country": "'Germany'"}, "installs: country is no two-letter code"),
        ("installs", {"platform": "'windows'"}, "installs: platform is unknown"),
        ("events", {"event_name": "'explode'"}, "events: event_name is unknown"),
        ("events", {"event_date": "date_add(event_date, 1)"}, "events: date is not the event's"),
        ("events", {"ingest_ts": "cast(NULL AS timestamp)"}, "events: ingest_ts is missing"),
    ],
)
def test_one_bad_row_fails_exactly_its_rule(spark, tables, table, change, rule):
    first = tables[table].limit(1)
    changed = first.selectExpr(*(f"{change.get(c, c)} AS {c}" if c in change else c for c in first.columns)).selectExpr(*(f"'new' AS {c}" if c in ("event_id", "offer_id") and table != "installs" and c == {"events": "event_id", "offers": "offer_id"}[table] else (f"'new' AS {c}" if c == "user_id" and table == "installs" else c) for c in first.columns))
    before = {r.rule: r.violations for r in quality.evaluate(tables, quality.silver_rules()).collect()}
    after = {r.rule: r.violations for r in quality.evaluate(tables | {table: tables[table].unionByName(changed)}, quality.silver_rules()).collect()}
    errors = {r.name for r in quality.silver_rules() if r.severity == "error"} - {"events: user_id not in installs"}
    assert {n for n in errors if after[n] > before[n]} == {rule}


def test_gate_logs_before_it_raises(spark):
    logged = []
    rules = [quality.Rule("dup", "t", unique=("k",)), quality.Rule("broken", "t", "no_such_column > 1")]
    with pytest.raises(quality.DQFailure, match="broken"):
        quality.run_rules({"t": kv(spark, (1, "a"), (1, "b"))}, rules, logged.append)
    assert {r.rule: r.passed for r in logged[0].collect()} == {"dup": False, "broken": False}


def test_expectations(spark):
    df, seen = quality.expect(kv(spark, (1, "a"), (2, None)), {"v": ("v IS NOT NULL", "drop"), "k": ("k > 0", "warn")})
    assert rows(df) == [(1, "a")] and seen.get == {"rows": 2, "v": 1, "k": 0}
    with pytest.raises(Exception, match="expectation k failed"):
        quality.expect(kv(spark, (0, "a")), {"k": ("k > 0", "fail")})[0].collect()


def test_register_opens_and_resolves(spark):
    issue = lambda *keys: spark.createDataFrame([("x", "t", "k", k, None, None, D, None) for k in keys], issues.ISSUE)
    first = issues.update_register(spark.createDataFrame([], issues.REGISTER), issue("a", None), "r1")
    second = {r.key_value: r for r in issues.update_register(first, issue(None, "b"), "r2").collect()}
    assert {k: (r.status, r.first_seen_run, r.last_seen_run) for k, r in second.items()} == {"a": ("resolved", "r1", "r1"), None: ("open", "r1", "r2"), "b": ("open", "r2", "r2")}
    outside = {r.key_value: r.status for r in issues.update_register(first, issue(), "r2", date(2024, 2, 1), date(2024, 2, 2)).collect()}
    assert outside == {"a": "open", None: "open"}
