"""Sketches, alerts, rescued rows, repeated rows in streams, metadata, sizes and stages that are given up."""

import glob
import os
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from weirflow.config import Config
from weirflow.plans import alerts, flows, governance, profile, sketches
from weirflow.session import configure
from weirflow.sources import bronze
from weirflow.sources.store import Abandoned, Layout, ParquetStore
from weirflow.streaming.ingest import ingest


# -- sketches ------------------------------------------------------------------


def test_merged_sketches_stay_within_their_bounds(spark):
    events = spark.range(60_000).selectExpr("date_add('2024-01-01', cast(id % 12 AS int)) AS event_date", "pow(hash(id) % 1000 / 100.0, 3) + (id % 7) AS lag_hours", "concat('u', hash(id, 5) % 9000) AS user_id")
    days = sketches.daily(events)
    spans = spark.createDataFrame([("all", date(2024, 1, 1), date(2024, 1, 12)), ("some", date(2024, 1, 3), date(2024, 1, 5))], "name string, lo date, hi date")
    for r in sketches.checked(events, spans).collect():
        exact = events.where(F.col("event_date").between("2024-01-01" if r.name == "all" else "2024-01-03", "2024-01-12" if r.name == "all" else "2024-01-05"))
        want = exact.agg(F.count("*"), F.round(F.min("lag_hours"), 6), F.round(F.max("lag_hours"), 6), F.count_if(F.col("lag_hours") < 0), F.countDistinct("user_id")).first()
        assert (r.rows, r.min_lag, r.max_lag, r.negative_rows, r.users) == tuple(want) and r.ranks_within and r.users_within
    # Merging days in two steps is merging them at once, but for the sketches' own chance.
    one = sketches.merged(days).first()
    assert one.rows == 60_000 and one.p50 <= one.p90 <= one.p999 <= one.max_lag
    assert 0 < sketches.rank_error() < 0.006
    # A sketch that is too coarse is found out.
    told = sketches.merged(days).first()
    rank = lambda x: events.agg(F.avg((F.col("lag_hours") <= x).cast("int"))).first()[0]
    assert all(abs(rank(told[q]) - p) <= 2 * sketches.rank_error() for q, p in sketches.QUANTILES.items())


# -- alerts --------------------------------------------------------------------


def results(spark, run, **rules):
    return spark.createDataFrame([(rule, "t", "error", float(not ok), ok, None, datetime(2024, 1, run)) for rule, ok in rules.items()], "rule string, table_name string, severity string, violations double, passed boolean, error string, run_ts timestamp")


def test_an_alert_opens_once_and_closes_once(spark, tmp_path):
    store, sent = ParquetStore(spark, f"file://{tmp_path}/a"), []
    assert alerts.alert(store, sent.append) == []
    for run, rules in enumerate(({"a": True, "b": True}, {"a": False, "b": True}, {"a": False}, {"a": True, "b": True}, {"a": True, "b": False}), 1):
        store.append("dq.results", results(spark, run, **rules))
        alerts.alert(store, sent.append)
        alerts.alert(store, sent.append)  # nothing new: nothing is sent
    assert [[(m["rule"], m["change"], m["run_ts"].day) for m in call] for call in sent] == [[("a", "opened", 2)], [("a", "closed", 4)], [("b", "opened", 5)]]
    store.append("dq.results", results(spark, 6, b=True))

    def broken(_):
        raise OSError("no network")

    with pytest.raises(OSError):
        alerts.alert(store, broken)
    assert [m["change"] for m in alerts.alert(store, sent.append)] == ["closed"]


def test_several_runs_at_once_tell_every_change(spark):
    runs = results(spark, 1, a=False).unionByName(results(spark, 2, a=True)).unionByName(results(spark, 2, a=False)).unionByName(results(spark, 3, a=True))
    messages, state = alerts.transitions(runs, spark.createDataFrame([("a", False, None), ("z", True, datetime(2023, 1, 1))], alerts.STATE))
    assert sorted((r.rule, r.change, r.run_ts.day) for r in messages.collect()) == [("a", "closed", 3), ("a", "opened", 1)]
    assert {r.rule: (r.failing, r.since) for r in state.collect()} == {"a": (False, datetime(2024, 1, 3)), "z": (True, datetime(2023, 1, 1))}


# -- files that come in ----------------------------------------------------------

HEADER = "offer_id,offer_category,payout_type,payout_eur\n"


def test_lines_that_do_not_fit_are_rescued(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(HEADER + 'o1,"games, ""big"" ones",cpa,1\no2,x\no3,x,cpa,1,more\n\no4,"open quote,cpa,1\n')
    batch = bronze.read_csv(spark, "offers", str(src), rescue=True)
    rows = {r.offer_id: (r.offer_category, r._rescued_data) for r in batch.collect()}
    assert rows["o1"] == ('games, "big" ones', None) and rows["o2"] == ("x", "o2,x") and rows["o3"] == ("x", "o3,x,cpa,1,more") and rows["o4"][1]
    assert batch.where("_rescued_data IS NOT NULL").count() == 3 and batch.select("_rescued_data").where("_rescued_data IS NOT NULL").count() == 3
    store = ParquetStore(spark, f"file://{tmp_path}/s")
    ingest(spark, store, "offers", str(src), f"file://{tmp_path}/cp", rescue=True)
    assert {r.offer_id: r._rescued_data for r in store.read("bronze.offers").collect()} == {k: v[1] for k, v in rows.items()}


def test_repeated_rows_are_dropped_whatever_the_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [["o1,a,b,1", "o2,a,b,1", "o1,a,b,1"], ["o2,a,b,1", "o3,a,b,"], ["o3,a,b,", "o1,a,b,2", "o4,,,"], ["o4,,,", "o5,a,b,1"]]
    put = lambda k: (src / f"{k}.csv").write_text(HEADER + "\n".join(lines[k]) + "\n")
    want = sorted({line for part in lines for line in part})
    got = {}
    for k in range(3):
        put(k)
    for files in (1, 2, None):
        store = ParquetStore(spark, f"file://{tmp_path}/s{files}")
        ingest(spark, store, "offers", str(src), f"file://{tmp_path}/c{files}", within="2 days", files_per_batch=files)
        got[files] = store
    put(3)  # a restart remembers the rows of earlier batches
    for files, store in got.items():
        ingest(spark, store, "offers", str(src), f"file://{tmp_path}/c{files}", within="2 days", files_per_batch=files)
        cols = bronze.CONTRACT["offers"]
        assert sorted(",".join(r[c] or "" for c in cols) for r in store.read("bronze.offers").collect()) == want, files


def test_a_replayed_batch_keeps_the_same_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(HEADER + "".join(f"o1,{c},b,1\n" for c in "zyxwvutsrqponmlkjihgfedcba"))
    kept = set()
    for k in range(4):
        store = ParquetStore(spark, f"file://{tmp_path}/s{k}")
        ingest(spark, store, "offers", str(src), f"file://{tmp_path}/c{k}", "insert_only")
        kept |= {r.offer_category for r in store.read("bronze.offers").collect()}
    assert len(kept) == 1


# -- metadata, sizes, settings -----------------------------------------------------


def test_stored_metadata_is_held_against_the_manifest(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/g")
    store.overwrite("silver.events", spark.createDataFrame([("e", "u", True)], "event_id string, user_id string, is_late boolean"))
    assert {r.state for r in governance.drift(store).collect()} == {"missing"}
    assert governance.apply(store) == ["silver.events"] and governance.drift(store).count() == 0
    assert store.read("silver.events").schema["is_late"].metadata["comment"].startswith("arrived after")
    state = store._pointer("silver.events")
    store._point("silver.events", state | {"version": state["version"] + 1, "properties": {k: v for k, v in state["properties"].items() if k != "tag.layer"} | {"comment": "another", "tag.owner": "me"}})
    assert {(r.kind, r.name, r.state) for r in governance.drift(store).collect()} == {("tag", "layer", "missing"), ("comment", "", "differs"), ("tag", "owner", "undeclared")}
    # A new snapshot loses what was said of its columns, and that is found.
    store.overwrite("silver.events", store.read("silver.events").select("event_id", "user_id", F.col("is_late").alias("is_late", metadata={})))
    assert ("column_comment", "is_late", "missing") in {(r.kind, r.name, r.state) for r in governance.drift(store).collect()}


def test_sizes_are_those_of_the_files(spark, tmp_path):
    spark.range(5000).selectExpr("id", "date_add('2024-01-01', cast(id % 10 AS int)) AS d").repartition(3).write.parquet(str(tmp_path / "t"))
    files = glob.glob(str(tmp_path / "t" / "*.parquet"))
    size = sum(map(os.path.getsize, files))
    (r,) = profile.physical_sizing({"t": (spark.read.parquet(str(tmp_path / "t")), "d")}).collect()
    assert (r.table_name, r.files, r.bytes, r.rows, r.days, r.layout) == ("t", 3, size, 5000, 10, "cluster")
    assert r.bytes_per_row == round(size / 5000, 2) and r.mb_per_day == round(size / 10 / 2**20, 3)
    assert profile.physical_sizing({"t": (spark.read.parquet(str(tmp_path / "t")), "d")}, at_least=1).first().layout == "partition"


def test_helpers(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    assert [tuple(r) for r in bronze.union_sources([a, b]).orderBy("k").collect()] == [(1, "x"), (2, None)]
    filled = bronze.backfill_ingested(spark.createDataFrame([(None,), (datetime(2024, 1, 1),)], "_ingested_at timestamp"), "2020-01-01 00:00:00")
    assert sorted(r[0].year for r in filled.collect()) == [2020, 2024] and bronze.backfill_ingested(a, "2020-01-01").first()._ingested_at.year == 2020
    report = {r.setting: r.applied for r in configure(spark, Config(), {"spark.no.such": "1", "spark.executor.cores": "1"}).collect()}
    assert report["spark.sql.session.timeZone"] and len(report) >= 9
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    store = ParquetStore(spark, f"file://{tmp_path}/c", {"t": Layout(cluster_by=("k",))})
    store.overwrite("t", spark.range(100).selectExpr("cast(id AS int) AS k"))
    assert store.read("t").count() == 100 and profile.rows_per_file(spark.createDataFrame([("a/b.csv",), ("c/b.csv",)], "_source_file string").select("_source_file")).first().rows == 2


# -- stages that take too long -----------------------------------------------------


def test_nothing_becomes_visible_after_a_timeout(spark, tmp_path):
    store, seen = ParquetStore(spark, f"file://{tmp_path}/t"), []
    store.overwrite("t", spark.range(1))

    def slow(_):
        try:
            slowly = F.udf(lambda x: time.sleep(0.2) or x, "long")
            spark.range(400).select(slowly("id").alias("id")).write.format("noop").mode("overwrite").save()
            seen.append("finished")
        except Exception as e:  # the cancelled job
            seen.append(type(e).__name__)
        try:
            store.append("t", spark.range(5))
        except Abandoned:
            seen.append("refused")

    began = time.time()
    with pytest.raises(TimeoutError, match="slow took"):
        flows.run_pipeline([("slow", slow)], seconds={"slow": 3}, spark=spark)
    assert time.time() - began < 15
    for _ in range(300):
        if "refused" in seen:
            break
        time.sleep(0.1)
    assert "finished" not in seen and seen[-1] == "refused" and store.read("t").count() == 1
    store.append("t", spark.range(1))  # other threads go on
    assert store.read("t").count() == 2
