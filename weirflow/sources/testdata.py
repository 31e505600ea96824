"""The funnel's raw tables, derived from a star schema: every column text, anomalies planted by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INGESTED, EARLIER = "2024-03-01 00:00:00", "2024-02-01 00:00:00"
NAMES = {"signup": "app_open", "view": "offer_view", "purchase": "reward_paid", "error": "error"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("_ingested_at", F.lit(INGESTED).cast("timestamp"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with planted anomalies, by the number of the event.

    Retries 90 seconds later (divisible by 34; by 68 with another offer), identical copies (85), late arrivals, unknown names,
    null ids (163), null users (157), unreadable times (151), rewards with a blank offer (purchases divisible by 13).
    """
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.when(F.col("event_type") == "click", F.when(k % 2 == 1, "offer_start").otherwise("goal_reached"))
    for old, new in NAMES.items():
        name = name.when(F.col("event_type") == old, new)
    minutes = k * 10 + F.greatest(k - 90, F.lit(0)) * 960
    n, blank = F.col("event_id"), (F.col("event_type") == "purchase") & (F.col("event_id") % 13 == 0)
    base = load(spark, sf_dir, "events").select(
        n.alias("n"), F.when(n % 157 != 0, F.col("user_id").cast("string")).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), name.alias("event_name"),
        F.when(blank, F.lit(" ")).when(F.col("event_type") != "signup", k.cast("string")).alias("offer_id"), (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=minutes)).alias("ingest"),
    )
    copies = F.array_compact(F.array(F.lit(0), F.when(F.col("n") % 34 == 0, 1), F.when(F.col("n") % 85 == 0, 2)))
    rows = base.withColumn("again", F.explode(copies))
    return _stamped(rows.select(
        F.when(F.col("n") % 163 != 0, F.col("n").cast("string")).alias("event_id"), "user_id", F.when(F.col("n") % 151 == 0, "not a time").otherwise(F.col("ts").cast("string")).alias("event_ts"), "event_name",
        F.when((F.col("again") == 1) & (F.col("n") % 68 == 0), "999999").otherwise(F.col("offer_id")).alias("offer_id"),
        F.when(F.col("again") == 1, F.col("ingest") + F.expr("INTERVAL 90 SECONDS")).otherwise(F.col("ingest")).cast("string").alias("ingest_ts"),
    ))


def delivered_events(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The raw events as CSV files under ``path``, some lines of which don't fit: one field too many (ids divisible by 50), only
    two fields (by 70), a quoted user with a comma and quotes in it (by 60)."""
    from weirflow.sources.bronze import CONTRACT

    names = CONTRACT["events"]
    n = F.col("event_id").cast("bigint")
    fields = {c: F.coalesce(F.col(c), F.lit("")) for c in names}
    quoted = fields | {"user_id": F.concat(F.lit('"'), fields["user_id"], F.lit(', ""x"""'))}
    line = lambda of, many=len(names): F.concat_ws(",", *(of[c] for c in names[:many]))
    row = F.when(n % 50 == 0, F.concat(line(fields), F.lit(",surplus"))).when(n % 70 == 0, line(fields, 2)).when(n % 60 == 0, line(quoted)).otherwise(line(fields))
    raw_events(spark, sf_dir).select(row.alias("value")).write.text(path)
    return path


def raw_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with planted anomalies, by their key.

    Padded lower-case countries (divisible by 25), whole region names (97, invalid), null users (83), unreadable times (89),
    other spellings of the source (3), a second install a day later (41).
    """
    nation = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    key = F.col("c_custkey")
    country = F.when(key % 97 == 0, F.col("r_name")).when(key % 25 == 0, F.concat(F.lit(" "), F.lower(F.substring("r_name", 1, 2)), F.lit(" "))).otherwise(F.substring("r_name", 1, 2))
    device = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "iPhone 15").otherwise(F.col("c_mktsegment"))
    customers = load(spark, sf_dir, "customer").withColumn("second", F.explode(F.array_compact(F.array(F.lit(0), F.when(key % 41 == 0, 1)))))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 20 + F.col("second")).cast("int")).cast("timestamp").cast("string")
    media = F.when(F.col("second") == 1, "Later").when(key % 3 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))).otherwise(F.col("c_mktsegment"))
    return _stamped(customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(key % 83 != 0, key.cast("string")).alias("user_id"), F.when(key % 89 == 0, "yesterday").otherwise(day).alias("install_ts"),
        country.alias("country"), F.when(key % 2 == 0, " iOS ").otherwise("Android").alias("platform"), media.alias("media_source"),
        device.alias("device_model"), F.when(key % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("c"), (key % 7).cast("string"))).alias("campaign_id"),
    ))


def raw_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose key isn't divisible by 10 (events name the others, too), with planted anomalies by what the key leaves over 50.

    Negative payouts (7), unreadable ones (11), payouts of zero (17), null ids (23); keys that leave 3 over 40 have an older
    version with another payout.
    """
    key = F.col("p_partkey")
    parts = load(spark, sf_dir, "part").where("p_partkey % 10 <> 0").withColumn("older", F.explode(F.array_compact(F.array(F.lit(0), F.when(key % 40 == 3, 1)))))
    price = (F.col("p_retailprice").cast("decimal(18,2)") + F.col("older")).cast("decimal(18,2)").cast("string")
    payout = F.when(key % 50 == 7, "-1.00").when(key % 50 == 11, "abc").when(key % 50 == 17, "0.00").otherwise(price)
    stamped = parts.withColumn("_ingested_at", F.when(F.col("older") == 1, F.lit(EARLIER)).otherwise(F.lit(INGESTED)).cast("timestamp"))
    return stamped.select(
        F.when(key % 50 != 23, key.cast("string")).alias("offer_id"), F.concat(F.lit(" "), F.upper("p_type")).alias("offer_category"), F.lit("CPA").alias("payout_type"),
        payout.alias("payout_eur"), "_ingested_at",
    )


def raw_user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their orders."""
    per = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))
    return _stamped(per.select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("n").cast("string").alias("events_lifetime"), F.col("last").cast("string").alias("last_seen_ts"),
        F.col("revenue").cast("string").alias("revenue_30d_eur"), F.when(F.col("o_custkey") % 3 == 0, "Yes").when(F.col("o_custkey") % 3 == 1, " no ").alias("is_payer"),
    ))


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {f.__name__.removeprefix("raw_"): f(spark, sf_dir) for f in (raw_events, raw_installs, raw_offers, raw_user_profile)}
