"""Governance as a manifest: tags, comments, personal columns, grants, constraints."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.sources.store import ParquetStore


@dataclass(frozen=True)
class TablePolicy:
    """What is declared about one table."""

    table: str
    comment: str
    tags: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)  #: comments
    personal: tuple[str, ...] = ()  #: columns with personal data
    grants: tuple[tuple[str, str], ...] = ()  #: (role, privilege)
    checks: dict[str, str] = field(default_factory=dict)  #: constraint name -> condition
    key: tuple[str, ...] = ()


ROLES = {"engineer": ("SELECT", "MODIFY"), "analyst": ("SELECT",), "steward": ("SELECT", "APPLY TAG")}


def _grants(*roles: str) -> tuple[tuple[str, str], ...]:
    return tuple((r, p) for r in roles for p in ROLES[r])


MANIFEST = (
    *(TablePolicy(f"bronze.{s}", f"Raw {s} as delivered, all text", {"layer": "bronze", "quality": "raw"}, personal=p, grants=_grants("engineer"))
      for s, p in (("events", ("user_id",)), ("installs", ("user_id", "device_model")), ("offers", ()), ("user_profile", ("user_id", "revenue_30d_eur")))),
    TablePolicy("silver.events", "Clean events, flagged, one per event_id", {"layer": "silver", "quality": "validated"}, {"is_late": "arrived after 00:15 of the next day"}, ("user_id",),
                _grants("engineer", "analyst", "steward"), {"event_name_known": "event_name IN ('app_open', 'offer_view', 'offer_start', 'goal_reached', 'reward_paid')"}, ("event_id",)),
    TablePolicy("silver.installs", "First valid install per user", {"layer": "silver", "quality": "validated"}, {}, ("user_id", "device_model"),
                _grants("engineer", "analyst", "steward"), {"country_iso": "country RLIKE '^[A-Z]{2}$'", "platform_known": "platform IN ('android', 'ios')"}, ("user_id",)),
    TablePolicy("silver.offers", "Latest valid version of each offer", {"layer": "silver", "quality": "validated"}, {}, (), _grants("engineer", "analyst", "steward"), {"payout_not_negative": "payout_eur >= 0"}, ("offer_id",)),
    TablePolicy("silver.user_profile", "Latest profile per user, reference only", {"layer": "silver", "quality": "validated"}, {}, ("user_id", "revenue_30d_eur"), _grants("engineer", "steward"), {}, ("user_id",)),
    TablePolicy("silver.rejects", "Rows that did not pass, with reason and payload", {"layer": "silver", "quality": "quarantine"}, {}, ("raw_record",), _grants("engineer", "steward")),
    TablePolicy("gold.daily_country_platform", "Funnel per date, country and platform", {"layer": "gold", "quality": "certified"}, {"is_settled": "no late event can change the day any more"}, (),
                _grants("engineer", "analyst"), {"installs_not_negative": "installs >= 0"}, ("date", "country", "platform")),
)


def manifest_frame(spark: SparkSession, manifest: tuple[TablePolicy, ...] = MANIFEST) -> DataFrame:
    """Everything declared, as rows (table_name, kind, name, value)."""
    rows: list[tuple[str, str, str, str]] = []
    for p in manifest:
        rows.append((p.table, "comment", "", p.comment))
        rows += [(p.table, "tag", k, v) for k, v in p.tags.items()]
        rows += [(p.table, "column_comment", k, v) for k, v in p.columns.items()]
        rows += [(p.table, "personal", c, "true") for c in p.personal]
        rows += [(p.table, "grant", role, privilege) for role, privilege in p.grants]
        rows += [(p.table, "check", k, v) for k, v in p.checks.items()]
        rows += [(p.table, "key", c, str(i)) for i, c in enumerate(p.key)]
    return spark.createDataFrame(rows, "table_name string, kind string, name string, value string")


def apply(store: ParquetStore, manifest: tuple[TablePolicy, ...] = MANIFEST) -> list[str]:
    """Write comments and tags into the properties of the tables that are there; which ones."""
    done = []
    for p in manifest:
        if store.exists(p.table):
            store.describe(p.table, {c: {"comment": text} for c, text in p.columns.items()})
            store.set_properties(p.table, {"comment": p.comment, **{f"tag.{k}": v for k, v in p.tags.items()}, **{f"personal.{c}": "true" for c in p.personal}})
            done.append(p.table)
    return done


def found(store: ParquetStore, tables: tuple[str, ...] | None = None) -> DataFrame:
    """What stored tables say of themselves, as rows like the manifest's: their properties, and the metadata of their columns."""
    rows: list[tuple[str, str, str, str]] = []
    for table in tables or tuple(p.table for p in MANIFEST):
        if not store.exists(table):
            continue
        for key, value in store.properties(table).items():
            kind, _, name = key.partition(".")
            if key == "comment":
                rows.append((table, "comment", "", value))
            elif kind in ("tag", "personal"):
                rows.append((table, kind, name, value))
        rows += [(table, "column_comment", f.name, f.metadata["comment"]) for f in store.read(table).schema.fields if "comment" in f.metadata]
    return store.spark.createDataFrame(rows, "table_name string, kind string, name string, value string")


def drift(store: ParquetStore, manifest: tuple[TablePolicy, ...] = MANIFEST) -> DataFrame:
    """(table_name, kind, name, declared, stored, state): where stored tables and the manifest disagree.

    Of tables that are there, what is declared and can be stored (comments, tags, personal columns) must be found as it is
    declared, and nothing else.
    """
    there = [p.table for p in manifest if store.exists(p.table)]
    keys = ["table_name", "kind", "name"]
    wanted = manifest_frame(store.spark, manifest).where(F.col("table_name").isin(there) & F.col("kind").isin("comment", "tag", "personal", "column_comment"))
    both = wanted.withColumnRenamed("value", "declared").join(found(store, tuple(there)).withColumnRenamed("value", "stored"), keys, "full_outer")
    state = F.when(F.col("stored").isNull(), "missing").when(F.col("declared").isNull(), "undeclared").otherwise("differs")
    return both.where(~F.col("declared").eqNullSafe(F.col("stored"))).withColumn("state", state)


def exposure(tables: dict[str, DataFrame], manifest: tuple[TablePolicy, ...] = MANIFEST) -> DataFrame:
    """(table_name, column_name, readers, values): values of personal columns that are there, and how many roles may read them."""
    parts = []
    for p in manifest:
        own = [c for c in p.personal if p.table in tables]
        if own:
            readers = len({role for role, privilege in p.grants if privilege == "SELECT"})
            counted = tables[p.table].agg(*(F.count(F.col(c)).alias(c) for c in own)).unpivot([], own, "column_name", "values")
            parts.append(counted.select(F.lit(p.table).alias("table_name"), "column_name", F.lit(readers).alias("readers"), "values"))
    return reduce(DataFrame.unionByName, parts)


def annotate(df: DataFrame, policy: TablePolicy) -> DataFrame:
    """Column comments and personal-data marks as column metadata."""
    out = df
    for c in df.columns:
        meta = ({"comment": policy.columns[c]} if c in policy.columns else {}) | ({"personal": True} if c in policy.personal else {})
        if meta:
            out = out.withMetadata(c, meta)
    return out


def violations(df: DataFrame, policy: TablePolicy) -> DataFrame:
    """(constraint, violations): checks and null keys in one aggregate, repeated keys in another."""
    checks = policy.checks | {f"{c}_not_null": f"`{c}` IS NOT NULL" for c in policy.key}
    names = list(checks)
    counted = df.agg(*(F.count_if(~F.expr(checks[n])).alias(n) for n in names)).unpivot([], names, "constraint", "violations")
    if policy.key:
        repeated = df.groupBy(*policy.key).count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit("primary_key").alias("constraint"), "violations")
        counted = counted.unionByName(repeated)
    return counted
