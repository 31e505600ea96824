"""Data-quality rules, generated from declared facts about tables and compiled into few passes.

All row rules of a table are one aggregate, each uniqueness rule is one, and all
totals that gold shares with other tables are one aggregate per table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weirflow.config import PLATFORMS, STEPS, Config
from weirflow.operators import funnel


class DQFailure(RuntimeError):
    """An error-severity rule found violations."""


@dataclass(frozen=True)
class Rule:
    """Exactly one of: ``bad`` (SQL of a violating row), ``unique`` (keys), ``total`` (sum over the table, other table, sum over that), ``measure`` (tables -> frame with column violations)."""

    name: str
    table: str
    bad: str | None = None
    unique: tuple[str, ...] = ()
    total: tuple[str, str, str] | None = None
    measure: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    severity: str = "error"


@dataclass(frozen=True)
class Facts:
    """What must hold of a table."""

    table: str
    key: tuple[str, ...]
    present: tuple[str, ...] = ()
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)  #: column -> values
    never: dict[str, str] = field(default_factory=dict)  #: what must not be -> SQL of a row that is it
    watched: dict[str, str] = field(default_factory=dict)  #: as ``never``, for warnings
    matched: tuple[tuple[str, str, str], ...] = ()  #: (other table, column, severity): every value is there, too

    def rules(self) -> list[Rule]:
        """The facts as rules."""
        t = self.table
        out = [Rule(f"{t}: one row per {', '.join(self.key)}", t, unique=self.key)]
        out += [Rule(f"{t}: {c} is missing", t, f"{c} IS NULL") for c in self.present]
        out += [Rule(f"{t}: {c} is unknown", t, f"NOT coalesce({c} IN ({_listed(values)}), false)") for c, values in self.known.items()]
        out += [Rule(f"{t}: {name}", t, bad) for name, bad in self.never.items()]
        out += [Rule(f"{t}: {name}", t, bad, severity="warning") for name, bad in self.watched.items()]
        return out + [Rule(f"{t}: {c} not in {other}", t, measure=_missing(t, other, c), severity=severity) for other, c, severity in self.matched]


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _missing(left: str, right: str, key: str) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Rows of a table without counterpart."""
    return lambda t: t[left].join(t[right].select(key).distinct(), key, "left_anti").agg(F.count("*").cast("double").alias("violations"))


def silver_facts(steps: tuple[str, ...] = STEPS) -> list[Facts]:
    """What must hold of the silver tables."""
    return [
        Facts("offers", ("offer_id",), ("offer_id",), never={"payout is not positive": "payout_eur IS NULL OR payout_eur <= 0"}),
        Facts(
            "installs", ("user_id",), ("user_id", "install_ts"), {"platform": PLATFORMS}, {"country is no two-letter code": "NOT coalesce(country RLIKE '^[A-Z]{2}$', false)"},
            matched=(("events", "user_id", "warning"),),
        ),
        Facts(
            "events", ("event_id",), ("event_id", "user_id", "event_ts", "ingest_ts"), {"event_name": steps}, {"date is not the event's": "event_date <> to_date(event_ts)"},
            {"late": "is_late", "before the install": "is_pre_install", "offer is an orphan": "is_orphan_offer", "arrives before it happens": "lag_hours < 0"},
            (("installs", "user_id", "error"),),
        ),
        Facts("user_profile", ("user_id",), ("user_id",)),
    ]


#: Rules of the first generation of the flow leave these out.
LATER = ("events: ingest_ts is missing", "events: date is not the event's", "events: arrives before it happens", "events: user_id not in installs")


def silver_rules(steps: tuple[str, ...] = STEPS) -> list[Rule]:
    """All rules of the silver tables."""
    return [r for facts in silver_facts(steps) for r in facts.rules()]


def v1_silver_rules(steps: tuple[str, ...] = STEPS) -> list[Rule]:
    """13 error rules and 4 warnings: without those on arrival, dates and users of events."""
    return [r for r in silver_rules(steps) if r.name not in LATER]


def installed_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Events of installed users with their payout, found otherwise than gold finds them: by semi-join, then by the catalog's prices."""
    priced = tables["offers"].groupBy("offer_id").agg(F.max("payout_eur").alias("payout_eur"))
    return tables["events"].join(tables["installs"].select("user_id"), "user_id", "left_semi").join(priced, "offer_id", "left")


def _recompute(config: Config) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Grains whose rows differ between gold and gold computed again, by one full join."""

    def measure(t: dict[str, DataFrame]) -> DataFrame:
        again = funnel.aggregate_distinct(t["events"], t["installs"], t["offers"], config)
        values = [c for c in again.columns if c not in (*funnel.GRAIN, "is_settled")]
        a = t["gold"].select(*funnel.GRAIN, F.struct(*values).alias("a"))
        b = again.select(*funnel.GRAIN, F.struct(*values).alias("b"))
        return a.join(b, list(funnel.GRAIN), "full_outer").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).cast("double").alias("violations"))

    return measure


def part_of(config: Config) -> dict[str, str]:
    """Which number of gold counts a part of what another one counts: no part is larger than its whole."""
    rewards = {"rewards_unpriced": "reward_payouts", f"{config.steps[-1]}_users": "reward_payouts"}
    events = {c: "events_total" for c in ("late_events", "events_pre_install", "reward_payouts", *(f"{s}_users" for s in config.steps[:-1]))}
    return rewards | events


def gold_facts(config: Config) -> Facts:
    """What must hold of gold's rows by themselves."""
    numbers = [*funnel.counts(config), "reward_cost_eur"]
    return Facts(
        "gold", funnel.GRAIN, never={
            "part of the grain is missing": " OR ".join(f"{c} IS NULL" for c in funnel.GRAIN),
            "a number is negative": " OR ".join(f"{c} < 0" for c in numbers),
            **{f"{part} exceeds {all_of_it}": f"{part} > {all_of_it}" for part, all_of_it in part_of(config).items()},
        },
    )


def gold_rules(config: Config | None = None) -> list[Rule]:
    """Grain, signs, parts within their wholes, totals recomputed from silver, the whole table recomputed.

    ``tables`` has ``installed_events`` beside the silver tables, see :func:`installed_events`.
    """
    config = config or Config()
    reward = "event_name = 'reward_paid'"
    totals = {
        "installs": ("installs", "count(*)"), "events_total": ("installed_events", "count(*)"), "reward_payouts": ("installed_events", f"count_if({reward})"),
        "reward_cost_eur": ("installed_events", f"sum(CASE WHEN {reward} THEN payout_eur END)"), "rewards_unpriced": ("installed_events", f"count_if({reward} AND payout_eur IS NULL)"),
        "late_events": ("installed_events", "count_if(is_late)"), "events_pre_install": ("installed_events", "count_if(is_pre_install)"),
    }
    out = gold_facts(config).rules()
    out += [Rule(f"gold: {c} adds up as in {table}", "gold", total=(f"sum({c})", table, again)) for c, (table, again) in totals.items()]
    return [*out, Rule("gold: equals gold computed again", "gold", measure=_recompute(config))]


def contract_rules(contract: dict[str, tuple[str, ...]], tables: dict[str, DataFrame]) -> list[Rule]:
    """Per source: required columns, not empty, rescued rows (a warning)."""
    out = []
    for source, columns in contract.items():
        missing = float(len(set(columns) - set(tables[source].columns)))
        out.append(Rule(f"{source}: required columns", source, measure=lambda t, s=source, m=missing: t[s].agg(F.lit(m).alias("violations"))))
        out.append(not_empty(source))
        rescued = "_rescued_data IS NOT NULL" if "_rescued_data" in tables[source].columns else "false"
        out.append(Rule(f"{source}: rescued rows", source, rescued, severity="warning"))
    return out


def not_empty(table: str) -> Rule:
    return Rule(f"{table}: not empty", table, measure=lambda t: t[table].agg((F.count("*") == 0).cast("double").alias("violations")))


def gold_input_rules() -> list[Rule]:
    """What gold is made of must not be empty."""
    return [not_empty(t) for t in ("events", "installs", "offers")]


def evaluate(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(rule, table_name, severity, violations, passed), lazily: one aggregate per table, one per uniqueness and measure.

    A total's violations are the difference of the two sums.
    """
    parts = _totals(tables, [r for r in rules if r.total])
    row_rules: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.bad:
            row_rules.setdefault(rule.table, []).append(rule)
    for table, group in row_rules.items():
        counted = tables[table].agg(*(F.count_if(F.expr(r.bad)).cast("double").alias(f"_{i}") for i, r in enumerate(group)))
        stacked = ", ".join(f"struct('{_sql(r.name)}' AS rule, '{r.severity}' AS severity, _{i} AS violations)" for i, r in enumerate(group))
        parts.append(counted.selectExpr(f"inline(array({stacked}))").withColumn("table_name", F.lit(table)))
    for rule in rules:
        if rule.unique:
            found = tables[rule.table].groupBy(*rule.unique).count().agg(F.count_if(F.col("count") > 1).cast("double").alias("violations"))
        elif rule.measure:
            found = rule.measure(tables)
        else:
            continue
        parts.append(found.select(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), "violations", F.lit(rule.table).alias("table_name")))
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.select("rule", "table_name", "severity", "violations", (F.col("violations") == 0).alias("passed"))


def _totals(tables: dict[str, DataFrame], rules: list[Rule]) -> list[DataFrame]:
    """All totals: each table is summed once, and the two sums of a rule meet as rows."""
    sums: dict[str, list[tuple[Rule, str, int]]] = {}
    for r in rules:
        own, other, again = r.total
        sums.setdefault(r.table, []).append((r, own, 1))
        sums.setdefault(other, []).append((r, again, -1))
    sides = []
    for table, group in sums.items():
        summed = tables[table].agg(*(F.expr(f"coalesce(cast({e} AS double), 0D)").alias(f"_{i}") for i, (_, e, _) in enumerate(group)))
        stacked = ", ".join(f"struct('{_sql(r.name)}' AS rule, '{r.severity}' AS severity, '{r.table}' AS table_name, {sign}D * _{i} AS part)" for i, (r, _, sign) in enumerate(group))
        sides.append(summed.selectExpr(f"inline(array({stacked}))"))
    if not sides:
        return []
    return [reduce(DataFrame.unionByName, sides).groupBy("rule", "severity", "table_name").agg(F.abs(F.sum("part")).alias("violations"))]


def _sql(text: str) -> str:
    return text.replace("'", "\\'")


def run_rules(tables: dict[str, DataFrame], rules: list[Rule], log: Callable[[DataFrame], None] | None = None) -> list[dict]:
    """Evaluate all, log all, and only then raise; a rule that throws has failed.

    If any rule throws, all are evaluated again one by one to find out which: rules belong on stored tables.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = "rule string, table_name string, severity string, violations double, passed boolean, error string"
    try:
        rows = [(*r, None) for r in evaluate(tables, rules).collect()]  # a row per rule
    except Exception:
        rows = []
        for rule in rules:
            try:
                rows += [(*r, None) for r in evaluate(tables, [rule]).collect()]
            except Exception as e:  # whatever a rule throws is its failure, to be logged with the others
                rows.append((rule.name, rule.table, rule.severity, None, False, str(e)[:500]))
    if log:
        log(spark.createDataFrame(rows, schema))
    out = [dict(zip(("rule", "table_name", "severity", "violations", "passed", "error"), r, strict=True)) for r in rows]
    if failed := [r["rule"] for r in out if r["severity"] == "error" and not r["passed"]]:
        raise DQFailure(", ".join(failed))
    return out


def windowed(tables: dict[str, DataFrame], dates: dict[str, str], lo: date, hi: date) -> dict[str, DataFrame]:
    """The tables restricted to a window by their date columns."""
    return {n: df.where(F.col(dates[n]).between(lo, hi)) if n in dates else df for n, df in tables.items()}


# -- expectations --------------------------------------------------------------

#: Expectations on silver and gold tables as (table, rule, severity, condition).
PASS_RULES = [
    ("silver_offers", "offer_id_not_null", "error", "offer_id IS NOT NULL"),
    ("silver_offers", "payout_eur_positive", "error", "payout_eur IS NOT NULL AND payout_eur > 0"),
    ("silver_installs", "user_id_not_null", "error", "user_id IS NOT NULL"),
    ("silver_installs", "install_ts_not_null", "error", "install_ts IS NOT NULL"),
    ("silver_installs", "country_valid", "error", "country IS NOT NULL AND LENGTH(country) = 2"),
    ("silver_installs", "platform_valid", "error", "platform IN ('android', 'ios')"),
    ("silver_events", "event_id_not_null", "error", "event_id IS NOT NULL"),
    ("silver_events", "user_id_not_null", "error", "user_id IS NOT NULL"),
    ("silver_events", "event_ts_not_null", "error", "event_ts IS NOT NULL"),
    ("silver_events", "ingest_ts_not_null", "error", "ingest_ts IS NOT NULL"),
    ("silver_events", "event_name_valid", "error", f"event_name IN ({_listed(STEPS)})"),
    ("silver_events", "is_late", "warn", "is_late = false"),
    ("silver_events", "is_pre_install", "warn", "is_pre_install = false"),
    ("silver_events", "is_orphan_offer", "warn", "is_orphan_offer = false"),
    ("silver_user_profile", "user_id_not_null", "error", "user_id IS NOT NULL"),
    ("gold_daily_country_platform", "date_not_null", "error", "date IS NOT NULL"),
    ("gold_daily_country_platform", "country_not_null", "error", "country IS NOT NULL"),
    ("gold_daily_country_platform", "platform_not_null", "error", "platform IS NOT NULL"),
    ("gold_daily_country_platform", "installs_non_negative", "error", "installs >= 0"),
    ("gold_daily_country_platform", "events_total_non_negative", "error", "events_total >= 0"),
]


#: Expectations that go with the tables' definitions, as table -> name -> (condition, action).
EXPECTATIONS = {
    "silver_events": {
        "event_id_not_null": ("event_id IS NOT NULL", "drop"),
        "user_id_not_null": ("user_id IS NOT NULL", "drop"),
        "event_ts_not_null": ("event_ts IS NOT NULL", "drop"),
        "ingest_ts_not_null": ("ingest_ts IS NOT NULL", "drop"),
        "event_name_valid": (f"event_name IN ({_listed(STEPS)})", "warn"),
    },
    "silver_user_profile": {"user_id_not_null": ("user_id IS NOT NULL", "drop")},
    "silver_offers": {
        "offer_id_not_null": ("offer_id IS NOT NULL", "drop"),
        "payout_eur_valid": ("payout_eur IS NOT NULL AND payout_eur > 0", "drop"),
    },
    "silver_installs": {
        "user_id_not_null": ("user_id IS NOT NULL", "drop"),
        "install_ts_not_null": ("install_ts IS NOT NULL", "drop"),
        "country_valid": ("country IS NOT NULL AND LENGTH(country) = 2", "drop"),
        "platform_valid": ("platform IN ('android', 'ios')", "drop"),
    },
    "gold_daily_country_platform": {
        "date_not_null": ("date IS NOT NULL", "fail"),
        "country_not_null": ("country IS NOT NULL", "fail"),
        "platform_not_null": ("platform IS NOT NULL", "fail"),
        "installs_non_negative": ("installs >= 0", "warn"),
        "events_total_non_negative": ("events_total >= 0", "warn"),
    },
}


def pass_rates(tables: dict[str, DataFrame]) -> DataFrame:
    """Per rule: rows, passed and failed rows, rate; a null condition counts as passed."""
    parts = []
    for table, df in tables.items():
        rules = [r for r in PASS_RULES if r[0] == table]
        counted = df.agg(F.count("*").alias("total"), *(F.count_if(~F.expr(r[3])).alias(f"_{i}") for i, r in enumerate(rules)))
        stacked = ", ".join(f"struct('{table}' AS table_name, '{r[1]}' AS rule_name, '{r[2]}' AS severity, total AS total_rows, _{i} AS failed_rows)" for i, r in enumerate(rules))
        parts.append(counted.selectExpr(f"inline(array({stacked}))"))
    rate = F.when(F.col("total_rows") > 0, F.round((F.col("total_rows") - F.col("failed_rows")) / F.col("total_rows"), 6)).otherwise(1.0)
    return reduce(DataFrame.unionByName, parts).select(
        "table_name", "rule_name", "severity", "total_rows", (F.col("total_rows") - F.col("failed_rows")).alias("passed_rows"), "failed_rows",
        rate.alias("pass_rate"), (F.col("failed_rows") == 0).alias("passed"),
    )


def expectation_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, name, action, rows, violations) of the expectations on tables as they came, one pass per table; a null condition is a violation."""
    parts = []
    for table, rules in EXPECTATIONS.items():
        if table in tables:
            told = [F.struct(F.lit(n).alias("name"), F.lit(action).alias("action"), F.count("*").alias("rows"), F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias("violations")) for n, (c, action) in rules.items()]
            wide = tables[table].agg(*(x.alias(f"_{i}") for i, x in enumerate(told)))
            parts.append(wide.select(F.lit(table).alias("table_name"), F.inline(F.array(*wide.columns))))
    return reduce(DataFrame.unionByName, parts)


def expect(df: DataFrame, rules: dict[str, tuple[str, str]]) -> tuple[DataFrame, Observation]:
    """Apply expectations name -> (condition, warn | drop | fail) in one pass; counts are observed as the rows flow by.

    A null condition is a violation.
    """
    seen = Observation()
    holds = {n: F.coalesce(F.expr(c), F.lit(False)) for n, (c, _) in rules.items()}
    out = df.observe(seen, F.count("*").alias("rows"), *(F.count_if(~h).alias(n) for n, h in holds.items()))
    for name, (_, action) in rules.items():
        if action == "fail":
            out = out.where(F.when(holds[name], F.lit(True)).otherwise(F.raise_error(F.lit(f"expectation {name} failed"))))
    for name, (_, action) in rules.items():
        if action == "drop":
            out = out.where(holds[name])
    return out, seen
