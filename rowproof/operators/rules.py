"""Deterministic quality rules: one projection per table finds and ranks all issues.

A rule is a pair of Columns. Rules that need other rows (duplicates, orphans) first
reduce the key column to the offending keys and look those up, so wide rows move only
when the list of offending keys itself is large.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.text import shown, shown_time, strip
from rowproof.operators.lookup import lookup, settle_all
from rowproof.plans.catalogue import ISSUES, STATE_CODES, Issue, check_weights

EXTRA_ISSUE = 5  # risk added per further issue of the same record
HIGHEST_RISK = 100


@dataclass(frozen=True, eq=False)
class Rule:
    """``predicate`` null means no finding. ``lookup_key`` asks for a key flag first.

    ``columns`` are those of its table that predicate, evidence and lookup read.
    """

    issue: Issue
    predicate: Column | None
    evidence: Column
    lookup_key: str | None = None
    parent_key: str | None = None
    columns: tuple[str, ...] = ()

    @property
    def relationship(self) -> bool:
        return self.parent_key is not None

    @property
    def flag(self) -> str:
        return f"_flag_{self.issue.name}"

    @property
    def hit(self) -> Column:
        if self.predicate is not None:
            return self.predicate
        flagged = F.col(self.flag).isNotNull()
        return F.col(self.lookup_key).isNull() | flagged if self.relationship else flagged


def blank(issue: Issue, column: str) -> Rule:
    value = F.col(column)
    empty = value.isNull() | (strip(value.cast("string")) == "")
    return Rule(issue, empty, F.lit(f"{column} is missing"), columns=(column,))


def not_matching(issue: Issue, column: str, pattern: str, description: str) -> Rule:
    """Not null and not a full match. ``\\z``, since ``$`` lets a final newline pass."""
    value = F.col(column)
    bad = value.isNotNull() & ~value.rlike(rf"\A(?:{pattern})\z")
    text = F.concat(F.lit(f"{column}="), shown(value), F.lit(f" {description}"))
    return Rule(issue, bad, text, columns=(column,))


def outside_domain(
    issue: Issue, when: str, equals: str, column: str, allowed: Sequence[str]
) -> Rule:
    """``when == equals`` and the value, null included, is not in ``allowed``."""
    value = F.col(column)
    bad = (F.col(when) == equals) & ~F.coalesce(value.isin(*allowed), F.lit(False))
    text = F.concat(F.lit(f"{column}="), shown(value), F.lit(f" is invalid for {equals}"))
    return Rule(issue, bad, text, columns=(when, column))


def duplicated(issue: Issue, key: str) -> Rule:
    text = F.concat(F.lit(f"{key}="), shown(F.col(key)), F.lit(" appears more than once"))
    return Rule(issue, None, text, lookup_key=key, columns=(key,))


def orphan(issue: Issue, key: str, parent_key: str, parent: str) -> Rule:
    text = F.concat(
        F.lit(f"{key}="), shown(F.col(key)), F.lit(f" does not identify a {parent} record")
    )
    return Rule(issue, None, text, lookup_key=key, parent_key=parent_key, columns=(key,))


def before(issue: Issue, end: str, start: str) -> Rule:
    return Rule(issue, F.col(end) < F.col(start), F.lit(f"{end} is before {start}"), columns=(end, start))


def negative(issue: Issue, column: str) -> Rule:
    value = F.col(column)
    text = F.concat(F.lit(f"{column}="), shown(value.cast("long")), F.lit(" is negative"))
    return Rule(issue, value < 0, text, columns=(column,))


def outside_window(issue: Issue, column: str, low: datetime, high: datetime, label: str) -> Rule:
    """Null, earlier than ``low`` or later than ``high`` (both inclusive)."""
    value = F.col(column)
    bad = value.isNull() | (value < F.lit(low)) | (value > F.lit(high))
    text = F.concat(F.lit(f"{column}="), shown_time(value), F.lit(f" is outside {label}"))
    return Rule(issue, bad, text, columns=(column,))


def fiscal_window(fiscal_year: int) -> tuple[datetime, datetime]:
    """October 1 of the year before until September 30, both at midnight UTC."""
    return (
        datetime(fiscal_year - 1, 10, 1, tzinfo=timezone.utc),
        datetime(fiscal_year, 9, 30, tzinfo=timezone.utc),
    )


def procurement_rules(fiscal_year: int) -> list[Rule]:
    low, high = fiscal_window(fiscal_year)
    key = "contract_transaction_unique_key"
    end, start = "period_of_performance_current_end_date", "period_of_performance_start_date"
    return [
        blank(ISSUES["missing_vendor_name"], "recipient_name"),
        not_matching(
            ISSUES["invalid_vendor_uei"],
            "recipient_uei",
            "[A-Z0-9]{12}",
            "is not 12 alphanumeric characters",
        ),
        outside_domain(
            ISSUES["invalid_domestic_state"],
            "recipient_country_code",
            "USA",
            "recipient_state_code",
            STATE_CODES,
        ),
        duplicated(ISSUES["duplicate_vendor_id"], "vendor_id"),
        orphan(ISSUES["orphan_vendor_reference"], "vendor_id", "vendor_id", "vendor"),
        duplicated(ISSUES["duplicate_transaction_key"], key),
        before(ISSUES["invalid_performance_date_order"], end, start),
        negative(ISSUES["negative_offer_count"], "number_of_offers_received"),
        outside_window(
            ISSUES["action_date_outside_fiscal_year"], "action_date", low, high, f"FY{fiscal_year}"
        ),
    ]


def repeated_keys(frame: DataFrame, key: str) -> DataFrame:
    """(key, n) of every non-null key that occurs more than once."""
    return (
        frame.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n) of every non-null foreign key that no parent row has."""
    used = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    present = parent.select(F.col(parent_key).alias(key)).distinct()
    return used.join(present, key, "left_anti")


def columns_read(rules: Sequence[Rule], table: str) -> list[str]:
    """The columns of ``table`` that the rules look at, also from the other table by a relationship."""
    read: list[str] = []
    for rule in rules:
        if rule.issue.table == table:
            read += rule.columns
        elif rule.relationship:
            read.append(rule.parent_key)
    return list(dict.fromkeys(read))


def _key_table(rule: Rule, frame: DataFrame, parent: DataFrame | None) -> DataFrame:
    if rule.relationship:
        keys = orphan_keys(frame, rule.lookup_key, parent, rule.parent_key)
    else:
        keys = repeated_keys(frame, rule.lookup_key)
    return keys.withColumnRenamed("n", rule.flag)


def _key_rules(rules: Sequence[Rule]) -> list[Rule]:
    return [rule for rule in rules if rule.lookup_key is not None]


def find_issues(
    frame: DataFrame,
    rules: Sequence[Rule],
    weights: dict[str, int],
    parent: DataFrame | None = None,
    record_id: str = "_record_id",
    settled: dict[str, tuple] | None = None,
) -> DataFrame:
    """Findings of one table, unordered.

    All hits of a record sit in one array, so its risk needs no shuffle:
    ``min(100, weight + 5 * (hits - 1))``. ``settled`` holds key tables written before.
    """
    if settled is None:
        settled = _settle({rule: (frame, parent) for rule in _key_rules(rules)})
    flagged = frame
    for rule in _key_rules(rules):
        keys, measured = settled[rule.flag]
        flagged = lookup(
            flagged, keys, rule.lookup_key, weight=rule.flag, spread=record_id, measured=measured
        )
    # no higher-order function: the array, the count and the explode all compile to Java
    slots = F.array(
        *[
            F.when(
                rule.hit,
                F.struct(
                    F.lit(rule.issue.table).alias("target_table"),
                    F.lit(rule.issue.name).alias("issue_type"),
                    F.lit(rule.issue.severity).alias("severity"),
                    F.lit(rule.issue.rank).alias("severity_rank"),
                    rule.evidence.alias("evidence"),
                    F.lit(weights[rule.issue.name]).alias("weight"),
                ),
            )
            for rule in rules
        ]
    )
    issues = reduce(
        lambda left, right: left + right,
        [F.when(rule.hit, F.lit(1)).otherwise(F.lit(0)) for rule in rules],
    )
    found = flagged.select(
        F.col(record_id).cast("string").alias("record_id"),
        slots.alias("slots"),
        issues.alias("issues"),
    )
    # the outer form: explode() makes Catalyst infer a filter that evaluates every rule again
    exploded = found.select("record_id", "issues", F.explode_outer("slots").alias("hit")).where(
        F.col("hit").isNotNull()
    )
    risk = F.least(F.lit(HIGHEST_RISK), F.col("hit.weight") + EXTRA_ISSUE * (F.col("issues") - 1))
    return exploded.select(
        "hit.target_table",
        "record_id",
        "hit.issue_type",
        "hit.severity",
        "hit.severity_rank",
        "hit.evidence",
        risk.alias("risk_score"),
    )


def _settle(sources: dict[Rule, tuple[DataFrame, DataFrame | None]]) -> dict[str, tuple]:
    """Write the key tables of all rules, side by side."""
    tables = [
        (_key_table(rule, frame, parent), rule.lookup_key, rule.flag)
        for rule, (frame, parent) in sources.items()
    ]
    return dict(zip((rule.flag for rule in sources), settle_all(tables)))


def ranked(findings: DataFrame) -> DataFrame:
    """Worst first; a distributed sort."""
    return findings.orderBy(
        F.desc("risk_score"), F.desc("severity_rank"), "target_table", "record_id", "issue_type"
    )


def run_rules(
    parent: DataFrame | None,
    child: DataFrame | None,
    rules: Sequence[Rule],
    weights: dict[str, int],
    targets: Collection[str] | None = None,
    relationships: bool = True,
    names: tuple[str, str] = ("vendor", "transaction"),
    record_id: str = "_record_id",
    ordered: bool = True,
) -> DataFrame:
    """Findings of both tables, worst first unless not ``ordered``: what is aggregated needs no sort.

    ``names`` are the tables the rules refer to.
    """
    check_weights(weights, {rule.issue.name: rule.issue for rule in rules})
    frames = dict(zip(names, (parent, child)))
    selected = {
        table: [
            rule
            for rule in rules
            if rule.issue.table == table and (relationships or not rule.relationship)
        ]
        for table in names
        if targets is None or table in targets
    }
    settled = _settle(
        {
            rule: (frames[table], parent)
            for table, chosen in selected.items()
            for rule in _key_rules(chosen)
        }
    )
    parts = [
        find_issues(frames[table], chosen, weights, parent, record_id, settled)
        for table, chosen in selected.items()
        if chosen
    ]
    if not parts:
        raise ValueError("No rule is selected")
    findings = parts[0]
    for part in parts[1:]:
        findings = findings.unionByName(part)
    return ranked(findings) if ordered else findings


def finding_keys(findings: DataFrame) -> DataFrame:
    return findings.select("target_table", "record_id", "issue_type").distinct()


def record_keys(findings: DataFrame) -> DataFrame:
    return findings.select("target_table", "record_id").distinct()


def run_summary(vendors: DataFrame, transactions: DataFrame, findings: DataFrame) -> DataFrame:
    """(metric, value): record counts, finding count, findings by severity."""

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")

    by_severity = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("value"))
    return (
        counted(vendors, "vendor_records")
        .unionByName(counted(transactions, "transaction_records"))
        .unionByName(counted(findings, "finding_count"))
        .unionByName(
            by_severity.select(
                F.concat(F.lit("findings_by_severity."), "severity").alias("metric"), "value"
            )
        )
    )
