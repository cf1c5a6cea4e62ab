from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rowproof.operators import rules as R
from rowproof.plans.batch import score_records
from rowproof.plans.catalogue import ISSUES, WEIGHTS, Issue, check_weights

VENDOR = (
    "_record_id string, vendor_id string, recipient_name string, recipient_uei string, "
    "recipient_country_code string, recipient_state_code string"
)
TRANSACTION = (
    "_record_id string, contract_transaction_unique_key string, vendor_id string, "
    "period_of_performance_start_date timestamp, "
    "period_of_performance_current_end_date timestamp, number_of_offers_received long, "
    "action_date timestamp"
)


def day(year, month, date, hour=0):
    return datetime(year, month, date, hour, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def pair(spark):
    vendors = [
        ("V1", "UEI:ONE", None, "BAD!", "USA", "ZZ"),
        ("V2", "UEI:ONE", "Vendor", "ABCDEFGHIJKL", "USA", "VA"),
    ]
    transactions = [
        ("T1", "TX", "UEI:MISSING", day(2024, 2, 1), day(2024, 1, 1), -1, day(2020, 1, 1)),
        ("T2", "TX", "UEI:ONE", day(2024, 2, 1), day(2024, 3, 1), 2, day(2024, 3, 1)),
    ]
    return spark.createDataFrame(vendors, VENDOR), spark.createDataFrame(transactions, TRANSACTION)


def run(pair, **options):
    rules = R.procurement_rules(2024)
    return R.run_rules(*pair, rules, options.pop("weights", WEIGHTS), **options)


def test_all_nine_issues_with_bounded_risk(pair):
    rows = run(pair).collect()
    assert {row["issue_type"] for row in rows} == set(ISSUES)
    assert all(0 <= row["risk_score"] <= 100 for row in rows)
    by_key = {(row["record_id"], row["issue_type"]): row for row in rows}
    assert by_key["V2", "duplicate_vendor_id"]["risk_score"] == 100
    assert by_key["T1", "negative_offer_count"]["risk_score"] == 50 + 5 * 4
    evidence = by_key["T1", "action_date_outside_fiscal_year"]["evidence"]
    assert evidence == "action_date=2020-01-01 00:00:00+00:00 is outside FY2024"
    order = [(-r["risk_score"], -r["severity_rank"], r["target_table"], r["record_id"]) for r in rows]
    assert order == sorted(order)


def test_weights_set_the_risk(spark):
    vendors = spark.createDataFrame([("V1", "V1", None, "ABCDEFGHIJKL", "USA", "VA")], VENDOR)
    transactions = spark.createDataFrame(
        [("T1", "T1", "V1", day(2024, 1, 1), day(2024, 12, 31), 1, day(2024, 1, 15))], TRANSACTION
    )
    found = run((vendors, transactions), weights=dict.fromkeys(ISSUES, 10)).collect()
    assert [(r["issue_type"], r["risk_score"]) for r in found] == [("missing_vendor_name", 10)]


def test_incomplete_or_wild_weights_are_refused():
    with pytest.raises(ValueError, match="missing="):
        check_weights({"missing_vendor_name": 1})
    with pytest.raises(ValueError, match="between 0 and 100"):
        check_weights({**WEIGHTS, "missing_vendor_name": 101})


def test_predicates_at_their_edges(spark):
    vendors = spark.createDataFrame(
        [
            ("blank", "a", "  \t", "ABCDEFGHIJKL", "USA", None),
            ("newline", "b", "x", "ABCDEFGHIJKL\n", "CAN", "ZZ"),
            ("empty", "c", "x", "", None, None),
            ("none", None, "x", None, "USA", "PW"),
            ("none2", None, "x", None, "USA", "PW"),
        ],
        VENDOR,
    )
    found = run((vendors, None), targets=("vendor",)).collect()
    assert {(r["record_id"], r["issue_type"]) for r in found} == {
        ("blank", "missing_vendor_name"),
        ("blank", "invalid_domestic_state"),
        ("newline", "invalid_vendor_uei"),
        ("empty", "invalid_vendor_uei"),
    }


def test_the_last_day_counts_until_midnight_only(spark):
    rows = [
        ("first", "1", "v", None, None, None, day(2023, 10, 1)),
        ("early", "2", "v", None, None, None, day(2023, 9, 30, 23)),
        ("last", "3", "v", None, None, None, day(2024, 9, 30)),
        ("late", "4", "v", None, None, None, day(2024, 9, 30, 1)),
        ("null", "5", "v", None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, TRANSACTION)
    found = run((None, frame), targets=("transaction",), relationships=False).collect()
    assert {row["record_id"] for row in found} == {"early", "late", "null"}


def test_null_references_are_orphans_but_null_keys_no_duplicates(spark):
    vendors = spark.createDataFrame([("V", "v", "x", None, None, None)], VENDOR)
    fine = day(2024, 1, 1)
    rows = [("a", None, None, None, None, None, fine), ("b", None, "v", None, None, None, fine)]
    found = run((vendors, spark.createDataFrame(rows, TRANSACTION)), targets=("transaction",))
    assert [(r["record_id"], r["issue_type"]) for r in found.collect()] == [
        ("a", "orphan_vendor_reference")
    ]


def test_a_third_of_the_rows_may_share_one_key(spark):
    frame = spark.range(900).select(
        F.format_string("r%d", "id").alias("_record_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
    )
    rule = R.duplicated(Issue("twice", "thing", "high"), "key")
    found = R.run_rules(None, frame, [rule], {"twice": 7}, names=("none", "thing"))
    assert found.count() == 300


def test_one_scan_and_no_python_per_table(pair):
    """All rules of a table share a plan: one Generate per table, no Python, no global window."""
    plan = run(pair)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2
    assert "Python" not in plan and "Window" not in plan


def test_findings_do_not_depend_on_partitions(pair):
    again = run(tuple(frame.repartition(7) for frame in pair))
    assert run(pair).exceptAll(again).count() == 0 and again.exceptAll(run(pair)).count() == 0


def test_keys_and_summary(pair):
    found = run(pair)
    assert R.finding_keys(found).count() == found.count()
    assert R.record_keys(found.unionByName(found)).count() == 4
    summary = {r["metric"]: r["value"] for r in R.run_summary(*pair, found).collect()}
    assert summary["vendor_records"] == 2 and summary["finding_count"] == found.count()
    assert summary["findings_by_severity.critical"] == 6


def test_single_record_has_no_relationship_findings(spark):
    record = spark.createDataFrame(
        [("T", "UNKNOWN", "-1", "2024-03-01", "2024-01-01", "2024-12-31")],
        "contract_transaction_unique_key string, vendor_id string, "
        "number_of_offers_received string, action_date string, "
        "period_of_performance_start_date string, period_of_performance_current_end_date string",
    )
    for name in (
        "federal_action_obligation total_dollars_obligated award_type_code action_type_code "
        "type_of_contract_pricing_code product_or_service_code naics_code extent_competed_code "
        "solicitation_procedures_code type_of_set_aside_code"
    ).split():
        record = record.withColumn(name, F.lit(None).cast("string"))
    found = score_records(record, "transaction", 2024).collect()
    assert [row["issue_type"] for row in found] == ["negative_offer_count"]
