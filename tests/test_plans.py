from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rowproof.operators import defects as D
from rowproof.operators import rules as R
from rowproof.operators.anomaly import default_specs
from rowproof.operators.evaluate import PromotionCriteria
from rowproof.plans import baseline, batch, experiment
from rowproof.plans.catalogue import ISSUES, WEIGHTS
from rowproof.sources.sinks import write_period
from rowproof.streaming import score as S


def pair(spark, vendors=50, transactions=60, year=2024):
    vendor_rows = [
        (f"vendor:{i:08d}", f"UEI:{i:012d}", f"Vendor {i}", f"ABCDEFGH{i:04d}", "USA", "VA" if i % 3 else "MD",
         i + 1, i % 4 + 1, "S" if i % 2 else "O")
        for i in range(vendors)
    ]
    start = datetime(year, 1, 1, tzinfo=timezone.utc)
    transaction_rows = [
        (f"transaction:{i:08d}", f"T{i}", f"UEI:{i % vendors:012d}", start, start + timedelta(days=30 + i), i % 5 + 1,
         start + timedelta(days=i), float(i * 10), float(i * 12), *[f"{c}{i % 3}" for c in "abcdefgh"])
        for i in range(transactions)
    ]
    return (
        spark.createDataFrame(
            vendor_rows,
            "_record_id string, vendor_id string, recipient_name string, recipient_uei string, "
            "recipient_country_code string, recipient_state_code string, source_transaction_count long, "
            "address_variant_count long, contracting_officers_determination_of_business_size_code string",
        ),
        spark.createDataFrame(
            transaction_rows,
            "_record_id string, contract_transaction_unique_key string, vendor_id string, "
            "period_of_performance_start_date timestamp, period_of_performance_current_end_date timestamp, "
            "number_of_offers_received long, action_date timestamp, federal_action_obligation double, "
            "total_dollars_obligated double, award_type_code string, type_of_contract_pricing_code string, "
            "action_type_code string, product_or_service_code string, naics_code string, "
            "extent_competed_code string, solicitation_procedures_code string, type_of_set_aside_code string",
        ),
    )


def inject(frames, per_type=2, year=2024):
    return D.inject_defects(
        *frames, D.procurement_defects(year), fiscal_year=year, seed=20240622, per_type=per_type
    )


def test_two_defects_per_type_and_the_rules_find_them(spark):
    frames = pair(spark)
    vendors, transactions, labels = inject(frames)
    rows = labels.collect()
    assert len(rows) == 18 and {r["issue_type"] for r in rows} == set(ISSUES)
    assert vendors.count() == 52 and transactions.count() == 62
    for frame in (vendors, transactions):
        assert frame.select("_record_id").distinct().count() == frame.count()
    found = R.run_rules(vendors, transactions, R.procurement_rules(2024), WEIGHTS)
    missed = labels.select("target_table", "record_id", "issue_type").exceptAll(R.finding_keys(found))
    assert missed.count() == 0
    by_issue = {r["issue_type"]: r for r in rows}
    assert by_issue["missing_vendor_name"]["injected_value"] == "null"
    assert by_issue["missing_vendor_name"]["injected_value_type"] == "null"
    assert by_issue["negative_offer_count"]["injected_value"] == "-1"
    assert by_issue["action_date_outside_fiscal_year"]["injected_value"] == '"2022-01-01T00:00:00+00:00"'
    assert by_issue["duplicate_vendor_id"]["record_id"].startswith("controlled:duplicate_vendor_id:20240622:")


def test_injection_repeats_whatever_the_partitions(spark):
    frames = pair(spark)
    first = inject(frames)
    second = inject(tuple(frame.repartition(7) for frame in frames))
    for one, other in zip(first, second):
        assert one.exceptAll(other).count() == 0 and one.count() == other.count()
    assert frames[0].count() == 50  # the source is untouched


def test_too_few_eligible_records(spark):
    with pytest.raises(ValueError, match="Only 1 eligible records are available for 2 defects"):
        inject(pair(spark, vendors=5))


def test_baseline_writes_labels_findings_and_metrics(spark, tmp_path):
    vendors, transactions = pair(spark, 12, 12)
    folder, output = str(tmp_path / "in"), str(tmp_path / "out")
    write_period(vendors.drop("_record_id"), transactions.drop("_record_id"), folder, 2024)
    summary = baseline.run_periods(spark, folder, output, [2024], per_type=1)
    got = {r["metric"]: r["value"] for r in summary.collect()}
    assert got["controlled_defects"] == 9 and got["issue_level.recall"] == 1.0
    # the flagged source of each duplicate is a false alarm: its label names the copy
    assert got["issue_level.false_positives"] == 2
    for name in ("labels", "findings", "metrics"):
        assert (tmp_path / "out" / "fy2024" / name / "_SUCCESS").exists()
    assert (tmp_path / "out" / "summary" / "_SUCCESS").exists()


def test_a_clean_upload_has_one_finding_per_planted_defect(spark):
    vendors, transactions = (frame.drop("_record_id") for frame in pair(spark, 80, 50))
    text = lambda frame: frame.select(*[F.col(c).cast("string") for c in frame.columns])
    broken = vendors.withColumn("recipient_name", F.lit(None).cast("string"))
    scored = batch.score_batch(text(broken), text(transactions.withColumn("number_of_offers_received", F.lit(-1))), 2024)
    counts = {r["target_table"]: r["count"] for r in scored.findings.groupBy("target_table").count().collect()}
    assert counts == {"vendor": 80, "transaction": 50}
    # validation refuses what the orphan rule would flag
    with pytest.raises(ValueError, match="undeclared vendor keys"):
        batch.score_batch(text(vendors.where("vendor_id > 'UEI:000000000010'")), text(transactions), 2024)


def test_the_holdout_is_not_used_for_selection(spark, tmp_path):
    periods = [
        experiment.make_period(*pair(spark, 20, 40, year), year, role, per_type=1)
        for year, role in ((2024, "development"), (2025, "temporal_holdout"))
    ]
    with pytest.raises(ValueError, match="requires a development period"):
        experiment.run_experiment(periods[1], periods[1])
    with pytest.raises(ValueError, match="temporal holdout"):
        experiment.run_experiment(periods[0], periods[0])
    specs = {"isolation_forest": default_specs()["isolation_forest"]}
    found = experiment.run_experiment(*periods, specs, PromotionCriteria(), 10, str(tmp_path / "out"))
    assert {r["target_table"] for r in found.winners.collect()} == {"vendor", "transaction"}
    assert found.promotion.first()["development_only_selection"]
    assert found.promotion.first()["deterministic_critical_findings_preserved"]
    shown = {(r["period"], r["approach"]): r for r in found.comparison.collect()}
    assert len(shown) == 8
    assert shown["temporal_holdout", "guarded_review_queue"]["high_critical_recall"] == 1.0
    critical = periods[1].findings.where("severity = 'critical'").select("target_table", "record_id")
    assert critical.exceptAll(found.queue.select("target_table", "record_id")).distinct().count() == 0
    for name in ("guarded-review-queue", "comparison-summary", "bounded-anomaly-evidence", "promotion"):
        assert (tmp_path / "out" / name / "_SUCCESS").exists()


def test_streams_give_the_batch_findings_once(spark, tmp_path):
    _, transactions = pair(spark, 20, 40)
    changed = transactions.withColumn(
        "number_of_offers_received", F.when(F.col("federal_action_obligation") < 100, -1).otherwise(1)
    )
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rules = R.procurement_rules(2024)
    options = (rules, WEIGHTS, "transaction")

    def arrive(frame):
        frame.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(changed.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        found = S.score_stream(stream, *options)
        S.write_findings(found, f"{path}/findings", f"{path}/c1").awaitTermination()
        S.write_runs(stream, *options, f"{path}/runs", f"{path}/c2", fiscal_year=2024).awaitTermination()

    half = F.col("federal_action_obligation") < 200
    arrive(changed.where(half))
    arrive(changed.where(~half))
    expected = S.score_stream(changed, *options)
    got = spark.read.parquet(f"{path}/findings").select(*expected.columns)
    assert expected.count() == 10 and got.exceptAll(expected).count() == 0 and got.count() == 10
    stored = spark.read.parquet(f"{path}/runs/findings")
    assert stored.count() == 10
    runs = spark.read.parquet(f"{path}/runs/runs")
    assert runs.agg(F.sum("transaction_records")).first()[0] == 40
    assert all(r["run_id"].startswith("stream-0000000") for r in runs.collect())
