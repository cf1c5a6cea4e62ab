import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rowproof.operators import evaluate as E
from rowproof.operators import rerank as K
from rowproof.operators import review as Q
from rowproof.sources import sinks


def metrics(frame):
    return {row["metric"]: row["value"] for row in frame.collect()}


FINDING = "target_table string, record_id string, issue_type string, severity string, risk_score int"


def test_issue_and_record_grain_differ(spark):
    labels = spark.createDataFrame(
        [("vendor", "V1", "missing_vendor_name", "high"), ("vendor", "V1", "invalid_vendor_uei", "critical")],
        "target_table string, record_id string, issue_type string, severity string",
    )
    findings = spark.createDataFrame(
        [("vendor", "V1", "missing_vendor_name", "high", 75), ("vendor", "V2", "invalid_vendor_uei", "critical", 100)],
        FINDING,
    )
    got = metrics(E.evaluate_issues(labels, findings, 10, 2))
    counts = [got[f"{grain}_level.{name}"] for grain in ("issue", "record") for name in E.COUNTS]
    assert counts == [1, 1, 1, 1, 1, 0]
    assert got["top_2_precision"] == 0.5 and got["false_alarms_per_1000_records"] == 100.0
    assert got["high_critical_issue_recall"] == 0.5 and got["macro_issue_f1"] == 0.5


@pytest.fixture(scope="module")
def labels(spark):
    rows = [("vendor", "V1", "critical"), ("vendor", "V2", "high"), ("transaction", "T1", "critical")]
    return spark.createDataFrame(rows, "target_table string, record_id string, severity string")


RANKING = "target_table string, record_id string, predicted boolean, priority_score double"


def test_record_metrics(spark, labels):
    rows = [("vendor", "V1", True, 100.0, 1.0), ("transaction", "T2", True, 90.0, 0.9),
            ("vendor", "V3", False, 80.0, 0.8), ("transaction", "T1", False, 70.0, 0.7)]
    ranking = spark.createDataFrame(rows, f"{RANKING}, rank_percentile double")
    got = metrics(E.evaluate_ranking(labels, ranking, {"vendor": 4, "transaction": 6}, 2))
    assert got["precision"] == 0.5 and got["recall"] == 1 / 3
    assert got["top_2_precision"] == 0.5 and got["false_alarms_per_1000_records"] == 100.0
    assert got["rank_calibration.6.controlled_defect_rate"] == 1.0
    assert got["rank_calibration.8.records"] == 1
    with pytest.raises(ValueError, match="'vendor'"):
        E.evaluate_ranking(labels, ranking, {"transaction": 6}, 2)
    for counts in ({}, {"": 1}, {"vendor": -1}, {"vendor": True}):
        with pytest.raises(ValueError):
            E.check_counts(counts)


def test_rates_use_each_tables_own_size(spark, labels):
    rows = [("vendor", "V1", True, 100.0), ("transaction", "T2", True, 90.0)]
    ranking = spark.createDataFrame(rows, RANKING)
    got = metrics(E.evaluate_ranking(labels, ranking, {"vendor": 8, "transaction": 2}))
    rate = "false_alarms_per_1000_records"
    assert got[rate] == 100.0 and got[f"per_table.vendor.{rate}"] == 0.0
    assert got[f"per_table.transaction.{rate}"] == 500.0
    assert not any(name.startswith("rank_calibration") for name in got)


def test_the_rank_limit_comes_before_the_shuffle(spark, labels):
    ranking = spark.createDataFrame([("vendor", "V1", True, 1.0)], RANKING)
    frame = E.per_table_metrics(labels, ranking, {"vendor": 1, "transaction": 1}, 50)
    assert "WindowGroupLimit" in frame._jdf.queryExecution().executedPlan().toString()


def test_percentiles_at_bin_edges(spark):
    ranking = spark.createDataFrame(
        [("t", str(i), True, 1.0, p) for i, p in enumerate((0.0, 0.1, 0.3, 0.30000001, 1.0))],
        f"{RANKING}, rank_percentile double",
    )
    none = spark.createDataFrame([], "target_table string, record_id string, severity string")
    got = {r["percentile_bin"]: r["records"] for r in E.rank_calibration(none, ranking).collect()}
    assert got == {0: 2, 2: 1, 3: 1, 9: 1}


def test_winners_per_table(spark):
    rows = [("isolation_forest", "vendor", 0.4, 0.3, 0.25, 5), ("isolation_forest", "transaction", 0.1, 0.1, 0.1, 10),
            ("local_outlier_factor", "vendor", 0.2, 0.4, 0.4, 2), ("local_outlier_factor", "transaction", 0.2, 0.2, 0.2, 8)]
    table = spark.createDataFrame(
        rows, "model_name string, target_table string, top_50_precision double, f1 double, precision double, false_positives long"
    )
    got = {r["target_table"]: r["model_name"] for r in E.winners(table).collect()}
    assert got == {"vendor": "isolation_forest", "transaction": "local_outlier_factor"}


def test_weaker_candidates_are_not_promoted(spark):
    def table(**values):
        return spark.createDataFrame(list(values.items()), "metric string, value double")

    candidate = table(top_50_precision=0.2, macro_f1=0.2, false_alarms_per_1000_records=5.0)
    baseline = table(top_50_precision=0.8, macro_f1=0.8, false_alarms_per_1000_records=3.0)
    row = E.promotion_gates(
        candidate, baseline, table(high_critical_recall=1.0), E.PromotionCriteria(), "development"
    ).first()
    assert not row["promoted"] and row["development_only_selection"]
    assert row["deterministic_critical_findings_preserved"]
    assert not row["top_k_precision_non_inferior"]


SCORE = ("target_table string, record_id string, model_name string, anomaly_score double, "
         "rank_percentile double, predicted boolean, priority_score double, evidence string")


def test_critical_findings_lead_the_queue(spark):
    scores = spark.createDataFrame(
        [("vendor", "V9", "m", 0.9, 0.99, True, 99.0, "{}"), ("transaction", "T9", "m", 0.8, 0.98, True, 98.0, "{}"),
         ("vendor", "V8", "m", 0.1, 0.1, False, 10.0, "{}"), ("vendor", "V1", "m", 0.9, 0.5, True, 50.0, "{}")],
        SCORE,
    )
    findings = spark.createDataFrame(
        [("vendor", "V1", "invalid_vendor_uei", "critical", 100), ("transaction", "T1", "orphan_vendor_reference", "critical", 100),
         ("transaction", "T5", "negative_offer_count", "medium", 50), ("vendor", "V1", "missing_vendor_name", "high", 80)],
        FINDING,
    )
    rows = Q.guarded_queue(scores, findings).collect()
    assert [(r["record_id"], r["priority_score"]) for r in rows] == [
        ("T1", 3100.0), ("V1", 3100.0), ("T5", 2050.0), ("V9", 1099.0), ("T9", 1098.0)]
    assert json.loads(rows[1]["deterministic_issue_types"]) == ["invalid_vendor_uei", "missing_vendor_name"]
    assert rows[1]["has_model_finding"] and rows[1]["has_deterministic_finding"]
    with pytest.raises(RuntimeError, match="suppressed"):
        Q.require_critical(Q.record_ranking(findings).where("record_id <> 'V1'"), findings)
    with pytest.raises(ValueError, match="at most once"):
        Q.guarded_queue(scores.union(scores), findings)
    assert Q.by_severity(findings, []).count() == 0


def test_review_table_hides_what_says_nothing(spark):
    rows = [("vendor", "V1", "missing_vendor_name", "high", 75, None, 75000.0), ("vendor", "V2", "missing_vendor_name", "high", 75, None, 75000.0)]
    frame = spark.createDataFrame(rows, f"{FINDING}, model_confidence double, review_priority double")
    table = Q.review_table(frame, 5)
    assert table.columns == ["queue_position", "severity", "issue", "record"]
    assert table.first()["issue"] == "Missing Vendor Name"
    assert table.first()["record"] == "Vendor · V1"
    keys = spark.createDataFrame([("V2", "UEI:B")], "record_id string, source_key string")
    assert [r["source_key"] for r in Q.review_table(frame, 5, keys).collect()] == ["", "UEI:B"]
    varied = frame.withColumn("model_confidence", F.lit(0.5)).withColumn(
        "risk_score", F.when(F.col("record_id") == "V1", 75).otherwise(50))
    assert Q.review_table(varied, 1).columns[-1] == "model_confidence"
    assert Q.review_table(varied, 2).columns[-2:] == ["model_confidence", "risk_score"]


def feedback(spark, count=80, start=0):
    rows = []
    for i in range(start, count):
        good = i % 2 == 0
        rows.append((f"F{i:03d}", f"vendor:{i:08d}", "vendor", "invalid_vendor_uei" if good else "duplicate_vendor_id",
                     "critical", 100.0, "correct_flag" if good else "false_alarm", datetime(2026, 6, 23, tzinfo=timezone.utc)))
    return spark.createDataFrame(
        rows, "finding_id string, record_id string, target_table string, issue_type string, "
        "severity string, risk_score double, verdict string, feedback_created_at timestamp")


def test_feedback_improves_the_ranking_and_is_promoted(spark, tmp_path):
    training = K.train_reranker(feedback(spark))
    assert training.promoted
    assert training.candidate.first()["top_k_precision"] > training.active.first()["top_k_precision"]
    assert (training.training_examples, training.validation_examples) == (56, 24)
    findings = feedback(spark).drop("verdict", "feedback_created_at")
    training.model.write().overwrite().save(str(tmp_path / "model"))
    ranked = K.rerank(findings, K.PipelineModel.load(str(tmp_path / "model"))).collect()
    assert ranked[0]["issue_type"] == "invalid_vendor_uei"
    assert all(r["model_confidence"] is not None for r in ranked)
    # a confidence never moves a finding past one of another risk
    mixed = findings.withColumn("risk_score", F.when(F.col("issue_type") == "invalid_vendor_uei", 99.0).otherwise(100.0))
    risks = [r["risk_score"] for r in K.rerank(mixed, training.model).collect()]
    assert risks == sorted(risks, reverse=True)
    # unknown categories are all zeros, not an error
    odd = findings.withColumn("issue_type", F.lit("new")).withColumn("severity", F.lit("new"))
    assert K.rerank(odd, training.model).where("model_confidence is null").count() == 0
    assert K.rerank(findings).where("model_confidence is not null").count() == 0


def test_too_little_feedback_trains_nothing(spark):
    training = K.train_reranker(feedback(spark, 4))
    assert training.model is None and not training.promoted
    assert not training.gates.first()["promoted"]


def test_decisive_verdicts_come_before_recency(spark):
    def at(hour):
        return datetime(2026, 1, 1, hour, tzinfo=timezone.utc)

    rows = [("A", "1", "correct_flag", at(1)), ("A", "2", "unsure", at(2)), ("B", "3", "correct_flag", at(1)),
            ("B", "4", "wrong_issue_type", at(3)), ("C", "5", "missed_issue", at(1))]
    frame = spark.createDataFrame(rows, "finding_id string, feedback_id string, verdict string, feedback_created_at timestamp")
    assert {r["finding_id"]: r["label"] for r in K.decisive(frame).collect()} == {"A": 1, "B": 0}


def test_runs_feedback_and_export(spark, tmp_path):
    findings = spark.createDataFrame(
        [("vendor", "V1", "invalid_vendor_uei", "critical", 100, 4, 'say "x", y'), ("vendor", "V2", "missing_vendor_name", "high", 75, 3, "e")],
        f"{FINDING}, severity_rank int, evidence string")
    path = str(tmp_path / "runs")
    facts = dict(fiscal_year=2024, vendor_records=2, transaction_records=0, schema_version="1.0.0", model_version="m")
    for run in ("a", "b", "b"):  # the repeated save replaces its run
        sinks.save_run(findings, path, run_id=run, **facts)
    assert sinks.get_run(spark, path, "b").first()["finding_count"] == 2
    assert sinks.get_run(spark, path, "z").count() == 0
    listed = sinks.list_findings(spark, path, "b").collect()
    assert [r["record_id"] for r in listed] == ["V1", "V2"]
    sinks.export_findings(spark, path, "b", f"{path}/export")
    exported = spark.read.option("header", True).option("escape", '"').csv(f"{path}/export")
    assert exported.columns == list(sinks.EXPORT_COLUMNS)
    assert exported.where("record_id = 'V1'").first()["evidence"] == 'say "x", y'

    def verdicts(*rows):
        return spark.createDataFrame(list(rows), "finding_id string, verdict string, corrected_issue_type string, notes string")

    stored = sinks.read_findings(spark, path)
    known = listed[0]["finding_id"]
    good, unknown = (known, "correct_flag", None, None), ("nope", "unsure", None, None)
    assert not sinks.append_feedback(verdicts(good, unknown), stored, f"{path}/feedback", "b")
    assert not (tmp_path / "runs" / "feedback").exists()
    assert not sinks.append_feedback(verdicts(good), stored, f"{path}/feedback", "a")
    assert sinks.append_feedback(verdicts(good), stored, f"{path}/feedback", "b")
    with pytest.raises(ValueError, match="verdict"):
        sinks.append_feedback(verdicts((known, "maybe", None, None)), stored, f"{path}/feedback")
    examples = sinks.feedback_examples(stored, spark.read.parquet(f"{path}/feedback")).collect()
    assert [(r["finding_id"], r["verdict"], r["risk_score"]) for r in examples] == [(known, "correct_flag", 100.0)]


def test_a_run_is_seen_with_its_commit_record_only(spark, tmp_path):
    findings = spark.createDataFrame(
        [("vendor", f"V{n}", "invalid_vendor_uei", "critical", 100, 4, "e") for n in range(3)],
        f"{FINDING}, severity_rank int, evidence string")
    path = str(tmp_path / "runs")
    facts = dict(fiscal_year=2024, vendor_records=2, transaction_records=0, schema_version="1.0.0", model_version="m")
    sinks.save_run(findings, path, run_id="a", **facts)
    torn = sinks.list_findings(spark, path, "a").drop("run_id")
    torn.write.parquet(f"{path}/findings/run_id=b/attempt=lost")
    torn.limit(1).write.parquet(f"{path}/findings/run_id=a/attempt=lost")
    assert sinks.list_findings(spark, path, "b").count() == 0 and sinks.list_findings(spark, path, "none").count() == 0
    assert sinks.list_findings(spark, path, "a").count() == 3
    assert [r["run_id"] for r in sinks.read_findings(spark, path).collect()] == ["a"] * 3
    sinks.save_run(findings.limit(2), path, run_id="a", **facts)
    assert sinks.list_findings(spark, path, "a").count() == 2
    assert [r["finding_count"] for r in sinks.committed_runs(spark, path).collect()] == [2]
