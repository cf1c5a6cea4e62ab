"""How well the rules find controlled defects, period by period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.operators.defects import inject_defects, procurement_defects
from rowproof.operators.evaluate import evaluate_issues
from rowproof.operators.normalize import add_record_ids, build_vendors, prepare_transactions
from rowproof.operators.rules import procurement_rules, run_rules
from rowproof.plans.catalogue import DEFECT_SEED, DEFECTS_PER_TYPE, TOP_K, WEIGHTS
from rowproof.session import cut
from rowproof.sources.extracts import read_period, read_raw_transactions
from rowproof.sources.sinks import write_document, write_json, write_period, write_table
from rowproof.sources.snapshots import file_digests, preparation_counts


def prepare_period(
    spark: SparkSession, raw_folder: str, folder: str, fiscal_year: int
) -> dict[str, object]:
    """Raw parts to prepared tables and a manifest, which is written last."""
    raw = read_raw_transactions(spark, raw_folder, fiscal_year)
    transactions = cut(prepare_transactions(raw, fiscal_year))
    write_period(build_vendors(transactions), transactions, folder, fiscal_year)
    vendors, transactions = read_period(spark, folder, fiscal_year)
    counts = preparation_counts(vendors, transactions).first().asDict()
    files = []
    for name in ("vendors", "transactions"):
        part = f"{folder}/{name}/fiscal_year={fiscal_year}"
        # one row per part file
        for row in file_digests(spark, part, "*.parquet").orderBy("file").collect():
            files.append({"table": name, **row.asDict()})
    manifest = {
        "schema_version": 1,
        "fiscal_year": int(fiscal_year),
        **counts,
        "transaction_columns": transactions.columns,
        "vendor_columns": vendors.columns,
        "files": files,
    }
    write_document(spark, manifest, f"{folder}/manifests/fy{fiscal_year}")
    return manifest


def measured_period(
    vendors: DataFrame,
    transactions: DataFrame,
    fiscal_year: int,
    weights: dict[str, int] = WEIGHTS,
    seed: int = DEFECT_SEED,
    per_type: int = DEFECTS_PER_TYPE,
    k: int = TOP_K,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, findings, metrics) of one pair that has record ids."""
    parent, child, labels = inject_defects(
        vendors,
        transactions,
        procurement_defects(fiscal_year),
        fiscal_year=fiscal_year,
        seed=seed,
        per_type=per_type,
    )
    findings = cut(run_rules(parent, child, procurement_rules(fiscal_year), weights, ordered=False))
    labels = cut(labels)
    size = F.count(F.lit(1))
    records = parent.agg(size).first()[0] + child.agg(size).first()[0]
    return labels, findings, evaluate_issues(labels, findings, records, k)


def run_period(
    spark: SparkSession,
    folder: str,
    output: str,
    fiscal_year: int,
    weights: dict[str, int] = WEIGHTS,
    seed: int = DEFECT_SEED,
    per_type: int = DEFECTS_PER_TYPE,
) -> DataFrame:
    """Measure one prepared period and write labels, findings and metrics."""
    vendors, transactions = read_period(spark, folder, fiscal_year)
    labels, findings, metrics = measured_period(
        add_record_ids(vendors, "vendor", ["vendor_id"], unique=True),
        add_record_ids(transactions, "transaction", ["contract_transaction_unique_key"]),
        fiscal_year,
        weights,
        seed,
        per_type,
    )
    target = f"{output}/fy{fiscal_year}"
    write_table(labels, f"{target}/labels")
    write_table(findings, f"{target}/findings")
    write_json(metrics, f"{target}/metrics")
    return metrics


def run_periods(
    spark: SparkSession, folder: str, output: str, fiscal_years: Sequence[int], **options
) -> DataFrame:
    """(fiscal_year, metric, value) over all periods; also written as the summary."""
    parts = [
        run_period(spark, folder, output, year, **options).withColumn("fiscal_year", F.lit(year))
        for year in fiscal_years
    ]
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.unionByName(part)
    summary = cut(summary)
    write_json(summary, f"{output}/summary")
    return summary
