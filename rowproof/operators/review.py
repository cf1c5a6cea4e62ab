"""Review queues: rules and models merged so that no critical finding disappears."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.text import json_list
from rowproof.operators.anomaly import by_priority
from rowproof.plans.catalogue import TOP_K
from rowproof.session import cut, small_table

TIER = 1000


def record_ranking(findings: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per record with its highest risk and its issue types as JSON, highest first if ``ordered``."""
    grouped = findings.groupBy("target_table", "record_id").agg(
        F.max("risk_score").alias("priority_score"),
        F.bool_or(F.col("severity") == "critical").alias("deterministic_critical"),
        # a record has at most one finding per rule
        F.array_sort(F.collect_set("issue_type")).alias("_types"),
    )
    ranking = grouped.select(
        "target_table",
        "record_id",
        "priority_score",
        "deterministic_critical",
        json_list(F.col("_types")).alias("deterministic_issue_types"),
        F.lit(True).alias("predicted"),
    )
    return by_priority(ranking) if ordered else ranking


def guarded_queue(
    scores: DataFrame, findings: DataFrame, check: bool = True, ordered: bool = True
) -> DataFrame:
    """Rule records before model-only records, critical ones before all others.

    Not ``ordered``, the rows come as they were written; checked ones are a written table.
    """
    rules = record_ranking(findings, ordered=False).select(
        "target_table",
        "record_id",
        F.col("priority_score").alias("deterministic_risk_score"),
        "deterministic_critical",
        "deterministic_issue_types",
    )
    models = scores.where("predicted").select(
        "target_table",
        "record_id",
        "model_name",
        "anomaly_score",
        "rank_percentile",
        F.col("evidence").alias("model_evidence"),
    )
    if check:
        repeated = models.groupBy("target_table", "record_id").count().where("count > 1")
        if not repeated.isEmpty():
            raise ValueError("Model scores must hold each record at most once")
    joined = rules.join(models, ["target_table", "record_id"], "full_outer")
    ruled = F.col("deterministic_risk_score").isNotNull()
    critical = F.coalesce(F.col("deterministic_critical"), F.lit(False))
    tier = F.when(critical, 3).when(ruled, 2).when(F.col("model_name").isNotNull(), 1).otherwise(0)
    within = F.coalesce(
        F.col("deterministic_risk_score").cast("double"),
        F.coalesce(F.col("rank_percentile"), F.lit(0.0)) * 100,
    )
    queue = joined.select(
        "target_table",
        "record_id",
        "deterministic_risk_score",
        critical.alias("deterministic_critical"),
        "deterministic_issue_types",
        "model_name",
        "anomaly_score",
        "rank_percentile",
        "model_evidence",
        ruled.alias("has_deterministic_finding"),
        F.col("model_name").isNotNull().alias("has_model_finding"),
        F.lit(True).alias("predicted"),
        (tier * TIER + within).alias("priority_score"),
    )
    if check:
        # one row per record: written once, checked and returned
        queue = cut(queue)
        require_critical(queue, findings)
    return by_priority(queue) if ordered else queue


def suppressed_critical(queue: DataFrame, findings: DataFrame) -> DataFrame:
    keys = findings.where(F.col("severity") == "critical").select("target_table", "record_id")
    return keys.distinct().join(queue, ["target_table", "record_id"], "left_anti")


def require_critical(queue: DataFrame, findings: DataFrame) -> None:
    if not suppressed_critical(queue, findings).isEmpty():
        raise RuntimeError("A deterministic critical finding was suppressed")


def by_severity(findings: DataFrame, levels: Collection[str]) -> DataFrame:
    """No level selects nothing."""
    return findings.where(F.col("severity").isin(*levels) if levels else F.lit(False))


def mixed_order() -> list[Column]:
    return [F.md5("finding_id").asc(), F.asc("finding_id")]


def mixed_queue(findings: DataFrame) -> DataFrame:
    """A fixed shuffle: order by a hash of the finding id."""
    return findings.orderBy(*mixed_order())


def confidence_order() -> list[Column]:
    best = [F.desc_nulls_last("model_confidence"), F.desc_nulls_last("risk_score")]
    return [*best, F.asc("target_table"), F.asc("record_id"), F.asc("issue_type")]


def confidence_queue(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*confidence_order())


def queue_order() -> list:
    return [F.desc("review_priority"), F.asc("target_table"), F.asc("record_id"), F.asc("issue_type")]


def review_table(
    findings: DataFrame, limit: int, keys: DataFrame | None = None, order: list | None = None
) -> DataFrame:
    """The first ``limit`` findings as shown to a reviewer.

    ``keys`` (record_id, source_key) adds the business key; the confidence column appears
    only if known, the risk column only if it varies.
    """
    top = findings.orderBy(*(order or queue_order())).limit(limit)
    # bounded by limit: positions are given on the driver, in the order of the limit
    rows = [row.asDict() for row in top.collect()]
    for place, row in enumerate(rows, start=1):
        row["queue_position"] = place
    layout = f"{findings.schema.simpleString()[7:-1]},queue_position:int"
    visible = small_table(
        findings.sparkSession,
        [tuple(row[name] for name in [*findings.columns, "queue_position"]) for row in rows],
        layout,
    )
    columns = [
        F.col("queue_position"),
        F.col("severity"),
        F.initcap(F.replace("issue_type", F.lit("_"), F.lit(" "))).alias("issue"),
        F.concat(F.initcap("target_table"), F.lit(" · "), F.col("record_id")).alias("record"),
    ]
    if keys is not None:
        # the large side is filtered by a broadcast of at most ``limit`` ids
        wanted = F.broadcast(visible.select("record_id").distinct())
        visible = visible.join(keys.join(wanted, "record_id", "left_semi"), "record_id", "left")
        columns.append(F.coalesce(F.col("source_key"), F.lit("")).alias("source_key"))
    if any(row.get("model_confidence") is not None for row in rows):
        columns.append(F.col("model_confidence"))
    if len({row["risk_score"] for row in rows if row["risk_score"] is not None}) > 1:
        columns.append(F.col("risk_score"))
    return visible.select(*columns).orderBy("queue_position")


def top_evidence(scores: DataFrame, limit: int = TOP_K) -> DataFrame:
    return by_priority(scores.where("predicted")).limit(limit).select(
        "target_table", "record_id", "model_name", "anomaly_score", "rank_percentile", "evidence"
    )


def with_finding_ids(findings: DataFrame, run_id: str) -> DataFrame:
    """Ids that a repeated run gives again, so retries do not duplicate findings."""
    identity = F.sha2(
        F.concat_ws("|", F.lit(run_id), "target_table", "record_id", "issue_type"), 256
    )
    return findings.withColumn("finding_id", identity).withColumn("run_id", F.lit(run_id))
